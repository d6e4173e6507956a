"""tessera: a PySpark-native engine for curating semi-structured metadata.

``functions`` holds column expressions, ``sources`` readers, ``operators`` DataFrame -> DataFrame
operators, ``plans`` whole workflows and the registered queries, ``streaming`` incremental jobs.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code with them, so that executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
