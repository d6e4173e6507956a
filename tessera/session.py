"""Session settings and tables staged in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, or where it is unset and Spark is local, a folder of our own.

    A cluster without that setting is an error: a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if folder:
        return f"{folder.rstrip('/')}/tessera-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _OWN[app], True)
        spark.sparkContext.setCheckpointDir(f"{_OWN[app]}/checkpoints")
    return f"{_OWN[app]}/tables"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return it read back.

    This cuts the lineage: a lost executor costs a re-read, not a re-computation, and the written sizes
    let the planner choose its joins. The table lives as long as the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove the staged tables of this application; results that still read them must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
