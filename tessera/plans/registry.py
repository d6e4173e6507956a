"""All queries of the library's core, with the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Modules with ``queries()`` and ``oracle_sql()``.
MODULES = ("tessera.plans.structure", "tessera.plans.curation")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(name).queries()
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(name).oracle_sql()
    return out
