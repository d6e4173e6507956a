"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("tessera.llm.queries_counts", "tessera.llm.queries_forms", "tessera.llm.queries_mixture", "tessera.llm.queries_personal")


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
