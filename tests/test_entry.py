"""The registered queries: names, SQL beside them, independence from the text subpackage, and results on the smallest tables."""

import os
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"


def test_sql_belongs_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_core_does_not_import_llm():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) tessera\.llm", p.read_text(), re.M), p


def _text(x):
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["exact_lookup", "field_resolve", "dedupe_targets", "target_additions", "vector_topk", "balanced_pool", "preferred_pool", "fts_or", "triple_terms", "cache_live", "p3_found", "p6_found"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = Counter(tuple(map(_text, r)) for r in cursor.fetchall())
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(map(_text, r)) for r in df.select(*columns).collect()) == want
