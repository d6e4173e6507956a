import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import provider
from tessera.streaming import incremental


def test_stream_targets(spark, tmp_path):
    doc = json.dumps({"sample": [{"channel": [{"source": "lung"}, {"source": "lung"}]}]})
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "record_id long, metadata string"
    for k in range(2):
        spark.createDataFrame([(k, doc)], schema).write.mode("append").parquet(src)
        incremental.stream_targets(spark, src, schema, out, cp).awaitTermination()
    assert sorted((r["record_id"], r["n_occurrences"]) for r in spark.read.parquet(out).collect()) == [(0, 2), (1, 2)]


def test_stream_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(10).select(F.timestamp_seconds(F.col("id") * 1800).alias("ts"), (F.col("id") % 2).alias("k")).write.parquet(src)
    got = {(r["start"].hour, r["k"]): r["n"] for r in incremental.stream_counts(spark.read.parquet(src), "ts", "k").collect()}
    assert sum(got.values()) == 10 and got[(0, 0)] == 1


def test_providers(spark):
    docs = spark.createDataFrame([(1, 0, "UBERON", "http://x/1", "U_1", "", "U:1", "lung"), (1, 1, "UBERON", "http://x/1", "U_1", "", "U:1", "again"), (1, 2, "", "http://x/2", "U_2", "", "", "none"), (1, 3, "E", "i", "", "E_3", None, "x")],
                                 "q int, position int, ontology_name string, iri string, short_form string, doc_id string, obo_id string, label string")
    hits = provider.remote_hits(docs, ["q"])
    assert {(r["ontology_id"], r["id"], r["title"]) for r in hits.collect()} == {("uberon", "U_1", "lung"), ("e", "E_3", "x")}
    assert provider.remote_hits(docs, ["q"], rows=3).count() == 1
    assert json.loads(provider.compact(hits, ["q"], ["id", "accession"], 1).first()["candidates"]) == [{"id": "U_1", "accession": "U:1"}]
    t = spark.createDataFrame([("ab",), (None,), ("c",)], "t string")
    assert [r["vector"] for r in provider.embedded(t, "t", lambda xs: [[len(x), 1] for x in xs], 2, 1).collect()] == [[2.0, 1.0], None, [1.0, 1.0]]
    with pytest.raises(Exception):
        provider.embedded(t, "t", lambda xs: [[1]] * len(xs), 2).collect()
    assert provider.layered({"a": {"x": 1, "y": 2}}, {"a": {"y": 3}, "b": 4}) == {"a": {"x": 1, "y": 3}, "b": 4}
    for bad in ({"threshold": float("nan")}, {"parent_depth": -1}, {"offset": 3}, {"limit": 0}, {"threshold": True}):
        with pytest.raises(ValueError):
            provider.check_settings(**bad)
    provider.check_settings()
