import string

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.functions import keys, text


def brute(x, times=1):
    for _ in range(times):
        x = "_".join(x.lower().strip().strip(string.punctuation).split()) if x.lower().strip().strip(string.punctuation).strip() == x.lower().strip().strip(string.punctuation) else None
        if x is None:
            return None
    return x


def test_golden(spark):
    rows = [("  Oral   Buccal mucosa, ", "oral_buccal_mucosa"), ("UBERON:0002048", "uberon:0002048"), ("( foo )", "_foo_"), ("", ""), (None, None), ("HTTP://X/A_1", "http://x/a_1")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("k", keys.harmonize_key(F.col("a"))).withColumn("t", keys.harmonize_key(F.col("k")))
    got = df.collect()
    assert [r["k"] for r in got] == [b for _, b in rows]
    assert got[2]["t"] == "foo"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aB _-.,()é\t  \u001cX", max_size=12), min_size=30, max_size=60))
def test_random_keys(spark, values):
    got = [r["k"] for r in spark.createDataFrame([(v,) for v in values], "a string").select(keys.harmonize_key(F.col("a")).alias("k")).collect()]
    for v, k in zip(values, got):
        b = brute(v)
        assert b is None or b == k


def test_pointers_and_iris(spark):
    r = spark.createDataFrame([("a/b~c", "/x/a~1b~0c", "http://p/obo/UBERON_0002048#x", "http://h/obo/UBERON_0002048")], "s string, p string, i string, j string").select(
        keys.pointer_escape(F.col("s")), keys.pointer_last(F.col("p")), keys.pointer_parent(F.col("p")), keys.accession_from_iri(F.col("j")), keys.accession_from_iri(F.col("i")), keys.pointer_parent(F.lit("/one"))).first()
    assert list(r) == ["a~1b~0c", "a/b~c", "/x", "UBERON:0002048", None, ""]


def test_text(spark):
    r = spark.range(1).select(
        text.file_name(F.lit("https://h.org/a/b/x.owl?v=1")), text.version_from_iri(F.lit("http://h/releases/2020-01/x.owl")), text.version_from_iri(F.lit("http://h/2021-02-03/x.owl")),
        text.looks_like_html(F.lit(" <?xml version='1'?>\n<HTML>")), text.looks_like_html(F.lit("<rdf:RDF>")), keys.clipped(F.lit("a" * 600), 500), text.chunk_text(label=F.lit("x"), description=F.lit(None).cast("string"))).first()
    assert list(r)[:5] == ["x.owl", "2020-01", "2021-02-03", True, False] and len(r[5]) == 500 and r[5].endswith("…") and r[6] == "label: x"


def test_query_problems(spark):
    rows = [("a", "x y"), ("a", "X  Y"), ("b", ""), ("c", "1"), ("c", "2"), ("c", "3"), ("c", "4"), ("d", "q [Filter]"), ("e", "fine")]
    got = {r["k"]: r["problem"] for r in text.valid_queries(spark.createDataFrame(rows, "k string, query string"), "k").collect()}
    assert got == {"a": "duplicate", "b": "empty", "c": "too_many", "d": "filter", "e": None}
