"""Lookup, pools, vectors, graph and text search against known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import fts, graph, lookup, pool, vector

ENTRY = "ontology_id string, index_name string, index_rank int, lookup_key string, term_key string, source_order long"


def test_hit_order_and_dedupe(spark):
    entries = spark.createDataFrame([("o", "label", 0, "lung", "label-hit", 0), ("o", "label", 0, "lung", "duplicate-hit", 1), ("o", "id", 1, "lung", "duplicate-hit", 0), ("o", "accession", 2, "lung", "id-hit", 0), ("o", "iri", 3, "lung", "label-hit", 0), ("o", "id", 1, None, "x", 0)], ENTRY)
    q = spark.createDataFrame([(1, " LUNG, "), (2, None), (3, "")], "query_id int, label string")
    hits = lookup.exact_lookup(q, entries)
    assert [r["term_key"] for r in hits.orderBy("position").collect()] == ["label-hit", "duplicate-hit", "id-hit"]
    assert lookup.unique_hits(hits, ["query_id"]).count() == 0
    assert lookup.exact_lookup(q.limit(0), entries).count() == 0


def test_identities(spark):
    df = spark.createDataFrame([(1, "", "a", "i", "t"), (2, None, "a", None, "t"), (3, None, None, None, None)], "n int, id string, accession string, iri string, title string")
    got = df.select(lookup.lookup_identity(), lookup.vector_identity(), lookup.remote_identity()).collect()
    assert [tuple(r) for r in got] == [("", "a", "i"), ("a", "a", "a"), (None, None, None)]
    twice = df.unionByName(df)
    assert lookup.first_per_identity(twice, [], lookup.lookup_identity(), [F.col("n")]).count() == 4


def test_fields(spark):
    registry = spark.createDataFrame([("tissue", 0, "Tissue", ["sample type"]), ("type", 1, "kind", ["sample_type", None]), ("x", 2, None, None)], "field_id string, ordinal int, canonical string, aliases array<string>")
    values = spark.createDataFrame([("sample   type",), ("KIND",), ("other",), (None,)], "v string")
    got = {r["v"]: r["field_id"] for r in lookup.resolve_fields(values, registry, "v").collect()}
    assert got == {"sample   type": "tissue", "KIND": "type", "other": None, None: None}
    assert [r["name"] for r in lookup.alias_conflicts(registry).collect()] == ["sample_type"]


def test_decisions_and_enrichment(spark):
    c = spark.createDataFrame([(1, "a", "X", "i1", 0), (1, "b", "a", "i2", 1)], "q int, id string, accession string, iri string, position int")
    d = spark.createDataFrame([(1, "a"), (2, "a")], "q int, decision string")
    assert [r["iri"] for r in lookup.chosen(d, c, ["q"]).collect()] == ["i1"]
    s = spark.createDataFrame([(1, None, "U:1", None, None, "kept")], "k int, id string, accession string, iri string, title string, note string")
    local = spark.createDataFrame([(7, " u:1 ", None, None, "T", "lost"), (8, "u:1", None, None, "Z", "z")], "ordinal int, id string, accession string, iri string, title string, note string")
    r = lookup.enriched(s, local, "k", ["title", "note"]).first()
    assert (r["title"], r["note"]) == ("T", "kept")


HIT = "query_id int, ontology_id string, framework_rank int, identity string, position int, score double"


def test_balanced(spark):
    six = [(1, f"o{o}", o, f"{o}-{h}", h, 0.9 - h / 10) for o in range(6) for h in range(3)]
    got = pool.balanced_pool(spark.createDataFrame(six, HIT))
    assert got.count() == 12 and {r["count"] for r in got.groupBy("ontology_id").count().collect()} == {2}
    two = [(1, "dom", 0, f"d{h}", h, 0.9 - h / 1000) for h in range(10)] + [(1, "spec", 1, f"s{h}", h, 0.6 - h / 1000) for h in range(10)]
    got = pool.balanced_pool(spark.createDataFrame(two, HIT))
    assert got.count() == 10 and got.filter("ontology_id = 'spec'").count() == 2
    t = spark.createDataFrame([("strict", 0.7)], "ontology_id string, threshold double")
    rows = [(1, "strict", 0, "a", 0, 0.69), (1, "default", 1, "b", 0, 0.5), (1, "default", 1, "c", 1, 0.49), (1, "default", 1, "n", 2, float("nan")), (1, "default", 1, "b", 3, 0.5)]
    assert [r["identity"] for r in pool.balanced_pool(spark.createDataFrame(rows, HIT), t).collect()] == ["b"]


def test_preferred(spark):
    hits = [(1, o, p) for p, o in enumerate(["g", "a", "g", "b", "a", "g", "b", "a"])]
    got = pool.preferred_pool(spark.createDataFrame(hits, "query_id int, ontology_id string, position int"), ["a", "b"], 6).orderBy("pool_rank").collect()
    assert [(r["ontology_id"], r["position"]) for r in got] == [("a", 1), ("b", 3), ("a", 4), ("b", 6), ("g", 0), ("g", 2)]


TREE = [("0", 0.7, []), ("1", 0.8, ["0"]), ("2", 0.9, ["0"]), ("3", 1.0, ["1", "2"]), ("4", 0.95, ["3"]), ("5", 0.85, ["3"]), ("6", 0.2, [])]


def tree(spark, extra=()):
    v = spark.createDataFrame([("o", k, [s, math.sqrt(1 - s * s)]) for k, s, _ in TREE], "ontology_id string, term_key string, vector array<double>")
    links = spark.createDataFrame([("o", k, p) for k, _, ps in TREE for p in ps] + list(extra), "ontology_id string, child string, parent string")
    return v, links, spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vector array<double>")


def test_relatives(spark):
    v, links, q = tree(spark)
    seeds = vector.top_k(q, v, 1).select("query_id", "ontology_id", "term_key").join(q, "query_id")
    up, down = graph.relatives(seeds, links, v, 2, "parent"), graph.relatives(seeds, links, v, 1, "child")
    got = {(r["term_key"], r["relation"], r["depth"]) for r in up.unionByName(down).collect()}
    assert got == {("2", "parent", 1), ("0", "parent", 2), ("4", "child", 1)}
    picked = graph.pick_relatives(seeds, up.unionByName(down))
    assert {r["term_key"] for r in picked.collect()} == {"2", "0", "4"}
    v, links, q = tree(spark, [("o", "0", "3")])
    cyc = graph.relatives(seeds, links, v, 5, "parent")
    assert {(r["term_key"], r["depth"]) for r in cyc.collect()} == {("2", 1), ("0", 2)}
    zero = seeds.withColumn("vector", F.array(F.lit(0.0), F.lit(0.0)))
    assert graph.relatives(zero, links, v, 1, "parent").count() == 0
    with pytest.raises(ValueError):
        graph.relatives(seeds, links, v, 0, "parent")


def test_edges(spark):
    terms = spark.createDataFrame([("o", "a", ["O:2", "http://x/O_2", "gone", "O:1"]), ("o", "b", [])], "ontology_id string, term_key string, refs array<string>")
    entries = spark.createDataFrame([("o", "accession", "o:2", "b"), ("o", "iri", "http://x/o_2", "b"), ("o", "accession", "o:1", "a"), ("o", "label", "gone", "b")], "ontology_id string, index_name string, lookup_key string, term_key string")
    assert [tuple(r) for r in graph.edges(terms, entries).collect()] == [("o", "a", "b")]


def test_top_k_brute(spark):
    r = random.Random(3)
    rows = [(f"o{k % 3}", f"t{k:03}", [r.gauss(0, 1) for _ in range(4)]) for k in range(90)] + [("o0", "zero", [0.0] * 4), ("o0", "null", None)]
    queries = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(5)]
    v = spark.createDataFrame(rows, "ontology_id string, term_key string, vector array<double>")
    got = {}
    for x in vector.top_k(spark.createDataFrame(queries, "query_id int, vector array<double>"), v, 4).collect():
        got.setdefault((x["query_id"], x["ontology_id"]), {})[x["position"]] = x["term_key"]
    cos = lambda a, b: -1 if not any(a) or not any(b) else sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for qid, q in queries:
        for o in ("o0", "o1", "o2"):
            want = sorted(((-cos(q, w), t) for oo, t, w in rows if oo == o and w))[:4]
            assert [got[(qid, o)][i + 1] for i in range(4)] == [t for _, t in want]
    assert vector.top_k(spark.createDataFrame([], "query_id int, vector array<double>"), v).count() == 0


def bm25(docs, phrases):
    """Brute force over (id, [column texts as token lists]); phrases: lists of tokens, the last a prefix."""
    n, mean = len(docs), sum(sum(map(len, cols)) for _, cols in docs) / len(docs)
    scores = {}
    for p in phrases:
        f = {}
        for k, cols in docs:
            c = sum(1 for t in cols for i in range(len(t) - len(p) + 1) if t[i : i + len(p) - 1] == p[:-1] and t[i + len(p) - 1].startswith(p[-1]))
            if c:
                f[k] = c
        idf = math.log((n - len(f) + 0.5) / (len(f) + 0.5)) if f else 0
        idf = idf if idf > 0 else 1e-6
        for k, c in f.items():
            size = sum(map(len, dict(docs)[k]))
            scores[k] = scores.get(k, 0) - idf * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size / mean))
    return scores


def test_text_search(spark):
    docs = [("a", "nematode embryonic", "x y"), ("b", "embryo nematode", "nematode"), ("c", "Embryó", None), ("d", "other words here", "lung"), ("e", "", "lungs lung"), ("f", "w", "nematode embryo")]
    rows = spark.createDataFrame([("o", *x) for x in docs], "ontology_id string, term_key string, title string, synonyms string")
    plain = [(k, [t.lower().replace("ó", "o").split() for t in (x or "", y or "")]) for k, x, y in docs]
    q = spark.createDataFrame([(1, "nematode embryo"), (2, "nematode_embryo"), (3, "lung lung"), (4, None), (5, "l")], "query_id int, label string")
    got = {}
    for r in fts.search(q, rows, ["title", "synonyms"]).collect():
        got.setdefault(r["query_id"], {})[r["term_key"]] = r["score"]
    for qid, phrases in ((1, [["nematode"], ["embryo"]]), (2, [["nematode", "embryo"]]), (3, [["lung"], ["lung"]]), (5, [["l"]])):
        assert got[qid] == pytest.approx(bm25(plain, phrases))
    assert set(got[2]) == {"a", "f"} and 4 not in got
    exact = spark.createDataFrame([(1, "o", "z", 1)], "query_id int, ontology_id string, term_key string, position int")
    kinds = {(r["query_id"], r["match_type"]) for r in fts.exact_or_text(exact, fts.search(q, rows, ["title", "synonyms"])).collect()}
    assert kinds == {(1, "exact"), (2, "fts"), (3, "fts"), (5, "fts")}
