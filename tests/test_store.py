"""Stored indexes, registries, caches and the composed operator on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import catalog, fts, harmonize, provider, registry, store, vector
from tessera.sources import ontology


def parts(spark, name, titles):
    terms = spark.createDataFrame([(name, f"{name}{k}", t) for k, t in enumerate(titles)], "ontology_id string, term_key string, title string")
    entries = terms.select("ontology_id", F.lit("label").alias("index_name"), F.lit(0).alias("index_rank"), F.lower("title").alias("lookup_key"), "term_key")
    return terms, entries, terms


def sources(spark, rows):
    return spark.createDataFrame(rows, "ontology_id string, path string, size long, mtime_ns long, kind string")


def test_store_lifecycle(spark, tmp_path):
    folder = str(tmp_path / "store")
    titles = {"a": ["lung cell", "skin"], "b": ["lung"], "c": ["bone"]}

    def load(name):
        if name == "bad":
            raise ValueError("no such file\nmore")
        return parts(spark, name, titles[name])

    now = sources(spark, [(n, f"/{n}", 1, 1, "json") for n in ("a", "b", "c", "bad")])
    report = {r["ontology_id"]: (r["ordinal"], r["status"], r["error"]) for r in store.refresh(spark, folder, now, load, ["title"], first=["c"]).collect()}
    assert report == {"c": (0, "built", None), "a": (1, "built", None), "b": (2, "built", None), "bad": (3, "failed", "no such file")}
    asked = spark.createDataFrame([(1, "lung"), (2, "none")], "query_id int, label string")
    search = lambda: {(r["ontology_id"], r["term_key"]): r["score"] for r in fts.search_index(asked, *store.text_index(spark, folder)).collect()}
    whole = parts(spark, "a", titles["a"])[0].unionByName(parts(spark, "b", titles["b"])[0]).unionByName(parts(spark, "c", titles["c"])[0])
    assert search() == {(r["ontology_id"], r["term_key"]): r["score"] for r in fts.search(asked, whole, ["title"]).collect()} and set(search()) == {("a", "a0"), ("b", "b0")}
    titles["a"] = ["skin"]
    later = sources(spark, [("a", "/a", 2, 1, "json"), ("c", "/c", 1, 1, "json")])
    report = {r["ontology_id"]: r["status"] for r in store.refresh(spark, folder, later, load, ["title"], force=["c"]).collect()}
    assert report == {"a": "built", "b": "gone", "c": "built"} and search() == {}
    assert {tuple(r) for r in store.read(spark, folder, "terms").select("ontology_id", "title").collect()} == {("a", "skin"), ("c", "bone")}
    assert {r["status"]: r["n"] for r in store.status_counts(store.refresh(spark, folder, later, load, ["title"])).collect()} == {"fresh": 2}
    assert store.remove(spark, folder, ["c", "zzz"]) == ["c"] and store.remove(spark, folder, ["c"]) == []
    with pytest.raises(KeyError):
        store.refresh(spark, folder, later, load, ["title"], force=["zzz"])
    assert not store.backfill_text(spark, folder, whole, ["title"]) and store.backfill_text(spark, str(tmp_path / "new"), whole, ["title"])


def test_vector_manifest_and_errors(spark, tmp_path):
    folder = str(tmp_path / "v")
    m = "ontology_id string, path string, size long, mtime_ns long, model string, dimensions int, chunk_schema int, index_path string"
    manifest = spark.createDataFrame([("a", "/a", 1, 1, "m", 2, 1, "/i")], m)
    assert [r["status"] for r in store.stale_vectors(manifest, spark, folder).collect()] == ["new"]
    v = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("a", "y", [0.0, 1.0]), ("a", "z", [2.0, 0.0]), ("b", "w", [1.0])], "ontology_id string, term_key string, vector array<double>")
    store.write_vectors(folder, v.filter("ontology_id = 'a'"), manifest)
    assert [r["status"] for r in store.stale_vectors(manifest, spark, folder).collect()] == ["fresh"]
    assert [r["status"] for r in store.stale_vectors(manifest.withColumn("model", F.lit("other")), spark, folder).collect()] == ["changed"]
    hits, errors = vector.search_many(spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>"), v, ["a", "b", "none"], 2, k=2)
    assert [(r["term_key"], round(r["score"], 6)) for r in hits.orderBy("position").collect()] == [("x", 1.0), ("z", 1.0)] and [r["ontology_id"] for r in errors.collect()] == ["b"]


def test_search_with_relatives(spark):
    from tessera.operators import graph

    v = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("a", "y", [0.9, 0.1]), ("a", "p", [0.0, 1.0]), ("b", "w", [1.0])], "ontology_id string, term_key string, vector array<double>")
    links = spark.createDataFrame([("a", "x", "p"), ("a", "y", "p")], "ontology_id string, child string, parent string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<double>")
    hits, errors, found = graph.search_many(q, v, links, ["a", "b"], 2, k=3, parent_depth=1)
    assert [r["term_key"] for r in hits.orderBy("position").collect()] == ["x", "y", "p"] and errors.count() == 1
    assert {(r["seed"], r["relation"], r["term_key"]) for r in found.collect()} == {("x", "parent", "p"), ("y", "parent", "p")}
    assert graph.search_many(q, v, links, [], 2)[2] is None and graph.search_many(q, v, links, [], 2)[0].count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([("o", f"t{k}", [float(k % 3), 1.0]) for k in range(12)], "ontology_id string, term_key string, vector array<double>").repartition(3)
    q = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "query_id int, vector array<double>")
    want = sorted((r["query_id"], r["position"], r["term_key"]) for r in vector.top_k(q, v, 3).collect())
    monkeypatch.setattr(vector, "QUERY_BYTES", 40)
    monkeypatch.setattr(vector, "_ROWS", 2)
    assert sorted((r["query_id"], r["position"], r["term_key"]) for r in vector.top_k(q, v, 3).collect()) == want and want[0] == (0, 1, "t0") and len(want) == 27


def test_registry(spark):
    f = "field_id string, canonical string, aliases array<string>, description string, review_status string"
    empty = spark.createDataFrame([], f + ", created_at timestamp, updated_at timestamp")
    fields, rejected = registry.put_fields(empty, spark.createDataFrame([("Tissue", "tissue", ["Site"], "d", None), (" ", "x", [], None, None)], f), "2026-01-01 00:00:00")
    assert [r["field_id"] for r in fields.collect()] == ["tissue"] and [r["reason"] for r in rejected.collect()] == ["empty id"]
    new = spark.createDataFrame([("tissue", "t", [], "", "reviewed"), ("organ", "o", ["SITE "], "", None), ("age", "a", None, "", "odd"), ("dose", "dose", ["amount"], "", "reviewed")], f)
    more, rejected = registry.put_fields(fields, new, "2026-01-02 00:00:00")
    assert {r["field_id"]: r["reason"] for r in rejected.collect()} == {"tissue": "exists", "organ": "alias taken: site", "age": "unknown status"}
    again, _ = registry.put_fields(more, new.filter("field_id = 'tissue'"), "2026-01-03 00:00:00", replace=True)
    kept = again.filter("field_id = 'tissue'").first()
    assert (str(kept["created_at"])[:10], str(kept["updated_at"])[:10], kept["review_status"]) == ("2026-01-01", "2026-01-03", "reviewed")
    assert [r["field_id"] for r in registry.list_fields(more, "reviewed").collect()] == ["dose"] and registry.remove_fields(more, ["TISSUE"]).count() == 1
    changed = registry.set_review_status(more, spark.createDataFrame([("Dose", "rejected"), ("none", "reviewed"), ("tissue", "odd")], "field_id string, review_status string"), "2026-02-01 00:00:00")
    assert {r["field_id"]: r["review_status"] for r in changed.collect()} == {"tissue": "unreviewed", "dose": "rejected"}
    assert {tuple(r) for r in registry.aliases(more).collect()} == {("tissue", "tissue"), ("site", "tissue"), ("dose", "dose"), ("amount", "dose")}
    assert {tuple(r) for r in registry.field_view(more).select("label", "description").collect()} == {("tissue", "d"), ("dose", "")}
    names = spark.createDataFrame([("a",), ("z",), (None,)], "ontology_id string")
    assert [r[0] for r in registry.unknown_names(names, names.filter("ontology_id = 'a'")).collect()] == ["z"]
    pair = spark.createDataFrame([(["A:1", None], ["a:1 "]), (["b"], [])], "x array<string>, y array<string>")
    assert [r[0] for r in pair.select(registry.same_term("x", "y")).collect()] == [True, False]


def test_harmonize(spark):
    doc = {"series": {"title": "S"}, "sample": [{"channel": [{"source": "Lung", "characteristics": [{"tag": "site of tissue", "value": "lung"}, {"tag": "x", "value": "kidny"}]}, {"source": "Lung"}]}]}
    records = spark.createDataFrame([(1, json.dumps(doc)), (2, "{cut"), (3, None)], "record_id long, metadata string").withColumn("id", F.lit("clash"))
    terms = spark.createDataFrame([("o", "t1", "Lung   organ", "O:1", None, None), ("o", "t2", "kidney", None, "O:2", None)], "ontology_id string, term_key string, title string, accession string, id string, iri string")
    entries = spark.createDataFrame([("o", "label", 0, "lung", "t1", 0)], "ontology_id string, index_name string, index_rank int, lookup_key string, term_key string, source_order long")
    fields = spark.createDataFrame([("f1", "tissue", ["site of tissue", "source"], 0)], "field_id string, canonical string, aliases array<string>, ordinal int")
    text_hits = lambda labels: labels.select("label", F.lit("o").alias("ontology_id"), F.lit("t2").alias("term_key"), F.lit(-1.0).alias("score"))
    documents, found = harmonize.harmonize(records, entries, terms, fields, text_hits)
    got = {(r["pre_hz_field"], r["pre_hz_label"]): (r["n_occurrences"], r["hz_field"], r["hz_label"], r["term_id"], r["match_type"]) for r in found.collect()}
    assert got == {("source", "Lung"): (2, "tissue", "Lung organ", "O:1", "exact"), ("site of tissue", "lung"): (1, "tissue", "Lung organ", "O:1", "exact"), ("x", "kidny"): (1, "x", "kidney", "O:2", "fts")}
    texts = {r["record_id"]: r["metadata"] for r in documents.collect()}
    channels = json.loads(texts[1])["sample"][0]["channel"]
    assert channels[1] == {"source": "Lung", "hz_tissue": "Lung organ", "hz_tissue_id": "O:1", "hz_tissue_onto": "o"}
    assert {"tag": "hz_x", "value": "kidney"} in channels[0]["characteristics"] and texts[2] == "{cut" and texts[3] is None
    plain, _ = harmonize.harmonize(records, entries.limit(0), terms, fields.limit(0), specs=[("/sample/0/channel/0/source", "field_value")])
    assert json.loads({r["record_id"]: r["metadata"] for r in plain.collect()}[1])["sample"][0]["channel"][0]["hz_source"] == "lung"
    assert harmonize.harmonize(records.limit(0), entries, terms, fields)[0].count() == 0
    view = harmonize.semantic_view(found).first()
    assert view["field_view"]["field"] == view["pre_hz_field"] and view["label_view"]["label"] == view["hz_label"]
    hits = spark.createDataFrame([([{"t": 1}],)], "hits array<struct<t: int>>")
    assert harmonize.stamped(hits, "o").first()["hits"][0]["ontology_id"] == "o"


def test_cache_lifecycle(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda *r: spark.createDataFrame([r], "provider string, key string, payload string, t string").select("provider", "key", "payload", F.to_timestamp("t").alias("created_at"))
    for r in (("p", "k", "old", "2026-01-01 00:00:00"), ("p", "k", "new", "2026-01-01 00:01:00"), ("q", "k", "x", "2026-01-01 00:00:30")):
        catalog.cache_put(path, row(*r))
    live = lambda: {(r["provider"], r["payload"]) for r in catalog.cached(catalog.cache_read(spark, path), ["provider", "key"], "2026-01-01 00:01:10", 60).collect()}
    assert live() == {("p", "new"), ("q", "x")}
    catalog.cache_clear(spark, path, compact=True)
    assert live() == {("p", "new"), ("q", "x")} and catalog.cache_read(spark, path).count() == 2
    catalog.cache_clear(spark, path, "p")
    assert live() == {("q", "x")}
    catalog.write_report(row("p", "k", None, "2026-01-01 00:00:00").drop("created_at"), str(tmp_path / "report"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "report")).collect()] == [{"key": "k", "payload": None, "provider": "p"}]


def test_replies_and_inputs(spark, tmp_path):
    r = spark.createDataFrame([('{"a": 1}',), (" [1] ",), ("3",), ("{a",), (None,)], "reply string")
    assert [tuple(x) for x in catalog.replies(r).select("reply_kind", "reply_error").collect()] == [("object", None), ("array", None), (None, "neither object nor list"), (None, "not JSON"), (None, "empty")]
    (tmp_path / "in.txt").write_text("from\nfile")
    given = spark.createDataFrame([(1, "value", None), (2, "value", str(tmp_path / "in.txt"))], "id int, value string, file string")
    assert {x["id"]: x["text"] for x in catalog.given_texts(given, spark).collect()} == {1: "value", 2: "from\nfile"}
    meta = spark.createDataFrame([("o", '{"config": {"title": "T", "version": "1"}, "numberOfTerms": 5}'), ("p", "[]")], "ontology_id string, payload string")
    assert {tuple(x) for x in provider.ontology_metadata(meta).collect()} == {("o", "T", "1", None, 5), ("p", None, None, None, None)}
    with pytest.raises(ValueError):
        provider.check_settings(max_queries=4)
    words = spark.createDataFrame([("Straße",), ("STRASSE",), ("x",)], "w string")
    assert [x[0] for x in words.select(text.folded_case(F.col("w"))).collect()] == ["strasse", "strasse", "x"]


def test_streamed_lookup_maps(spark, tmp_path, monkeypatch):
    doc = {"extra": [1, {"terms": 2}], "ontology": {"id": "o"}, "terms": {"label": {f"k{n}": [{"iri": "é" * n, "n": n}, n] for n in range(50)}, "other": {"x": 1}, "iri": {"I": {"a": 1}}, "id": {}}, "z": 12345}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1, ensure_ascii=False), encoding="utf-8")
    want = [("o", "label", 0, f"k{n}", json.dumps(x, ensure_ascii=False), i) for n in range(50) for i, x in enumerate(doc["terms"]["label"][f"k{n}"])] + [("o", "iri", 3, "I", '{"a": 1}', 0)]
    real = ontology._Text.__init__
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(ontology._Text, "__init__", lambda self, path, size=size: real(self, path, size))  # noqa: B023
        assert list(ontology.lookup_rows_of(str(tmp_path / "a.json"))) == want


def test_lookup_maps_of_terms(spark):
    terms = spark.createDataFrame([("i1", "A:1", "lung"), ("i2", "A:1", "lung"), ("i3", None, None)], "iri string, accession string, title string")
    labels, ids = ontology.lookup_maps(terms)
    assert [tuple(r) for r in labels.collect()] == [("lung", ["i1", "i2"])]
    assert {tuple(r) for r in ids.collect()} == {("accession", "A:1", "i2"), ("iri", "i1", "i1"), ("iri", "i2", "i2"), ("iri", "i3", "i3")}
