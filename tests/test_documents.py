"""Targets, write-back, catalogue and ontology readers against known results."""

import json

from pyspark.sql import functions as F

from tessera.operators import catalog, targets, writeback
from tessera.sources import ontology


def test_extraction_modes():
    doc = {"characteristics": [{"tag": "disease state", "value": "x", "sub": [{"tag": "no", "value": "no"}]}, {"tag": "tissue", "value": 3}, {"tag": "t"}], "organism": [{"value": "Homo", "taxid": "9606"}], "source": "lung", "deep": {"a": "1", "b": [{"c": True, "d": None}, "bare"]}}
    e = lambda *s: targets.extracted(doc, list(s))
    assert [(f, fp, lp) for f, _, fp, lp, _ in e(("/characteristics", "tag_value"))] == [("disease state", "/characteristics/0/tag", "/characteristics/0/value"), ("tissue", "/characteristics/1/tag", "/characteristics/1/value")]
    assert [(f, v, lp) for f, v, _, lp, _ in e(("/organism", "container_value"))] == [("organism", "Homo", "/organism/0/value")]
    nested = {"organism": [{"value": "Homo", "sub": {"value": "inner"}}, {"more": {"value": 3}}]}
    assert targets.extracted(nested, [("/organism", "container_value")]) == [("organism", "Homo", "/organism", "/organism/0/value", "/organism/0"), ("organism", 3, "/organism", "/organism/1/more/value", "/organism/1/more")]
    assert e(("/source", "field_value")) == [("source", "lung", "/source", "/source", "")]
    assert [(f, v) for f, v, *_ in e("/deep")] == [("a", "1"), ("c", True)] and e("/source") == []
    assert e(("/source", "odd"), ("/none", "scalar"), 5) == []
    assert targets.resolve({"a/b": {"c~d": [1, 2]}}, "/a~1b/c~0d/1") == 2


def test_targets(spark):
    doc = {"sample": [{"channel": [{"source": "lung", "characteristics": [{"tag": "t", "value": "v"}]}, {"source": "lung"}]}]}
    found = targets.extract_targets(spark.createDataFrame([(1, json.dumps(doc)), (2, "{"), (3, None)], "record_id long, metadata string"))
    assert [(r["id"], r["pre_hz_label_path"]) for r in found.orderBy("ordinal").collect()] == [("target-0", "/sample/0/channel/0/source"), ("target-1", "/sample/0/channel/0/characteristics/0/value"), ("target-2", "/sample/0/channel/1/source")]
    odd = spark.createDataFrame([(1, '{"sample": [{"channel": [{"source": true, "molecule": 1.50}]}]}')], "record_id long, metadata string")
    assert sorted(r["pre_hz_label"] for r in targets.extract_targets(odd).collect()) == ["1.5", "True"]
    deduped = targets.dedupe_targets(found).orderBy("id").collect()
    assert [(r["id"], r["n_occurrences"], len(r["occurrences"])) for r in deduped] == [("target-0", 2, 2), ("target-1", 1, 1)]


def test_additions(spark):
    t = spark.createDataFrame([(1, "target-0", "tissue", "lung"), (1, "target-1", "tissue", "skin")], "record_id int, id string, pre_hz_field string, pre_hz_label string")
    rows = [(0, "target-0", "Fibrosis", "disease"), (1, "target-1", "fibrosis ", "Disease"), (2, "target-0", "fibrosis", "disease"), (3, "target-9", "x", "y"), (4, "target-0", "LUNG", "Tissue"), (5, "target-0", "b", "f"), (6, "target-0", "c", "f"), (7, "target-0", "d", "f")]
    p = spark.createDataFrame([(1, *r) for r in rows], "record_id int, ordinal int, source_target_id string, label string, field_hint string")
    got = [r["outcome"] for r in targets.merged_additions(p, t).orderBy("ordinal").collect()]
    assert got == ["added", "merged", "duplicate_proposal", "unknown_source_target", "already_present", "added", "added", "per_source_limit_exceeded"]
    assert targets.pruned(t, spark.createDataFrame([(1, "target-1"), (2, "target-0")], "record_id int, target_id string")).count() == 1
    ids = targets.free_ids(t, spark.createDataFrame([(1, 5), (1, 3), (2, 1)], "record_id int, ordinal int"))
    assert {(r["record_id"], r["ordinal"]): r["id"] for r in ids.collect()} == {(1, 3): "target-2", (1, 5): "target-3", (2, 1): "target-0"}


def test_context(spark):
    x = "x" * 600
    rows = [(1, "  Fibrosis   study  ", f, v, n) for n, (f, v) in enumerate([("source", "lung tissue"), ("molecule", "total RNA"), ("organism", "Homo sapiens"), ("disease", "fibrosis"), ("protocol", "not a protocol section"), ("source", " lung  tissue")])]
    rows += [(2, "Unicode study β", "source", "lung", 0), (2, "Unicode study β", "description", x, 1), (2, "Unicode study β", "source", "lung", 2), (3, "A long study title", None, None, None), (4, None, "f", "g" * 20, 0), (4, None, "h", "i", 1), (5, None, None, "z", 0), (6, "Study", "custom", "value", 0), (6, "Study", "", "z", 1)]
    df = spark.createDataFrame(rows, "record_id int, title string, pre_hz_field string, pre_hz_label string, ordinal int")
    got = {r["record_id"]: r["context"] for r in targets.context_text(df).collect()}
    assert got[1] == "Study: Fibrosis study | source=lung tissue; molecule=total RNA; organism=Homo sapiens; disease=fibrosis; protocol=not a protocol section"
    assert got[2].startswith("Study: Unicode study β | source=lung; description=x") and got[2].endswith("x…") and len(got[2]) == 500 and got[2].count("source=lung") == 1
    assert got[3] == "Study: A long study title" and got[5] is None and got[6] == "Study: Study | custom=value"
    short = {r["record_id"]: r["context"] for r in targets.context_text(df, limit=10).collect()}
    assert short[3] == "Study: A…" and short[4] == "f=ggggggg…"


def test_write_back(spark):
    doc = {"characteristics": [{"tag": "d", "value": "x"}], "organism": [{"value": "Homo", "in": {"value": "n"}}], "a/b": {"s": "lung", "value": "v"}, "hz_organ": "text"}
    r = lambda n, fp, lp, pp, f, l, t="O:1", o="o": (1, n, fp, lp, pp, f, l, t, o)
    tag, org, mem = ("/characteristics/0/tag", "/characteristics/0/value", "/characteristics/0"), ("/organism", "/organism/0/value", "/organism/0"), ("/a~1b/s", "/a~1b/s", "/a~1b")
    rows = [r(0, *tag, "disease", "X"), r(1, *tag, "disease", "X"), r(2, *org, "organism", "H"), r(3, *org, "organism", "H"), r(4, *mem, "s", "L"), r(5, *mem, "s", "L"), r(6, *mem, "s", "M"), r(7, "/gone", "/gone", "/none", "s", "M"), r(8, *mem, None, "z"),
            r(9, "/a~1b/value", "/a~1b/value", "/a~1b", "v", "plain", None, None), r(10, "/organism", "/organism/0/in/value", "/organism/0/in", "organ", "deep", None, None), r(11, *mem, "s", "L", None, None)]
    schema = "record_id long, ordinal int, pre_hz_field_path string, pre_hz_label_path string, parent_path string, hz_field string, hz_label string, term_id string, onto string"
    records = spark.createDataFrame([(1, json.dumps(doc)), (2, "{broken"), (3, None)], "record_id long, metadata string")
    got = {x["record_id"]: x["metadata"] for x in writeback.write_back(records, spark.createDataFrame(rows, schema)).collect()}
    out = json.loads(got[1])
    assert out["characteristics"][1:] == [{"tag": "hz_disease", "value": "X"}, {"tag": "hz_disease_id", "value": "O:1"}, {"tag": "hz_disease_onto", "value": "o"}]
    assert out["hz_organism"] == [{"value": "H", "id": "O:1", "onto": "o"}] and out["hz_organ"] == [{"value": "deep"}]
    assert out["a/b"] == {"s": "lung", "value": "v", "hz_s": "L", "hz_s_id": "O:1", "hz_s_onto": "o", "hz_s_1": "M", "hz_s_id_1": "O:1", "hz_s_onto_1": "o", "hz_v": "plain"}
    assert got[2] == "{broken" and got[3] is None


def test_cache_and_manifests(spark):
    rows = spark.createDataFrame([("p", 1, "1970-01-01 00:01:40", "old"), ("p", 1, "1970-01-01 00:01:40", "old2"), ("q", 1, "1970-01-01 00:00:01", "x")], "provider string, key int, t string, v string").withColumn("created_at", F.to_timestamp("t")).drop("t")
    live = lambda now, **k: {r["v"] for r in catalog.cached(rows, ["provider", "key"], now, 60, tie="v", **k).collect()}
    assert live("1970-01-01 00:02:39") == live("1970-01-01 00:02:40") == {"old2"} and live("1970-01-01 00:02:41") == set() and live("1970-01-01 00:02:39", force=True) == set()
    m = "ontology_id string, path string, size long, mtime_ns long, kind string"
    now = spark.createDataFrame([("a", "p", 1, 1, "j"), ("b", "p", 2, 1, "j"), ("c", "p", 1, None, "j")], m)
    was = spark.createDataFrame([("b", "p", 1, 1, "j"), ("c", "p", 1, None, "j"), ("d", "p", 1, 1, "j")], m)
    assert {r["ontology_id"]: r["status"] for r in catalog.stale(now, was).collect()} == {"a": "new", "b": "changed", "c": "fresh", "d": "gone"}
    assert catalog.first_wins(rows.withColumn("n", F.monotonically_increasing_id()), ["provider"], ["n"]).count() == 2


def test_replace_partition(spark, tmp_path):
    p = str(tmp_path / "t")
    catalog.replace_partition(spark.createDataFrame([("a", 1), ("b", 2)], "ontology_id string, v int"), p)
    catalog.replace_partition(spark.createDataFrame([("a", 3)], "ontology_id string, v int"), p)
    assert {tuple(r) for r in spark.read.parquet(p).select("ontology_id", "v").collect()} == {("a", 3), ("b", 2)}


RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:o="http://www.geneontology.org/formats/oboInOwl#" xmlns:obo="http://purl.obolibrary.org/obo/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:x="http://x/">
<owl:Ontology rdf:about="http://t/onto"><owl:versionIRI rdf:resource="http://t/releases/1/o.owl"/><dc:title>Test</dc:title></owl:Ontology>
<owl:Class rdf:about="http://t/TEST_1"><rdfs:label xml:lang="en">lung</rdfs:label><obo:IAO_0000115>breathes</obo:IAO_0000115><o:id>TEST:1</o:id><o:hasExactSynonym>pulmo</o:hasExactSynonym><o:hasExactSynonym>pulmo</o:hasExactSynonym>
 <o:hasDbXref>UMLS:C0024109</o:hasDbXref><rdfs:subClassOf rdf:resource="http://t/TEST_0"/><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf><x:note>b</x:note><x:note>a</x:note></owl:Class>
<rdf:Description rdf:about="http://t/TEST_2"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#Class"/><rdfs:label>old</rdfs:label><owl:deprecated>true</owl:deprecated><obo:IAO_0100001 rdf:resource="http://t/TEST_1"/></rdf:Description>
<owl:Class><rdfs:label>anonymous</rdfs:label></owl:Class></rdf:RDF>"""


def test_rdf(spark, tmp_path):
    (tmp_path / "o.owl").write_text(RDF)
    t = ontology.read_rdf(spark, f"{tmp_path}/*.owl").cache()
    terms = {r["accession"]: r for r in ontology.owl_terms(t).collect()}
    assert set(terms) == {"TEST:1", "TEST:2"}
    one = terms["TEST:1"]
    assert (one["title"], one["parents"], one["xrefs"], one["synonyms"]["exact"], one["properties"], one["deprecated"]) == ("lung", ["TEST:0"], ["UMLS:C0024109"], ["pulmo"], {"http://x/note": ["a", "b"]}, False)
    assert terms["TEST:2"]["deprecated"] and terms["TEST:2"]["replaced_by"] == "TEST:1"
    assert sorted(map(tuple, ontology.read_rdf(spark, f"{tmp_path}/*.owl", parts=3).collect())) == sorted(map(tuple, t.collect()))
    h = ontology.header(t).first()
    assert (h["iri"], h["title"], h["version_iri"]) == ("http://t/onto", "Test", "http://t/releases/1/o.owl")


ODD = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:x="http://x/" xml:base="http://b/f" xml:lang="de">
<rdf:Description rdf:about="a" x:p="attr"><x:n rdf:nodeID="k"/><x:l rdf:parseType="Literal">t<b/></x:l><x:r rdf:parseType="Resource"><x:q xml:lang="">v</x:q></x:r><x:c rdf:parseType="Collection"><x:T rdf:about="#i"/></x:c>
 <x:e rdf:resource="http://o/1" x:w="z"/><x:m><x:T rdf:nodeID="k"/></x:m><x:d rdf:datatype="http://t/int">5</x:d><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Description></rdf:RDF>"""


def test_rdf_forms(spark, tmp_path):
    (tmp_path / "odd.owl").write_text(ODD)
    got = {t[:4] for t in ontology.triples_of_file(str(tmp_path / "odd.owl"))}
    a, rdf = "http://b/a", ontology.RDF
    assert {(a, "http://x/p", "literal", "attr"), (a, "http://x/n", "bnode", "_:k"), ("_:k", rdf + "type", "uri", "http://x/T"), (a, "http://x/m", "bnode", "_:k"), (a, "http://x/e", "uri", "http://o/1"), ("http://o/1", "http://x/w", "literal", "z"),
            (a, "http://x/d", "literal", "5"), (a, rdf + "_1", "literal", "one"), (a, rdf + "_2", "literal", "two"), ("http://b/f#i", rdf + "type", "uri", "http://x/T")} <= got
    assert sum(p == rdf + "first" and o == "http://b/f#i" for _, p, _, o in got) == 1 and sum(p == rdf + "rest" and o == rdf + "nil" for _, p, _, o in got) == 1
    assert any(p == "http://x/q" and s.startswith("_:") and o == "v" for s, p, _, o in got) and any(p == "http://x/l" and o.startswith("t<b") for _, p, _, o in got)
    assert {t[4] for t in ontology.triples_of_file(str(tmp_path / "odd.owl")) if t[1] == "http://x/p"} == {"de"}


def test_infinite_scores(spark):
    from tessera.operators import pool

    hits = spark.createDataFrame([(1, "o", 0, str(k), k, s) for k, s in enumerate([0.9, float("inf"), float("-inf"), float("nan"), 0.5, 0.4])], "query_id int, ontology_id string, framework_rank int, identity string, position int, score double")
    assert [r["identity"] for r in pool.balanced_pool(hits).orderBy("pool_rank").collect()] == ["0", "4"]
    assert pool.balanced_pool(hits, ontologies=["x"]).count() == pool.balanced_pool(hits, ontologies=[]).count() == 0 and pool.balanced_pool(hits, ontologies=["o"]).count() == 2


def test_lookup_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"ontology": {"id": "o"}, "terms": {"label": {"Oral Mucosa": [{"iri": "1"}, {"iri": "2"}]}, "id": {"X": {"iri": "1"}}}}))
    (tmp_path / "b.json").write_text('{"ontology": {}, "terms": [')
    rows = ontology.read_lookup_json(spark, str(tmp_path)).collect()
    assert sorted((r["index_name"], r["index_rank"], r["lookup_key"], r["source_order"]) for r in rows) == [("id", 1, "X", 0), ("label", 0, "Oral Mucosa", 0), ("label", 0, "Oral Mucosa", 1)]
    assert {r["file"].rsplit("/", 1)[1]: r["ok"] for r in ontology.valid_files(spark, str(tmp_path)).collect()} == {"a.json": True, "b.json": False}
