"""Problems 3, 4 and 6 against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import json
import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tessera.operators import hierarchy, nested, wide

T = "subject string, predicate string, object_type string, object_value string, language string, datatype string, staged_at timestamp"
NS = [("rdf", "http://r#"), ("owl", "http://o#"), ("xsd", "http://x#"), ("attr", "http://a/")]


def triples(spark, rows):
    return spark.createDataFrame([(s, p, k, v, "", d, None) for s, p, k, v, d in rows], T)


def prefixes(spark):
    return spark.createDataFrame(NS, "prefix string, namespace string")


def test_wide_cells(spark):
    cls = [(s, "rdf:type", "uri", v, "") for s, v in (("A", "owl:Class"), ("B", "http://o#Class"), ("C", "owl:Axiom"))]
    rows = cls + [
        ("A", "attr:n", "literal", " +12 ", "xsd:integer"), ("A", "http://a/n", "literal", "-3", "http://x#integer"), ("A", "attr:n", "literal", "1.5", "xsd:integer"), ("A", "attr:n", "literal", "7", ""),
        ("A", "attr:d", "literal", "340.0540", "xsd:decimal"), ("A", "attr:b", "literal", "TRUE", "xsd:boolean"), ("A", "attr:b", "literal", "0", "xsd:boolean"),
        ("B", "attr:t", "literal", "2020-02-30", "xsd:date"), ("B", "attr:t", "literal", "2020-02-29", "xsd:date"), ("B", "attr:u", "literal", "2020-01-01T00:30:00+01:00", "xsd:dateTime"), ("B", "attr:u", "literal", "2020-01-01T00:00:00", ""),
        ("C", "attr:n", "literal", "1", "xsd:integer"), (None, "attr:n", "literal", "1", "xsd:integer"), ("A", None, "literal", "1", "xsd:integer"), ("A", "attr:n", "literal", None, "xsd:integer"), ("B", "attr:free", "literal", "x", "xsd:string")]
    for keep in ("smallest",):
        made, attributes = wide.wide_table(triples(spark, rows + rows).withColumn("is_class", F.lit(9)), prefixes(spark), keep)
        got = {tuple(r) for r in wide.cells(made, attributes).collect()}
    assert got == {("A", "n", "-3"), ("A", "d", "340.054"), ("A", "b", "false"), ("B", "t", "2020-02-29"), ("B", "u", "2019-12-31T23:30:00Z")}
    typed = wide.typed(made, attributes)
    assert dict(typed.dtypes)["n"] == "decimal(38,0)" and dict(typed.dtypes)["u"] == "timestamp" and typed.count() == 2


def test_wide_latest(spark):
    df = spark.createDataFrame([("A", "rdf:type", "uri", "owl:Class", "", "", "2020-01-01"), ("A", "attr:n", "literal", "1", "", "xsd:integer", "2020-01-02"), ("A", "attr:n", "literal", "5", "", "xsd:integer", "2020-03-02")], T.replace("staged_at timestamp", "s string"))
    df = df.withColumn("staged_at", F.to_timestamp("s")).drop("s")
    assert wide.typed(*wide.wide_table(df, prefixes(spark), "latest")).first()["n"] == 5


def test_late_batches_in_any_order_agree(spark):
    r = random.Random(3)
    names = wide.namespaces_of(prefixes(spark))
    rows = [(f"s{k}", "rdf:type", "uri", "owl:Class", "", "", "2020-01-01") for k in range(12)]
    rows += [(f"s{r.randrange(15)}", f"attr:{r.choice('nm')}", "literal", str(r.randrange(-9, 9)), "", "xsd:integer", f"2020-0{r.randrange(1, 5)}-0{r.randrange(1, 9)}") for _ in range(200)]
    df = spark.createDataFrame(rows, T.replace("staged_at timestamp", "s string")).withColumn("staged_at", F.to_timestamp("s")).drop("s")
    full = wide.full_names(df, names).cache()
    attributes = wide.attributes_of(full.filter("object_type = 'literal'"))
    batches = [full.filter(F.month("staged_at") == m) for m in (1, 2, 3, 4)]
    for rule in wide.RULES:
        want = sorted(map(tuple, wide.cells(*wide.wide_table(df, prefixes(spark), rule)).collect()))
        for order in ((0, 1, 2, 3), (3, 1, 0, 2, 1)):  # in order; late, and one batch twice
            state = None
            for k in order:
                state = wide.upsert(state, wide.delta(batches[k], attributes, names, rule), buckets=4)
            assert sorted(map(tuple, wide.cells(wide.classes(state), attributes).collect())) == want and len(want) > 15
    plan = wide.compact(wide.write_run(wide.delta(full, attributes, names), "run", 4))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rejected(spark):
    rows = [("A", "attr:n", "literal", v, "xsd:integer") for v in ("1", "x", "x", "9" * 40)] + [("A", "attr:t", "literal", "free", "")]
    assert {(r["kind"], r["object_value"]) for r in wide.rejected(triples(spark, rows), prefixes(spark)).collect()} == {("integer", "x"), ("integer", "9" * 40)}


def test_wide_clash_and_empty(spark):
    rows = [("A", "rdf:type", "uri", "owl:Class", ""), ("A", "attr:n", "literal", "1", "xsd:integer"), ("A", "http://other#n", "literal", "x", "")]
    made, attributes = wide.wide_table(triples(spark, rows), prefixes(spark))
    assert wide.typed(made, attributes).columns == ["subject", "n", "n_2"]
    made, attributes = wide.wide_table(triples(spark, []), prefixes(spark))
    assert wide.cells(made, attributes).count() == 0


json_value = st.recursive(st.none() | st.booleans() | st.integers(-99, 99) | st.text(max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["tag", "value", "a/b", "s~t", "sample", "channel"]), c, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(json_value, st.sampled_from([None, 1]))
def test_stream_parser(value, indent):
    text = json.dumps(value, indent=indent)
    kinds = {dict: "object", list: "array", str: "string", int: "number", bool: "boolean", type(None): "null"}
    want = []

    def walk(x, path):
        want.append((path, kinds[type(x)]))
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            walk(v, f"{path}/{nested.escape(str(k))}")

    walk(value, "")
    assert [(p, k) for p, k, _ in nested.triples_of(text)] == want
    assert nested.triples_of(text + " x") == [] and nested.triples_of(text[:-1]) == [] or isinstance(value, int)


def test_parser_edges():
    assert nested.triples_of(None) == nested.triples_of("") == nested.triples_of("[1,]") == nested.triples_of('{"a" 1}') == nested.triples_of("nul") == nested.triples_of('{"a":1') == []
    assert nested.triples_of("[" * 3000 + "]" * 3000)[-1][0] == "/0" * 2999
    assert [t[2] for t in nested.triples_of('{"a":1,"a":{"b":"x"}}')] == [None, None, "x"]
    assert nested.triples_of("1.5e3")[0] == ("", "number", "1.5e3")


def test_flat_items(spark):
    doc = {"series": [{"accession": "G", "title": "T"}, {}], "sample": [{"channel": [
        {"organism": {"value": "h"}, "characteristics": [{"tag": "a", "value": 1, "unit": "h"}, {"name": "g", "a/b": [{"tag": "x", "value": None}, {"tag": "y", "value": False}]}, "note", {"tag": {"v": 1}, "value": "z"}]},
        {"organism": [{"value": "m", "taxid": "9"}, {"taxid": "1"}], "characteristics": None}], "supplement": [{"tag": "f", "value": "v"}]}], "protocol": {"tag": "p", "value": "q"}}
    rows = [(1, json.dumps(doc), 5), (2, json.dumps([doc, {"sample": "odd"}]), 5), (3, json.dumps(doc)[:-1], 5), (4, None, 5), (5, "", 5), (6, "[]", 5)]
    df = spark.createDataFrame(rows, "record_id long, metadata string, sample int")
    items = nested.flat_items(df, entities=("series", "organism", "characteristic"))
    got = sorted((r["record_id"], r["item_path"]) for r in items.collect())
    one = ["/sample/0/channel/0/characteristics/0", "/sample/0/channel/0/characteristics/1/a~1b/1", "/sample/0/channel/0/organism", "/sample/0/channel/1/organism/0", "/series/0", "/series/1"]
    assert got == sorted([(1, p) for p in one] + [(2, "/0" + p) for p in one])
    c = nested.flat_table(items, "characteristic").filter("record_id = 2 and tag = 'y'").first()
    assert (c["package"], c["sample"], c["channel"], c["value"], c["parent_path"]) == (0, 0, 0, "false", "/0/sample/0/channel/0/characteristics/1/a~1b")
    assert nested.flat_items(df.limit(0)).count() == 0 and nested.flat_table(nested.flat_items(df.limit(0)), "sample").columns == ["record_id", "item_path", "package", "package_path", "sample", "parent_path"]
    everything = nested.flat_items(df).cache()
    assert nested.members(everything, "characteristic") == ["tag", "unit", "value"] and nested.members(everything, "organism") == ["taxid", "value"]
    assert {r["entity"] for r in everything.collect()} == {"package", "series", "sample", "channel", "organism", "characteristic", "/sample/channel/characteristics", "/sample/channel/characteristics/a~1b", "/sample/channel/characteristics/tag", "/sample/channel/organism", "/sample/supplement", "/protocol"}
    for r in everything.filter("record_id = 2 and item_path <> package_path").collect():  # links lead to rows
        assert r["parent_path"] in {x["item_path"] for x in everything.filter("record_id = 2").collect()} or r["entity"] == "characteristic"
    clash = nested.flat_items(spark.createDataFrame([(1, '{"sample": [{"sample": 1, "Title": "a", "title": "b", "package": {"x": [1, [2, null]]}}]}')], "record_id long, metadata string"))
    assert nested.flat_table(clash, "sample").columns[-3:] == ["Title", "sample_2", "title_2"]
    assert sorted((r["item_path"], r["cells"][""]) for r in clash.filter("entity = '/sample/package/x'").collect()) == [("/sample/0/package/x/0", "1"), ("/sample/0/package/x/1/0", "2")]


@settings(max_examples=150, deadline=None)
@given(json_value)
def test_no_scalar_is_lost(value):
    want = []

    def walk(x, path):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
            walk(v, f"{path}/{nested.escape(str(k))}")
        if x is not None and not isinstance(x, (dict, list)):
            want.append(path)

    walk(value, "")
    got = [path if name == "" and (path, kinds[path]) != (path, "object") else f"{path}/{nested.escape(name)}" for kinds in [{p: k for p, k, _ in nested.triples_of(json.dumps(value))}] for _, path, *_, cells in nested.items_of(json.dumps(value)) for name, _ in cells]
    assert sorted(got) == sorted(want)


def climb(links):
    out = {}
    for n in links:
        path, seen = [n], {n}
        while links[path[-1]] is not None:
            p = links[path[-1]]
            if p in seen:
                path = None
                break
            seen.add(p)
            path.append(p)
        out[n] = ("", -1, []) if path is None else (path[-1], len(path) - 1, path[::-1])
    return out


def test_hierarchy_random(spark):
    r = random.Random(5)
    links = {}
    for k in range(400):
        links[f"n{k}"] = None if k == 0 or r.random() < 0.02 else "n0" if r.random() < 0.3 else f"n{max(0, k - r.randint(1, 9))}"
    for k in range(60):  # a long chain
        links[f"c{k}"] = f"c{k - 1}" if k else "n5"
    for size in (1, 2, 3, 9, 40):  # cycles and what is below them
        for k in range(size):
            links[f"y{size}-{k}"] = f"y{size}-{(k + 1) % size}"
        links[f"below{size}"] = f"y{size}-0"
    want = climb(links)
    got = hierarchy.hierarchy(spark.createDataFrame(list(links.items()), "id string, parent string")).cache()
    assert {x["id"]: (x["root"], x["depth"], x["path"]) for x in got.collect()} == want
    down = {tuple(x) for x in hierarchy.descendants(got).collect()}
    assert down == {(a, n, len(p) - 1 - i) for n, (_, _, p) in want.items() for i, a in enumerate(p[:-1])}
    places = {x["id"]: (x["first"], x["last"]) for x in hierarchy.subtrees(got).collect()}
    assert {(a, b) for a, (x, y) in places.items() for b, (z, _) in places.items() if x < z <= y} == {(a, n) for a, n, _ in down}


def test_hierarchy_links(spark):
    terms = spark.createDataFrame([("o", k) for k in "abcd"] + [("o", None)], "ontology_id string, term_key string")
    entries = spark.createDataFrame([("o", "id", "A", "a"), ("o", "iri", "A", "a"), ("o", "label", "B", "b"), ("x", "id", "B", "b"), ("o", "id", "C", "c"), ("o", "id", "Z", "gone")], "ontology_id string, index_name string, lookup_key string, term_key string")
    refs = spark.createDataFrame([("o", "b", "A"), ("o", "b", "A"), ("o", "c", "C"), ("o", "a", "B"), ("o", "d", "Z"), ("o", "d", None), ("o", "q", "A")], "ontology_id string, child_term_key string, lookup_key string")
    got = {r["id"]: r["parent"] for r in hierarchy.parent_links(terms, entries, refs).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None}
    empty = hierarchy.hierarchy(spark.createDataFrame([], "id string, parent string"))
    assert empty.count() == 0
