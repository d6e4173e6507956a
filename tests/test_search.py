"""Text search by parts of the index: results against brute force, and what it shuffles."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import fts, harmonize
from tessera.plans import curation
from test_retrieval import bm25


def shuffled(spark, made) -> int:
    """Records that the stages of ``made``() write for others."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    def total():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    made()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return total() - before


TERM = "ontology_id string, term_key string, title string, note string"


def test_search_brute(spark, monkeypatch):
    r = random.Random(7)
    words = ["lung", "lungs", "lu", "cell", "cells", "b", "bone", "x1"]
    text = lambda n: " ".join(r.choices(words, k=r.randint(0, n)))
    docs = [(f"o{k % 2}", f"t{k:03}", text(5), text(3)) for k in range(60)]
    queries = [(k, " ".join(r.choice(words) + ("_" + r.choice(words) if r.random() < 0.4 else "") for _ in range(r.randint(1, 3)))) for k in range(40)] + [(100, None), (101, "none here"), (102, "?")]
    plain = [((o, t), [a.split(), b.split()]) for o, t, a, b in docs]
    rows, asked = spark.createDataFrame(docs, TERM), spark.createDataFrame(queries, "query_id int, label string")
    for name, value in (("BLOCK_TOKENS", fts.BLOCK_TOKENS), ("BLOCK_TOKENS", 20), ("QUERY_BYTES", 400), ("HIT_BYTES", 10)):
        monkeypatch.setattr(fts, name, value)
        got = {}
        for x in fts.search(asked, rows, ["title", "note"], top=4).collect():
            got.setdefault(x["query_id"], {}).setdefault(x["ontology_id"], {})[x["position"]] = (x["term_key"], x["score"])
        for k, label in queries[:40]:
            want = bm25(plain, [w.split("_") for w in label.split()])
            for o in ("o0", "o1"):
                best = sorted((round(s, 9), t) for (oo, t), s in want.items() if oo == o)[:4]
                assert [got.get(k, {}).get(o, {})[i + 1][0] for i in range(len(best))] == [t for _, t in best]
                assert [got.get(k, {}).get(o, {})[i + 1][1] for i in range(len(best))] == pytest.approx([want[o, t] for _, t in best])
                assert len(got.get(k, {}).get(o, {})) == len(best)
        assert not {100, 101, 102} & set(got)


def test_search_many_ids_and_none(spark, monkeypatch):
    monkeypatch.setattr(fts, "_IDS", 3)
    monkeypatch.setattr(fts, "_ROWS", 5)
    rows = spark.createDataFrame([("o", "a", "lung cell", ""), ("o", "b", "lung", ""), ("o", None, "lung", ""), (None, "c", "lung", "")], TERM)
    asked = spark.createDataFrame([(f"q{k}", "cell lung" if k % 2 else "lung cell") for k in range(20)], "query_id string, label string")
    assert sorted((x["query_id"], x["term_key"], x["position"]) for x in fts.search(asked, rows, ["title"]).collect()) == sorted((f"q{k}", t, p) for k in range(20) for t, p in (("a", 1), ("b", 2)))
    assert fts.search(asked.limit(0), rows, ["title"]).count() == 0 and fts.search(asked, rows.limit(0), ["title"]).count() == 0


def test_common_words_are_not_shuffled(spark):
    """fts_or: every query has a word that every term has, which makes queries times terms pairs."""
    rows = spark.createDataFrame([("o", f"t{k:03}", f"disorder w{k}", "") for k in range(300)], TERM)
    asked = spark.createDataFrame([(k, f"disorder w{k}") for k in range(200)], "query_id int, label string")
    assert shuffled(spark, lambda: fts.search(asked, rows, ["title"]).collect()) < 10_000


def test_common_phrases_are_not_shuffled(spark):
    """fts_phrase: tokens of every phrase stand in every term, though few phrases do."""
    rows = spark.createDataFrame([("o", f"t{k:03}", f"deep w{k} of kind", "") for k in range(300)], TERM)
    asked = spark.createDataFrame([(k, f"deep_w{k}_of_kin") for k in range(200)], "query_id int, label string")
    found = []
    assert shuffled(spark, lambda: found.extend(fts.search(asked, rows, ["title"]).collect())) < 10_000
    assert {(x["query_id"], x["term_key"]) for x in found} == {(k, f"t{k:03}") for k in range(200)}


def test_index_is_shuffled_once_a_core(spark):
    """fts_phrase: a term is one row, and every core gets it once to count and once to score."""
    rows = spark.createDataFrame([("o", f"t{k:03}", f"deep w{k} of kind", f"note n{k}") for k in range(300)], TERM)
    asked = spark.createDataFrame([(k, f"deep_w{k}_of_kin") for k in range(200)], "query_id int, label string")
    assert shuffled(spark, lambda: fts.search(asked, rows, ["title", "note"]).collect()) < 2 * 300 * spark.sparkContext.defaultParallelism + 1000


def asked_of(monkeypatch, spark):
    """The labels and ``top`` that the plans search for."""
    calls, plain = [], fts.search_index
    monkeypatch.setattr(fts, "search_index", lambda q, p, n, label="label", top=25: calls.append(({r[0] for r in q.select(label).collect()}, top)) or plain(q, p, n, label, top))
    return calls


def test_exact_hits_are_not_searched(spark, monkeypatch, tmp_path):
    """exact_then_fts: only queries without an exact hit are searched."""
    d = str(tmp_path)
    spark.createDataFrame([(100, "Lung"), (200, "lungs cell"), (300, None), (401, "cell")], "target_id long, pre_hz_label string").write.parquet(f"{d}/targets.parquet")
    spark.createDataFrame([("o", "label", 0, "lung", "a", 0), ("o", "label", 0, "cell", "b", 1)], "ontology_id string, index_name string, index_rank int, lookup_key string, term_key string, source_order long").write.parquet(f"{d}/lookup_entries.parquet")
    spark.sql("""select 'o' as ontology_id, x as term_key, '{"title": "lung lungs cell"}' as payload, timestamp '2020-01-01 00:00:00' as indexed_at from values ('a'), ('b') as t(x)""").write.parquet(f"{d}/terms.parquet")
    calls = asked_of(monkeypatch, spark)
    got = {(r["query_id"], r["term_key"], r["match_type"]) for r in curation.exact_then_fts(spark, d).collect()}
    assert got == {(100, "a", "exact"), (200, "a", "fts"), (200, "b", "fts")} and [c[0] for c in calls] == [{"lungs cell"}]


def test_best_text_hit_of_a_label(spark):
    """harmonized_documents, harmonized_targets: scores that differ by less than 9 places are ties, which the ontology decides."""
    labels = spark.createDataFrame([("kidny",), ("lung",)], "label string")
    entries = spark.createDataFrame([("o", "label", 0, "lung", "t1", 0)], "ontology_id string, index_name string, index_rank int, lookup_key string, term_key string, source_order long")
    hits = spark.createDataFrame([("kidny", "b", "t2", -1.0 - 1e-13), ("kidny", "a", "t3", -1.0), ("kidny", "c", "t4", -0.5), ("lung", "a", "t3", -9.0)], "label string, ontology_id string, term_key string, score double")
    assert {tuple(r) for r in harmonize.chosen_terms(labels, entries, hits).collect()} == {("lung", "o", "t1", "exact"), ("kidny", "a", "t3", "fts")}


def test_one_text_hit_is_asked_for(spark, monkeypatch):
    """harmonized_documents, harmonized_targets: no more hits are made than are taken."""
    calls = asked_of(monkeypatch, spark)
    curation.harmonized_targets(spark, "/root/testdata/sf0.001")
    assert [top for _, top in calls] == [1]


def test_targets_are_staged_once(spark, monkeypatch):
    """harmonized_targets: fields and terms are chosen once a name and label, and targets with their occurrences are written once."""
    doc = {"sample": [{"channel": [{"characteristics": [{"tag": f"site {k}", "value": f"lung {k % 3}"} for k in range(10)]}]}]}
    records = spark.createDataFrame([(k, json.dumps(doc)) for k in range(50)], "record_id long, metadata string")
    entries = spark.createDataFrame([("o", "label", 0, "lung_0", "t1", 1), ("o", "label", 0, "lung_0", "t2", 0), ("a", "label", 0, "lung_0", "t3", 0)], "ontology_id string, index_name string, index_rank int, lookup_key string, term_key string, source_order long")
    terms = spark.createDataFrame([("a", "t3", "Lung  organ", "A:3"), ("o", "t1", "", "O:1")], "ontology_id string, term_key string, title string, accession string").selectExpr("*", "accession as id", "accession as iri")
    fields = spark.createDataFrame([("f1", "tissue", ["site 1"], 0)], "field_id string, canonical string, aliases array<string>, ordinal int")
    text_hits = lambda labels: labels.filter("label = 'lung 1'").select("label", F.lit("o").alias("ontology_id"), F.explode(F.array(F.lit("t2"), F.lit("t1"))).alias("term_key"), F.lit(-1.0).alias("score"))
    tables, plain = [], harmonize.staged
    monkeypatch.setattr(harmonize, "staged", lambda df, name: tables.append(plain(df, name)) or tables[-1])
    for most in (harmonize.NAMES, 0):
        monkeypatch.setattr(harmonize, "NAMES", most)
        tables.clear()
        documents, found = harmonize.harmonize(records, entries, terms, fields, text_hits)
        held = sum(t.count() for t in tables)
        got = found.select("pre_hz_field", "hz_field", "field_id", "pre_hz_label", "hz_label", "term_key", "match_type").distinct().collect()
        assert found.count() == 500 and {tuple(r) for r in got} == {
            (f"site {k}", "tissue" if k == 1 else f"site_{k}", "f1" if k == 1 else None, f"lung {k % 3}", *(("Lung organ", "t3", "exact"), ("lung_1", "t1", "fts"), ("lung_2", None, None))[k % 3]) for k in range(10)}
        assert json.loads(documents.first()["metadata"])["sample"][0]["channel"][0]["characteristics"][10:12] == [{"tag": "hz_site_0", "value": "Lung organ"}, {"tag": "hz_site_0_id", "value": "A:3"}]
        if most:
            assert held < 600  # 500 targets


def test_rare_words_decide(spark, monkeypatch):
    """harmonized_targets: terms that have only the common words of a query are not scored where they cannot be the best."""
    r = random.Random(3)
    docs = [("o", f"t{k:03}", f"{r.choice(['late', 'early'])} disorder of w{k // 2} {r.choice(['kind', 'type type'])}", "") for k in range(200)]
    asked = [(k, f"late disorder of {r.choice([f'w{k}', f'w{k} w{k + 1}', 'none'])} type") for k in range(100)]
    used, plain = [], fts._Block.likely
    monkeypatch.setattr(fts._Block, "likely", lambda self, parts, top: used.append(x := plain(self, parts, top)) or x)
    block = fts._Block(pa.table({"term_key": [d[1] for d in docs], "tokens": [d[2] for d in docs]}))
    words = lambda label: [(t, -1.0 / len(t) * n, 1.0 / len(t) * n.max()) for t, n in filter(None, map(block.hits, label.split()))]
    for top in (1, 2, 5):
        for _, label in asked:
            total = np.zeros(len(docs))
            for t, s, _ in (parts := words(label)):
                total[t] += s
            terms, score = block.best(parts, top)
            want = np.lexsort((np.arange(len(docs)), np.rint(total * 1e9)))[:top]
            assert terms.tolist() == want.tolist() and score.tolist() == pytest.approx(total[want].tolist())
    assert sum(x is not None for x in used) > 30
    monkeypatch.undo()
    got = {x["query_id"]: x["term_key"] for x in fts.search(spark.createDataFrame(asked, "query_id int, label string"), spark.createDataFrame(docs, TERM), ["title"], top=1).collect()}
    plain_docs = [(d[1], [d[2].split(), []]) for d in docs]
    for k, label in asked[:40]:
        want = bm25(plain_docs, [[w] for w in label.split()])
        assert got[k] == min(want, key=lambda t: (round(want[t], 9), t))
