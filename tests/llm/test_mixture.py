"""Problems 8 and 9: valid packings with little space left, shares that are met."""

import random

from pyspark.sql import functions as F

from tessera.llm import mixing, packing, tokens


def check(spark, sizes, capacity, slack):
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long").withColumn("key", F.lit("clash")).withColumn("val", F.lit(0))
    rows = packing.pack(df, capacity).collect()
    assert all(r["key"] == "clash" and r["val"] == 0 for r in rows)
    again = packing.pack(df.repartition(7), capacity).collect()
    assert sorted((r["doc_id"], r["piece"], r["container"]) for r in again) == sorted((r["doc_id"], r["piece"], r["container"]) for r in rows)
    filled, pieces = {}, {}
    for r in rows:
        filled[r["container"]] = filled.get(r["container"], 0) + r["piece_tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["piece_tokens"]))
    assert max(filled.values(), default=0) <= capacity
    for k, n in enumerate(sizes):
        got = [t for _, t in sorted(pieces[k])]
        assert sum(got) == (n or 0) and [p for p, _ in sorted(pieces[k])] == list(range(len(got)))
        assert len(got) == max(1, -(-(n or 0) // capacity))
    least = -(-sum(n or 0 for n in sizes) // capacity)
    assert len(filled) <= least * slack + 2, (len(filled), least)


def test_random_sizes(spark):
    r = random.Random(1)
    check(spark, [min(5000, int(r.lognormvariate(4.5, 1.2))) for _ in range(1500)] + [0], 1000, 1.03)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 40)
    r = random.Random(2)
    check(spark, [r.choice((70, 70, r.randrange(1, 100))) for _ in range(600)], 100, 1.35)


def test_ranges():
    assert packing._ranges({5: 10, 3: 60_000, 2: 120_000, 1: 4}) == [(5, 0, 1), (3, 1, 2), (2, 3, 3), (1, 6, 1)]


def test_equal_and_hard_sizes(spark):
    check(spark, [40] * 300 + [7] * 50, 100, 1.3)
    check(spark, [60] * 40 + [41] * 40, 100, 1.7)
    check(spark, [], 100, 1)
    check(spark, [0, None, 0], 100, 3)
    check(spark, [100, 250, 99], 100, 1.1)


def test_plan():
    assert packing._plan({(0, 0): 3, (1, 1): 2, (1, 0): 1, (2, 1): 5}, [0, 1, 2]) == [(1, 0, 2, 0, 0), (2, 0, 1, 1, 0), (2, 1, 2, 0, 2)]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a " * 120_000), (5, "x" * 150_000)], "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    got = {r["doc_id"]: r["tokens"] for r in tokens.token_sizes(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and 110_000 < got[4] < 130_000 and got[5] > 1000
    assert "".join(tokens.stretches("ab " * 90_000)) == "ab " * 90_000


def test_mix(spark):
    r = random.Random(2)
    docs = [(k, s, " ".join(["word"] * r.randint(5, 60)) + f" {k}") for k, s in enumerate(r.choices(["big", "mid", "small", "none"], [70, 20, 8, 2], k=900))]
    docs += [(10_000 + k, "big", docs[0][2]) for k in range(300)] + [(20_000, "mid", None), (20_001, "mid", ""), (20_002, None, "alone")]
    w = spark.createDataFrame([("big", 5.0, 1), ("mid", 3.0, 2), ("small", 2.0, 3), ("absent", 9.0, 2), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    chosen, report = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("h", F.lit(1)), w)
    rep = {x["source"]: x for x in report.collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(rep[s]["target_share"] - share) < 1e-9 and abs(rep[s]["reached_share"] - share) < 0.02
    assert rep["absent"]["tokens_used"] == 0 and abs(sum(x["reached_share"] for x in rep.values()) - 1) < 1e-9
    rows = chosen.collect()
    assert len({x["doc_id"] for x in rows}) == len(rows) and all(1 <= x["copies"] <= {"big": 1, "mid": 2, "small": 3}[x["source"]] for x in rows)
    assert sum(x["doc_id"] >= 10_000 for x in rows) == 0
    chosen, report = mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string"), w)
    assert chosen.count() == 0 and report.count() == 4


def test_stretches_change_no_count(monkeypatch):
    r = random.Random(4)
    encoding = tokens._encoding(f"{tokens.FOLDER}/{tokens.VOCABULARY}")
    monkeypatch.setattr(tokens, "_STRETCH", 20)
    for _ in range(300):
        text = "".join(r.choice(["word", "é", " ", "  ", "\n", "\n\n ", "x" * 30, "'s", "12", ".", "\t"]) for _ in range(r.randrange(60)))
        parts = tokens.stretches(text)
        assert "".join(parts) == text and sum(len(encoding.encode_ordinary(p)) for p in parts) == len(encoding.encode_ordinary(text)), text
