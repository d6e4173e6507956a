"""Problems 2 and 5 against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import copies, frequency


def groups(spark, payloads, **extra):
    df = spark.createDataFrame(list(enumerate(payloads, 1)), "raw_id long, payload string").withColumn("copies", F.lit("clash")).withColumn("h", F.lit(1))
    return {r["raw_id"]: (r["first_id"], r["copies"]) for r in copies.copy_groups(df, "raw_id", "payload").collect()}


def test_copies(spark):
    p = ['{"a b": "X-ray 1.5", "c": "kl14+ cells"}', "c=KL14+  cells | A_B: x ray 1.5;", '{"ab":"xray 15","c":"kl14+ cells"}', '{"ab":"xray 1.5","c":"kl14- cells"}', "C : kl14+ cells; aB = xRay1.5", None, None, "", " ", '{"ab":"xray 1.5"}', '{"ab":null,"c":""}', "c=;ab=", "free text", "Free-Text"]
    got = groups(spark, p)
    assert got[1] == got[2] == got[5] == (1, 3)
    assert got[3] == (3, 1) and got[4] == (4, 1) and got[6] == (6, 1) and got[7] == (7, 1) and got[10] == (10, 1)
    assert got[8] == got[9] == (8, 2) and got[11] == got[12] == (11, 2) and got[13] == got[14] == (13, 2)
    assert groups(spark, []) == {}


def test_copies_hot_and_in_shards(spark, monkeypatch):
    monkeypatch.setattr(copies, "MAX_LOG_BITS", 12)  # shards of 256 records
    r = random.Random(1)
    p = [f'{{"v": "{k}"}}' for k in range(300)] + ['{"v": "hot"}'] * 200 + [f"v={r.randrange(400)}" for _ in range(200)]
    got = groups(spark, p)
    by = defaultdict(list)
    for k, x in enumerate(p, 1):
        by[x.strip("{}").replace('"', "").replace("v:", "").replace("v=", "").strip()].append(k)
    assert got == {k: (min(ks), len(ks)) for ks in by.values() for k in ks}


def test_full_shard_keeps_singles_apart(spark):
    """A shard is never fuller than this one, whatever the number of records: under 5 % of its singles look like repeats."""
    log_bits, singles, twice = 20, 60_000, 5_000
    rows = spark.range(singles + 2 * twice).select(F.xxhash64(F.when(F.col("id") < singles, F.col("id")).otherwise(-1 - F.col("id") % twice)).alias("h"))
    bits = copies.repeat_filter(rows, log_bits)
    h = rows.distinct().toPandas()["h"].to_numpy()
    hit = np.ones(len(h), bool)
    for at in copies._places(h, log_bits):
        hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    assert twice <= hit.sum() <= twice + 0.05 * singles


@pytest.mark.parametrize("blocks", [1, 256])
def test_counts(spark, monkeypatch, blocks):
    monkeypatch.setattr(frequency, "OPEN_BLOCKS", blocks)
    monkeypatch.setattr(frequency, "BLOCK", 16)
    r = random.Random(2)
    rows = [("f" if r.random() < 0.5 else "g", r.choice(["hot", "", None, f"v{r.randrange(150)}"]), r.choice([None, *range(40)])) for _ in range(1500)]
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "name string, value string, record int, n int")
    got = {(x["name"], x["value"]): (x["n_rows"], x["n_records"]) for x in frequency.value_counts(df, ["name", "value"], "record").collect()}
    n, s = Counter(), defaultdict(set)
    for a, b, c in rows:
        if b is not None:
            n[a, b] += 1
            s[a, b] |= {c} - {None}
    assert got == {k: (n[k], len(s[k])) for k in n}
    marks = {x["value"]: x["mark"] for x in frequency.marked(spark.createDataFrame([("a", 2), ("b", 3), ("c", 5), ("d", 6)], "value string, n_records long"), 100).collect()}
    assert marks == {"a": "rare", "b": None, "c": None, "d": "common"}


def test_counts_empty(spark):
    df = spark.createDataFrame([(None, 1)], "value string, record int")
    assert frequency.value_counts(df, ["value"], "record").count() == 0
