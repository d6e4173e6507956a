"""Mixing sources to target weights by entropy balancing (problem 9)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tessera.llm.tokens import token_sizes
from tessera.operators.skew import running_sum
from tessera.session import staged

#: Rates are rounded to this fraction of a copy, which makes the running sums exact.
UNIT = 1_000_000
#: Sources a weight table may have; they are handled on the driver.
MAX_SOURCES = 10_000


def distinct_texts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): one row per distinct non-empty text, that of its smallest doc_id.

    Equal texts are found by 128 bits of hash and counted before the shuffle, so a text in a third of all rows is no
    hot spot.
    """
    sized = token_sizes(documents.filter("text is not null").withColumn("h", F.md5("text")), ["doc_id", "source", "h"], path=path)
    first = sized.groupBy("h").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("d"))
    return first.select("d.doc_id", "d.source", "d.tokens").filter("tokens > 0")


def _tilts(histogram: DataFrame, targets: dict[str, float], caps: dict[str, int], means: dict[str, float], rounds: int = 40) -> dict[str, float]:
    """The tilt of each source: Newton steps on the convex dual, kept inside a shrinking bracket.

    A document's rate is min(cap, exp(tilt * tokens / mean)); the sums over all documents of a source are one
    distributed aggregation a round.
    """
    tilt = {s: 0.0 for s in targets}
    low, high = {s: -60.0 for s in targets}, {s: 60.0 for s in targets}
    open_ = set(targets)
    spark = histogram.sparkSession
    for _ in range(rounds):
        if not open_:
            break
        table = F.broadcast(spark.createDataFrame([(s, tilt[s], float(caps[s]), means[s]) for s in sorted(open_)], "source string, tilt double, cap double, mean double"))
        u = F.col("tilt") * F.col("tokens") / F.col("mean")
        free = u < F.log("cap")
        rate = F.when(free, F.exp(F.least(u, F.lit(50.0)))).otherwise(F.col("cap"))
        sums = histogram.join(table, "source").groupBy("source").agg(
            F.sum(F.col("n") * F.col("tokens") * rate).alias("reached"), F.sum(F.when(free, F.col("n") * F.col("tokens") ** 2 / F.col("mean") * rate).otherwise(0.0)).alias("slope"))
        for r in sums.collect():
            s, gap = r["source"], r["reached"] - targets[r["source"]]
            if abs(gap) <= 1e-7 * targets[s]:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = tilt[s]
            else:
                low[s] = tilt[s]
            step = tilt[s] - gap / r["slope"] if r["slope"] else math.inf
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    return tilt


def mix(documents: DataFrame, weights: DataFrame, budget: int | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report): how often every distinct text is used, and the shares that are reached.

    Entropy balancing: among all rates that give every source its token target, the ones closest to "every text once"
    in relative entropy, none above the source's max_repeats, are exponentially tilted by the text's tokens. The tilts
    solve the convex dual by distributed Newton steps. Rates become copies by systematic rounding in the order of source
    and size, so that a source misses its target by at most about its largest text.

    The budget (all tokens by default) is lowered to what the sources' caps can give, so that the shares can be met;
    with a given budget beyond that, short sources give what they can. Weights count relative to the sources that have
    text; a source without weight is not used, one without text is reported with share 0. A text in several
    sources belongs to that of its smallest doc_id. copies: (doc_id, source, tokens, copies) with copies >= 1; report:
    (source, target_share, tokens_used, reached_share, texts, copies_used, max_repeats, tokens_there, tokens_unused). The last
    two tell what the lowered budget costs: the tokens of the source's texts, and those of texts that are not used at all.
    """
    spark = documents.sparkSession
    rows = weights.select("source", "weight", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weight = {r["source"]: float(r["weight"] or 0) for r in rows if r["source"] is not None}
    caps = {r["source"]: int(r["max_repeats"] if r["max_repeats"] is not None else 1) for r in rows if r["source"] is not None}
    units = staged(distinct_texts(documents, path), "units")
    histogram = staged(units.groupBy("source", "tokens").agg(F.count("*").alias("n")), "histogram")
    have = {r["source"]: r for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    used = {s for s in have if weight.get(s, 0) > 0 and caps[s] > 0}
    whole = sum(weight[s] for s in used)
    share = {s: weight[s] / whole for s in used}
    total = sum(have[s]["t"] for s in used)
    most = min((caps[s] * have[s]["t"] / share[s] for s in used), default=0)
    budget = min(total, most) if budget is None else budget
    targets = {s: min(share[s] * budget, caps[s] * have[s]["t"]) for s in used}
    full = {s for s in used if targets[s] >= caps[s] * have[s]["t"] * (1 - 1e-9)}
    means = {s: have[s]["t"] / have[s]["n"] for s in used}
    tilt = _tilts(histogram, {s: targets[s] for s in used - full}, caps, means)

    plan = spark.createDataFrame([(s, tilt.get(s, 0.0), caps[s], means[s], s in full) for s in sorted(used)], "source string, tilt double, cap int, mean double, full boolean")
    rate = F.least(F.col("cap").cast("double"), F.exp(F.least(F.col("tilt") * F.col("tokens") / F.col("mean"), F.lit(50.0))))
    rate = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(rate)
    rated = units.join(F.broadcast(plan), "source").withColumn("units", F.round(rate * UNIT).cast("long")).withColumn("h", F.xxhash64("doc_id")).drop("tilt", "mean", "full")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    summed = running_sum(rated, ["source", "tokens", "h", "doc_id"], "units", "upto", parts, lambda x: staged(x, "rated"))
    copies = F.floor(F.col("upto") / F.lit(UNIT)) - F.floor((F.col("upto") - F.col("units")) / F.lit(UNIT))
    chosen = staged(summed.select("doc_id", "source", "tokens", F.least(copies, F.col("cap").cast("long")).cast("int").alias("copies")).filter("copies > 0"), "chosen")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count("*").alias("texts"), F.sum("copies").alias("copies_used"), F.sum("tokens").alias("tokens_once"))
    all_ = reached.agg(F.sum("tokens_used")).first()[0] or 0
    there = {s: int(have[s]["t"]) for s in have}
    wanted = spark.createDataFrame([(s, share.get(s, 0.0), caps[s], there.get(s, 0)) for s in sorted(weight)], "source string, target_share double, max_repeats int, tokens_there long")
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    report = wanted.join(reached, "source", "left").select("source", "target_share", n("tokens_used"), (F.coalesce("tokens_used", F.lit(0)) / F.lit(float(max(all_, 1)))).alias("reached_share"), n("texts"), n("copies_used"), "max_repeats", "tokens_there", (F.col("tokens_there") - F.coalesce("tokens_once", F.lit(0))).alias("tokens_unused"))
    return chosen, report
