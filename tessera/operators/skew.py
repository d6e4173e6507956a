"""Joins and running sums that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: A key is hot with this many rows at least; below, one task carries it easily.
HOT_ROWS = 100_000
#: and with this share of all rows, so that there are at most HOT_SHARE hot keys.
HOT_SHARE = 256


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", wide: bool = False, deal: list[str] | None = None) -> DataFrame:
    """Join ``left``, in which single keys may hold a third of all rows, with a ``right`` of few rows per key.

    Rows of a hot key are dealt by a hash of the whole row, or of the columns ``deal`` that tell rows apart, to as many pieces as the key has portions of HOT_ROWS or a
    HOT_SHARE-th of all rows; its right rows are given to each piece, and everything is shuffled. Only the hot keys
    themselves are collected and broadcast: at most HOT_SHARE of them, as each holds that share of the rows. ``wide``
    says that right rows are large in memory beside their size on disk (arrays): then no side is ever broadcast.
    ``left`` is scanned up to three times, so stage it if it is costly. Null keys never match (``inner``) or are kept (``left``).
    """
    partner = right.hint("merge") if wide else right
    total = left.count()
    if total < HOT_ROWS:
        return left.join(partner, on, how)
    portion = max(HOT_ROWS, total // HOT_SHARE)
    counted = left.groupBy(*on).agg(F.ceil(F.count("*") / portion).cast("int").alias("_pieces"), F.count("*").alias("_n"))
    found = counted.filter(F.col("_n") >= portion).drop("_n").dropna(subset=on)
    keys = found.collect()
    if not keys:
        return left.join(partner, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(keys, found.schema))
    hashed = deal or [c for c, t in left.dtypes if "map<" not in t]
    dealt = left.join(hot, on).withColumn("_piece", F.pmod(F.xxhash64(*hashed), F.col("_pieces")).cast("int")).drop("_pieces")
    given = right.join(hot, on).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    split = dealt.join(given.hint("merge") if wide else given, [*on, "_piece"], how).drop("_piece")
    shuffled = left.join(hot, on, "left_anti").join(partner, on, how)
    return split.unionByName(shuffled)


def running_sum(df: DataFrame, order: list, value: str, out: str, partitions: int, stage) -> DataFrame:
    """``out``: the sum of ``value`` over all rows up to and with this one in ``order``, with no single-task sort.

    Rows are range-partitioned and staged; only one sum per partition goes to the driver.
    """
    ranged = df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged)
    sums = {r["_part"]: r["s"] for r in ranged.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    before, base = 0, []
    for part in sorted(sums):
        base.append((part, before))
        before += sums[part] or 0
    spark = df.sparkSession
    starts = F.broadcast(spark.createDataFrame(base, f"_part int, _base {dict(ranged.dtypes)[value] if dict(ranged.dtypes)[value] == 'double' else 'bigint'}"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(starts, "_part").withColumn(out, F.col("_base") + F.sum(value).over(within)).drop("_part", "_base")
