"""How often every distinct value occurs, and in how many records (problem 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.operators.skew import skew_join
from tessera.session import staged

#: Identifiers in a block, and blocks a task keeps before it emits its fullest ones.
BLOCK, OPEN_BLOCKS = 1 << 14, 256


def dictionary(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Dense integer ids (long ``id`` from 0) for the distinct ``names`` of ``pairs``.

    The distinct values are staged by hash partition; an id is the partition's start plus the place in it. Only one
    count per partition goes to the driver.
    """
    values = staged(pairs.select(*names).distinct().withColumn("part", F.spark_partition_id()), "values")
    sizes = sorted((r["part"], r["count"]) for r in values.groupBy("part").count().collect())
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    bases = F.broadcast(pairs.sparkSession.createDataFrame(starts, "part int, base long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*names))
    return staged(values.join(bases, "part").select(*names, (F.col("base") + place - 1).alias("id")), "dictionary")


_BLOCK_ROW = "block long, at array<int>, rows array<long>, records array<long>"


def _accumulate(batches):
    """(id, occurrences, records) rows to count arrays of blocks, emitted with the places that are used."""
    open_: dict[int, list] = {}

    def out(block):
        rows, records, _ = open_.pop(block)
        used = np.nonzero(rows)[0].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([used], pa.list_(pa.int32())), pa.array([rows[used]], pa.list_(pa.int64())), pa.array([records[used]], pa.list_(pa.int64()))], ["block", "at", "rows", "records"])

    for batch in batches:
        ids, n, r = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(ids, kind="stable")
        ids, n, r = ids[order], n[order], r[order]
        cuts = [0, *(np.flatnonzero(np.diff(ids // BLOCK)) + 1).tolist(), len(ids)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            block = int(ids[i] // BLOCK)
            if block not in open_:
                open_[block] = [np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64), 0]
            at = ids[i:j] - block * BLOCK
            np.add.at(open_[block][0], at, n[i:j])
            np.add.at(open_[block][1], at, r[i:j])
            open_[block][2] += j - i
            if len(open_) > OPEN_BLOCKS:
                yield out(max(open_, key=lambda b: open_[b][2]))
    for block in list(open_):
        yield out(block)


def _summed(batches):
    """Blocks in sorted order to one (id, rows, records) row per id; one block is held at a time."""
    block, rows, records = None, None, None

    def out():
        at = np.nonzero(rows)[0]
        return pa.RecordBatch.from_arrays([pa.array(at + block * BLOCK, pa.int64()), pa.array(rows[at], pa.int64()), pa.array(records[at], pa.int64())], ["id", "n_rows", "n_records"])

    for batch in batches:
        for k, at, a, b in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if k != block:
                if block is not None:
                    yield out()
                block, rows, records = k, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
            at, a, b = (x.values.to_numpy(zero_copy_only=False) for x in (at, a, b))
            rows[at] += a
            records[at] += b
    if block is not None:
        yield out()


def value_counts(values: DataFrame, names: list[str], record: str) -> DataFrame:
    """(names, n_rows, n_records) of every distinct combination of ``names``.

    Rows are first reduced to (names, record) with their number; then the distinct values get dense ids, the pairs are
    encoded, every task adds them into count arrays of id blocks, and the arrays are summed by id range. A value in a
    third of all rows meets its id by broadcast and is one place of a block. Null values are not counted; rows without
    record count as rows only. An empty input gives an empty result.
    """
    pairs = values.dropna(subset=names).groupBy(*names, record).agg(F.count("*").alias("n"))
    pairs = staged(pairs.select(*names, "n", F.col(record).isNotNull().cast("long").alias("r")), "pairs")
    ids = dictionary(pairs, names)
    encoded = skew_join(pairs, ids, names).select("id", "n", "r")
    blocks = encoded.mapInArrow(_accumulate, _BLOCK_ROW)
    counts = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "id long, n_rows long, n_records long")
    return ids.join(counts, "id").drop("id")


def marked(counts: DataFrame, total_records: int, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """With ``mark``: rare below ``rare_below`` records, common above ``common_share`` of all records, else null."""
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > common_share * F.lit(total_records), "common")
    return counts.withColumn("mark", mark)
