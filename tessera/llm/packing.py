"""Filling containers of fixed capacity, by bulk-synchronous best fit (problem 8)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.tokens import token_sizes
from tessera.operators.skew import running_sum
from tessera.session import staged

CAPACITY = 2048
_ROW = "kind int, key long, val long, container long, part int, rank long"


#: Rows of one range, which one task sweeps.
RANGE_ROWS = 50_000


def _swept(rows, out):
    """Best fit within one range; rows (kind, key, val) by falling val, gaps before items: every item takes the smallest gap that holds it.

    Gaps are kept by size, one bit per size that has some, so an item's gap is found without looking at the others. A gap that
    took an item goes on with what is left of it. Unmatched items are ranked in order, largest first; gaps that still hold the
    smallest value of the range, and with it everything in lower ranges, are ranked smallest first.
    """
    by_size: dict[int, list[int]] = {}
    sizes = 0
    items: list[tuple[int, int, int | None]] = []
    least = 0
    for kind, key, val in rows:
        least = val
        if kind == 0:
            left, container = val, key
        else:
            fitting = sizes >> val
            if not fitting:
                items.append((key, val, None))
                continue
            size = val + (fitting & -fitting).bit_length() - 1
            container = by_size[size].pop()
            if not by_size[size]:
                sizes &= ~(1 << size)
            items.append((key, val, container))
            left = size - val
        by_size.setdefault(left, []).append(container)
        sizes |= 1 << left
    rank = 0
    for key, val, container in items:
        out.append((1, key, val, container, rank if container is None else None))
        rank += container is None
    rank = 0
    for size in sorted(by_size):
        for container in by_size[size]:
            holds = 0 < size and size >= least
            out.append((0, container, size, None, rank if holds else None))
            rank += holds


def _local(batches):
    """All ranges of a task, which come one after the other."""
    current, rows = None, []

    def flush():
        out: list[tuple] = []
        _swept(rows, out)
        for at in range(0, len(out), 50_000):
            kind, key, val, container, rank = zip(*out[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(val, pa.int64()), pa.array(container, pa.int64()), pa.array([current] * len(kind), pa.int32()), pa.array(rank, pa.int64())], ["kind", "key", "val", "container", "part", "rank"])

    for batch in batches:
        for kind, key, val, part in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if part != current:
                if rows:
                    yield from flush()
                current, rows = part, []
            rows.append((kind, key, val))
    if rows:
        yield from flush()


def _ranges(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(val, first range, ranges): ranges of about RANGE_ROWS rows over falling sizes; a size of more rows gets several by hash."""
    out, part, filled = [], 0, 0
    for val in sorted(counts, reverse=True):
        n = counts[val]
        if filled and filled + n > RANGE_ROWS:
            part, filled = part + 1, 0
        pieces = max(1, -(-n // RANGE_ROWS))
        out.append((val, part, pieces))
        if pieces > 1:
            part, filled = part + pieces, 0
        else:
            filled += n
    return out


def _plan(counts: dict[tuple[int, int], int], parts: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of unmatched items go to which ranks of gaps in higher ranges: (part, from, below, gap part, gap from).

    A sweep from the highest range down; items take the gaps of the nearest range above that has any left. At most two
    entries per range.
    """
    out, stack = [], []
    for p in parts:
        at, n = 0, counts.get((p, 1), 0)
        while at < n and stack:
            q, first, last = stack.pop()
            take = min(n - at, last - first)
            out.append((p, at, at + take, q, first))
            at += take
            if first + take < last:
                stack.append((q, first + take, last))
        if counts.get((p, 0)):
            stack.append((p, 0, counts[(p, 0)]))
    return out


def _sweep(rows: DataFrame) -> DataFrame:
    """One superstep over gaps (kind 0) and items (kind 1) with their val: the same rows after it, items with container if matched."""
    spark = rows.sparkSession
    counts = {r["val"]: r["count"] for r in rows.groupBy("val").count().collect()}  # at most one row per size
    ranges = _ranges(counts)
    table = F.broadcast(spark.createDataFrame(ranges, "val long, first int, pieces int"))
    ranged = rows.select("kind", "key", "val").join(table, "val").select("kind", "key", "val", (F.col("first") + F.pmod(F.xxhash64("key"), F.col("pieces"))).cast("int").alias("part"))
    ranged = ranged.repartition(max((a + n for _, a, n in ranges), default=1), "part").sortWithinPartitions("part", F.desc("val"), "kind", "key")
    swept = staged(ranged.mapInArrow(_local, _ROW), "swept")
    counts = {(r["part"], r["kind"]): r["count"] for r in swept.filter("rank is not null").groupBy("part", "kind").count().collect()}
    plan = _plan(counts, sorted({p for p, _ in counts}))
    if not plan:
        return swept.drop("part", "rank")
    table = F.broadcast(spark.createDataFrame(plan, "part int, start long, stop long, to_part int, to_start long"))
    free = swept.filter("kind = 1 and container is null").select("key", "val", "part", "rank")
    sent = free.join(table, "part").filter("rank >= start and rank < stop").select("key", "val", F.col("to_part").alias("part"), (F.col("to_start") + F.col("rank") - F.col("start")).alias("rank"))
    offered = swept.filter("kind = 0 and rank is not null").select(F.col("key").alias("box"), "part", "rank")
    carried = staged(sent.join(offered, ["part", "rank"]).select("key", "val", "box"), "carried")
    taken = carried.select(F.lit(0).alias("kind"), F.col("box").alias("key"), F.col("val").alias("less"), F.lit(None).cast("long").alias("into"))
    placed = carried.select(F.lit(1).alias("kind"), "key", F.lit(0).cast("long").alias("less"), F.col("box").alias("into"))
    after = swept.drop("part", "rank").join(taken.unionByName(placed), ["kind", "key"], "left")
    return staged(after.select("kind", "key", (F.col("val") - F.coalesce("less", F.lit(0))).alias("val"), F.coalesce("container", "into").alias("container")), "after")


def _opened(items: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame]:
    """(seeds, rest): as many of the largest items as containers are needed at least for all of them open one each.

    They are found by a histogram of sizes, at most ``capacity`` rows; among equal sizes by hash.
    """
    sizes = sorted(((r["val"], r["count"]) for r in items.groupBy("val").count().collect()), reverse=True)
    need = max(1, -(-sum(v * n for v, n in sizes) // capacity))
    # Items of more than half a container never share one.
    need = max(need, sum(n for v, n in sizes if 2 * v > capacity))
    at, border, missing = 0, 0, 0
    for v, n in sizes:
        if at + n > need:
            border, missing = v, need - at
            break
        at += n
    if missing == 0:
        return items.filter(F.col("val") > border), items.filter(F.col("val") <= border)
    n = dict(sizes)[border]
    chosen = F.pmod(F.xxhash64("key"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, missing / n + 3 / n))
    is_seed = (F.col("val") > border) | ((F.col("val") == border) & chosen)
    if at == 0 and missing < 50:
        first = items.filter(F.col("val") == border).select(F.min("key")).first()[0]
        is_seed = is_seed | (F.col("key") == first)
    return items.filter(is_seed), items.filter(~is_seed)


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container, <columns of sizes>, piece, piece_tokens) for sizes with a ``tokens`` column.

    Only an item larger than ``capacity`` is split: into full containers and one rest, which is packed like any item.
    Bulk-synchronous best fit: the largest items open as many containers as all items need at least. Then, in every
    superstep, items and gaps are range-sorted together by size; within a range items take the smallest gap that holds
    them, items left over take gaps of the nearest higher range, matched by rank so that no gap is given twice; gaps are
    updated, and this repeats until no item fits any gap. The items left open new containers, and so on. Ranges are cut
    by size and hash and hold about RANGE_ROWS rows, so a third of all items having one size is no hot spot; one number per
    range and a histogram of sizes are all the driver sees. Items of 0 or null tokens (null, empty texts) are put into the first container that
    exists, or container 0. Repeated rows are items of their own. The same input rows give the same packing, whatever the partitioning.
    """
    spark = sizes.sparkSession
    sizes = sizes.withColumn("tokens", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")))
    n = F.floor((F.col("tokens") + capacity - 1) / capacity)
    pieces = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1)))
    pieces = pieces.withColumn("piece_tokens", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece") * capacity))
    # Keys are places in the order of sizes and contents, so they are the same in every run; equal rows are interchangeable.
    hashed = pieces.withColumn("_one", F.lit(1).cast("long")).withColumn("_hash", F.xxhash64(*[c for c, t in pieces.dtypes if "map<" not in t]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = staged(running_sum(hashed, ["piece_tokens", "_hash"], "_one", "_key", parts, lambda x: staged(x, "ordered")).drop("_one", "_hash"), "pieces")
    items = pieces.select(F.col("_key").alias("key"), F.col("piece_tokens").alias("val"))
    homes = [items.filter(F.col("val") == capacity).select("key", F.col("key").alias("container"))]
    items = items.filter((F.col("val") > 0) & (F.col("val") < capacity))
    gaps, left = None, items.count()
    while left:
        seeds, rest = _opened(items, capacity)
        seeds = staged(seeds, "seeds")
        homes.append(seeds.select("key", F.col("key").alias("container")))
        new = seeds.select(F.lit(0).alias("kind"), "key", (capacity - F.col("val")).alias("val"))
        gaps = new if gaps is None else gaps.unionByName(new)
        rows = gaps.unionByName(rest.select(F.lit(1).alias("kind"), "key", "val"))
        while True:
            after = _sweep(rows)
            placed = after.filter("kind = 1 and container is not null").select("key", "container")
            homes.append(placed)
            items = after.filter("kind = 1 and container is null").select("key", "val")
            gaps = after.filter("kind = 0 and val > 0").select("kind", "key", "val")
            ends = after.agg(F.min(F.when((F.col("kind") == 1) & F.col("container").isNull(), F.col("val"))).alias("item"), F.max(F.when(F.col("kind") == 0, F.col("val"))).alias("gap")).first()
            if ends["item"] is None or ends["gap"] is None or ends["item"] > ends["gap"]:
                break
            # No later item is smaller than the smallest of now, so gaps below it are final.
            rows = gaps.filter(F.col("val") >= ends["item"]).unionByName(items.select(F.lit(1).alias("kind"), "key", "val"))
        left = items.count()
        if left:
            gaps = gaps.filter(F.lit(False))
    whole = homes[0]
    for h in homes[1:]:
        whole = whole.unionByName(h)
    whole = staged(whole, "homes")
    first = whole.agg(F.min("container")).first()[0] or 0
    return pieces.join(whole.withColumnRenamed("key", "_key"), "_key", "left").select(F.coalesce("container", F.lit(first)).alias("container"), *sizes.columns, "piece", "piece_tokens")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(staged(token_sizes(documents, ["doc_id"], path=path), "sizes"), capacity)
