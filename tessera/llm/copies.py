"""Copies of records hidden by formatting (problem 2)."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators.skew import skew_join
from tessera.session import staged

#: Bits of filter per record and hash functions; with these about one single record in 50 looks like a possible repeat.
BITS_PER_ROW, HASHES = 16, 3
#: Largest filter: 2**28 bits, 32 MB, for 16 million records, which bounds what is sent to the driver and to every executor.
#: More records are dealt by hash into shards of at most so many, each with a filter of its own, so that filters never fill up.
MAX_LOG_BITS = 28
#: Shards that are worked on at the same time.
AT_ONCE = 4
#: Bits of one piece of a filter, the unit that is merged.
_PIECE = 1 << 20


def content(text: Column) -> Column:
    """Letters (lower-case) and digits, a point between digits, and + or - after a letter or digit and not before one."""
    other = r"[^\p{L}\p{Nd}.+\-]|(?<!\p{Nd})\.|\.(?!\p{Nd})|(?<![\p{L}\p{Nd}])[+\-]|[+\-](?=[\p{L}\p{Nd}])"
    return F.regexp_replace(F.lower(text), other, "")


def canonical_items(payload: Column) -> Column:
    """A payload, JSON object or list of ``name: value`` / ``name=value`` items, as sorted distinct ``name=content`` texts.

    Null where the payload is null. A text that is neither gives one nameless item; an empty one gives none.
    """
    text = F.regexp_replace(payload, r"(?U)^\s+|\s+$", "")
    pairs = F.map_entries(F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"}))
    as_json = F.transform(pairs, lambda e: F.concat(content(e["key"]), F.lit("="), F.coalesce(content(e["value"]), F.lit(""))))
    pieces = F.split(text, r"\s*[|;]\s*(?=[^|;:=]{1,60}[:=]|$)")
    shape = r"(?s)^([^:=]*?)\s*[:=](.*)$"
    as_list = F.transform(F.filter(pieces, lambda p: F.trim(p) != ""), lambda p: F.when(
        p.rlike(shape), F.concat(content(F.regexp_extract(p, shape, 1)), F.lit("="), content(F.regexp_extract(p, shape, 2)))).otherwise(F.concat(F.lit("="), content(p))))
    return F.array_sort(F.array_distinct(F.when(F.startswith(text, F.lit("{")) & pairs.isNotNull(), as_json).otherwise(as_list)))


def _places(hashes: np.ndarray, log_bits: int) -> list[np.ndarray]:
    """The filter positions of 64-bit hashes, one array per hash function."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    mask = np.uint64((1 << log_bits) - 1)
    return [((low + np.uint64(k) * high + np.uint64(k * k * 0x9E3779B1)) & mask).astype(np.int64) for k in range(HASHES)]


def repeat_filter(hashed: DataFrame, log_bits: int) -> np.ndarray:
    """The filter of places hit at least twice, merged from once- and twice-filters of all partitions.

    ``hashed`` has one long column. Every task fills two bit arrays, hit once and hit again, and emits their non-empty
    pieces; pieces are merged by place (again = again | again' | once & once'), streaming in sorted order. Only the
    merged pieces of the second array reach the driver: at most 2**MAX_LOG_BITS bits.
    """
    size = 1 << log_bits
    piece = min(_PIECE, size)

    def fill(batches):
        once, again = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)

        def mark(bits, at):
            """Set the bits at sorted distinct places."""
            byte, bit = at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8)
            first = np.concatenate([[0], np.flatnonzero(np.diff(byte)) + 1])
            bits[byte[first]] |= np.bitwise_or.reduceat(bit, first)

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for part in range(0, len(h), 200_000):
                at, n = np.unique(np.concatenate(_places(h[part : part + 200_000], log_bits)), return_counts=True)
                seen = at[(n > 1) | ((once[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)]
                if len(seen):
                    mark(again, seen)
                mark(once, at)
        for k in range(size // piece):
            o, a = (x[k * piece // 8 : (k + 1) * piece // 8] for x in (once, again))
            if o.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([o.tobytes()], pa.binary()), pa.array([a.tobytes()], pa.binary())], ["piece", "once", "again"])

    def merge(batches):
        current, once, again = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([again.tobytes()], pa.binary())], ["piece", "again"])

        for batch in batches:
            for k, o, a in zip(*(c.to_pylist() for c in batch.columns)):
                o, a = np.frombuffer(o, np.uint8), np.frombuffer(a, np.uint8)
                if k != current:
                    if current is not None:
                        yield out()
                    current, once, again = k, o.copy(), a.copy()
                else:
                    again |= a | (once & o)
                    once |= o
        if current is not None:
            yield out()

    parts = hashed.mapInArrow(fill, "piece int, once binary, again binary")
    merged = parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece int, again binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["piece"] * piece // 8
        bits[at : at + piece // 8] = np.frombuffer(row["again"], np.uint8)
    return bits


def copy_groups(records: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, first_id, copies): every record with the smallest key of its group of copies and the group's size.

    Records are copies when they have the same set of names, each with the same content. Records are dealt into shards by
    hash, 16 million each; in every shard pass 1 fills Bloom filters of the hashes seen once and seen again; pass 2 sends through the exact grouping only records whose hash may be a
    repeat, and all others come out as groups of one without a shuffle. The grouping compares 128 bits of the canonical
    text (two independent hashes) and counts before it shuffles; a group that holds a third of all rows meets its
    summary by broadcast. A record with a null payload has no content to compare and is a group of its own; empty
    payloads are copies of each other; several rows of one key count as copies.
    """
    spark = records.sparkSession
    items = records.select(key, payload, F.array_join(canonical_items(F.col(payload)), "\x1f").alias("_items"))
    made = items.select(key, F.xxhash64("_items").alias("h"), F.when(F.col(payload).isNotNull(), F.substring(F.md5("_items"), 1, 16)).alias("g"))
    rows = records.count()
    shards = max(1, math.ceil(rows * BITS_PER_ROW / (1 << MAX_LOG_BITS)))
    # Rows are written into their shards by the tasks that read them: no shuffle, and a shard's filter reads its own files only.
    hashed = staged(made.withColumn("shard", F.pmod(F.shiftright("h", 40), F.lit(shards)).cast("int")), "hashes", ["shard"] if shards > 1 else None)
    log_bits = min(MAX_LOG_BITS, max(20, math.ceil(math.log2(max(1, rows / shards) * BITS_PER_ROW))))

    def mark(shard: int) -> DataFrame:
        own = hashed.filter(F.col("shard") == shard)
        bits = spark.sparkContext.broadcast(repeat_filter(own.filter("g is not null").select("h"), log_bits))

        @F.pandas_udf("boolean")
        def may_repeat(h):
            hit = np.ones(len(h), bool)
            for at in _places(h.to_numpy().astype(np.int64), log_bits):
                hit &= (bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            import pandas as pd

            return pd.Series(hit)

        marked = staged(own.select(key, "h", "g", (F.col("g").isNotNull() & may_repeat("h")).alias("maybe")), "marked")
        bits.unpersist()
        return marked

    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = list(pool.map(mark, range(shards)))
    marked = reduce(DataFrame.unionByName, parts)
    maybe = marked.filter("maybe")
    groups = maybe.groupBy("h", "g").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    repeats = groups.filter("copies > 1")
    grouped = skew_join(maybe.select(key, "h", "g"), repeats, ["h", "g"], "left")
    alone = marked.filter("not maybe").select(key, F.col(key).alias("first_id"), F.lit(1).cast("long").alias("copies"))
    return alone.unionByName(grouped.select(key, F.coalesce("first_id", F.col(key)).alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies")))
