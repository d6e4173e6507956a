"""Term stores, freshness manifests and response caches as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = ("path", "size", "mtime_ns", "kind")


def stale(current: DataFrame, indexed: DataFrame, key: str = "ontology_id", columns: tuple[str, ...] = MANIFEST) -> DataFrame:
    """(key, status): new, changed, gone or fresh, comparing the manifest columns null-safely."""
    i = indexed.select(key, F.struct(*columns).alias("was"), F.lit(True).alias("had"))
    c = current.select(key, F.struct(*columns).alias("now"), F.lit(True).alias("has"))
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "gone").when(F.col("was").eqNullSafe(F.col("now")), "fresh").otherwise("changed")
    return c.join(i, key, "full").select(key, status.alias("status"))


def replace_partition(df: DataFrame, path: str, by: str = "ontology_id") -> None:
    """Write ``df`` over the partitions it has, leaving all others: the files appear only when the job commits."""
    df.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def counts(terms: DataFrame, entries: DataFrame, by: str = "ontology_id") -> DataFrame:
    """(by, terms, lookups): distinct terms and lookup rows per ontology; 0 where one side has none."""
    a = terms.groupBy(by).agg(F.count("*").alias("terms"))
    b = entries.groupBy(by).agg(F.count("*").alias("lookups"))
    return a.join(b, by, "full").select(by, F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lookups", F.lit(0)).alias("lookups"))


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The last row of every key by ``version`` columns; all other columns of that row."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("r"))
    return best.select(*key, "r.*")


def cached(rows: DataFrame, key: list[str], now: str, ttl_seconds: int, force: bool = False, at: str = "created_at", tie: str | None = None) -> DataFrame:
    """The live cache entries: of every key the last written, if it is not older than the time to live (an equal age is fresh).

    ``force`` is a miss for every key.
    """
    if force:
        return rows.limit(0)
    last = latest(rows, key, [at] + ([tie] if tie else []))
    return last.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp")) <= ttl_seconds * 1_000_000)


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in ``order``: an insert that ignores what is there."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*key, "r.*")


def cache_put(path: str, rows: DataFrame) -> None:
    """Add entries (provider, key, payload, created_at) to a cache table; the last of a key counts (``cached``), so a set is an append."""
    rows.write.mode("append").partitionBy("provider").parquet(path)


def cache_read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cache_clear(spark: SparkSession, path: str, provider: str | None = None, compact: bool = False) -> None:
    """Forget all entries, or those of one provider; ``compact`` instead keeps only the last entry of every key."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if provider is None or compact else f"{path}/provider={provider}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not compact:
        files.delete(at, True)
        return
    rows = spark.read.parquet(path)
    new = f"{path}-{uuid.uuid4().hex[:8]}"
    latest(rows, ["provider", "key"], ["created_at", "payload"]).write.partitionBy("provider").parquet(new)
    files.delete(at, True)
    files.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new), at)


def write_report(rows: DataFrame, path: str) -> None:
    """A small report as one JSON file of lines, null members kept, columns in alphabetical order."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def replies(rows: DataFrame, column: str = "reply") -> DataFrame:
    """``rows`` with ``reply_kind`` (object, array or null) and ``reply_error``: whether a reply is one JSON object or list."""
    parsed = F.try_parse_json(F.col(column))
    kind = F.lower(F.regexp_extract(F.schema_of_variant(parsed), "^([A-Z]+)", 1))
    good = F.when(kind.isin("object", "array"), kind)
    error = F.when(F.col(column).isNull(), "empty").when(parsed.isNull(), "not JSON").when(good.isNull(), "neither object nor list")
    return rows.withColumn("reply_kind", good).withColumn("reply_error", error)


def given_texts(rows: DataFrame, spark: SparkSession, value: str = "value", file: str = "file") -> DataFrame:
    """``rows`` with ``text``: the whole text of the file named, else the value given; a file that is not there is an error of the read.

    The named files are few and known to the driver (they are an interface's parameters), their contents are not.
    """
    names = [r[file] for r in rows.select(file).dropna().distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("more than 10,000 files")
    if not names:
        return rows.withColumn("text", F.col(value))
    texts = spark.read.text(names, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("_path"), F.col("value").alias("_text"))
    return rows.join(texts, F.regexp_replace(F.col(file), "^file:/*", "/") == F.col("_path"), "left").withColumn("text", F.coalesce("_text", F.col(value))).drop("_path", "_text")
