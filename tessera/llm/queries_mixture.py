"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import mixing, packing
from tessera.session import table


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, the least possible number by volume, and the share of space that is filled."""
    filled = packing.pack_documents(table(spark, d, "documents")).groupBy("container").agg(F.sum("piece_tokens").alias("t"))
    return filled.agg(F.count("*").alias("containers"), F.ceil(F.sum("t") / packing.CAPACITY).alias("least"), F.max("t").alias("fullest"), (F.sum("t") / F.count("*") / packing.CAPACITY).alias("filled"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weights"))[1]


def queries() -> dict:
    return {f.__name__: f for f in (p8_containers, p8_report, p9_mix, p9_shares)}


def oracle_sql() -> dict[str, str]:
    return {}
