"""Queries of problem 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import personal
from tessera.session import table


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.spans(table(spark, d, "documents")).select("doc_id", "kind", "found_text").distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p10_found, p10_redacted)}


def oracle_sql() -> dict[str, str]:
    return {}
