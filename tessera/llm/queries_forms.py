"""Queries of problems 1 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import looks, mapping
from tessera.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return looks.look_up(table(spark, d, "targets"), table(spark, d, "lookup_entries"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "targets").select(F.col("pre_hz_label").alias("text"))
    keys = table(spark, d, "lookup_entries").filter("index_name = 'label'").select(F.col("lookup_key").alias("text"))
    return looks.visual_forms(labels.unionByName(keys))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return mapping.mapped(table(spark, d, "targets"), table(spark, d, "reference_values"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).filter("status = 'mapped'").select("target_id", "kind", "ref_id")


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).filter("status = 'unmatched'").select("target_id", "kind", "value")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_forms, p7_found, p7_unmatched)}


def oracle_sql() -> dict[str, str]:
    return {}
