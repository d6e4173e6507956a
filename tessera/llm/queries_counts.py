"""Queries of problems 2 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import copies, frequency
from tessera.session import table


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_groups(table(spark, d, "raw_targets"), "raw_id", "payload")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("raw_id <> first_id").select("first_id", F.col("raw_id").alias("copy_id"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("raw_id = first_id").select("raw_id", "copies")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "targets").select("record_id", "pre_hz_field", "pre_hz_label")
    values = targets.unpivot("record_id", ["pre_hz_field", "pre_hz_label"], "field_name", "field_value")
    total = targets.agg(F.count_distinct("record_id")).first()[0]
    return frequency.marked(frequency.value_counts(values, ["field_name", "field_value"], "record_id"), total)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).filter("mark is not null").select("field_name", "field_value", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


_COUNTS = """
with counted as (
  select field_name, field_value, count(*) as n_rows, count(distinct record_id) as n_records from (
    select 'pre_hz_field' as field_name, pre_hz_field as field_value, record_id from targets
    union all select 'pre_hz_label', pre_hz_label, record_id from targets) where field_value is not null group by 1, 2),
result as (
  select *, case when n_records < 3 then 'rare' when n_records > 0.05 * (select count(distinct record_id) from targets) then 'common' end as mark from counted)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_records, p5_found, p5_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _COUNTS + "select field_name, field_value, mark from result where mark is not null",
        "p5_counts": _COUNTS + "select * from result",
    }
