"""Registries of fields and ontologies as tables: writing, review status, listing and subset checks.

fields: (field_id, canonical, aliases array<string>, description, review_status, created_at, updated_at).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.keys import harmonize_key
from tessera.operators import lookup

#: The states a field's review can be in.
REVIEW = ("unreviewed", "reviewed", "rejected")

#: Ontologies a catalogue may have; their list is handled on the driver.
MAX_ONTOLOGIES = 10_000


def put_fields(fields: DataFrame, new: DataFrame, now: str, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(fields with the new ones, rejected): the new rows (field_id, canonical, aliases, description, review_status) under their normalised ids.

    Rejected with a reason: an empty id, a field that exists (unless ``replace``), an alias of another field, an unknown
    review status; of several new rows for a field the first by its columns counts. A replaced field keeps its created_at.
    """
    at = F.lit(now).cast("timestamp")
    keyed = new.withColumn("field_id", harmonize_key(F.col("field_id"))).withColumn("review_status", F.coalesce("review_status", F.lit(REVIEW[0])))
    keyed = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("field_id").orderBy("canonical", "description", "review_status"))).filter("_n = 1").drop("_n")
    owners = fields.select(F.col("field_id").alias("_owner"), F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("_a")).select("_owner", harmonize_key(F.col("_a")).alias("_alias"))
    claimed = keyed.select("field_id", F.explode(F.coalesce("aliases", F.array().cast("array<string>"))).alias("_a")).select("field_id", harmonize_key(F.col("_a")).alias("_alias"))
    taken = claimed.join(owners, "_alias").filter("field_id <> _owner").groupBy("field_id").agg(F.min("_alias").alias("_taken"))
    old = fields.select("field_id", F.col("created_at").alias("_created"))
    j = keyed.join(old, "field_id", "left").join(taken, "field_id", "left")
    reason = F.when(F.coalesce("field_id", F.lit("")) == "", "empty id").when(F.col("_created").isNotNull() & F.lit(not replace), "exists").when(F.col("_taken").isNotNull(), F.concat(F.lit("alias taken: "), "_taken")).when(~F.col("review_status").isin(*REVIEW), "unknown status")
    j = j.withColumn("reason", reason)
    good = j.filter("reason is null").select("field_id", "canonical", "aliases", "description", "review_status", F.coalesce("_created", at).alias("created_at"), at.alias("updated_at"))
    kept = fields.join(good.select("field_id"), "field_id", "left_anti")
    return kept.select(*good.columns).unionByName(good), j.filter("reason is not null").select("field_id", "reason")


def remove_fields(fields: DataFrame, ids: Iterable[str]) -> DataFrame:
    spark = fields.sparkSession
    gone = spark.createDataFrame([(i,) for i in ids], "id string").select(harmonize_key(F.col("id")).alias("field_id"))
    return fields.join(gone, "field_id", "left_anti")


def set_review_status(fields: DataFrame, changes: DataFrame, now: str) -> DataFrame:
    """Fields with the review status of ``changes`` (field_id, review_status); unknown fields and states change nothing."""
    new = changes.filter(F.col("review_status").isin(*REVIEW)).select(harmonize_key(F.col("field_id")).alias("field_id"), F.col("review_status").alias("_new")).groupBy("field_id").agg(F.min("_new").alias("_new"))
    j = fields.join(new, "field_id", "left")
    return j.withColumn("updated_at", F.when(F.col("_new").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))).withColumn("review_status", F.coalesce("_new", "review_status")).drop("_new").select(*fields.columns)


def list_fields(fields: DataFrame, status: str | None = None) -> DataFrame:
    """Fields of a review status (all if None), by id."""
    return (fields if status is None else fields.filter(F.col("review_status") == status)).orderBy("field_id")


def aliases(fields: DataFrame) -> DataFrame:
    """(alias, field_id): the alias registry, made anew from the fields; an alias of several fields goes to the first id."""
    return lookup.field_names(fields.select("field_id", "canonical", "aliases", F.col("field_id").alias("ordinal"))).select(F.col("name").alias("alias"), "field_id")


def field_view(fields: DataFrame) -> DataFrame:
    """(label, aliases, description) of fields, missing parts empty."""
    return fields.select(F.col("field_id").alias("label"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("description", F.lit("")).alias("description"))


def unknown_names(names: DataFrame, known: DataFrame, column: str = "ontology_id") -> DataFrame:
    """The distinct non-null names that are not known: a subset check is whether there are none."""
    return names.select(column).dropna().distinct().join(known.select(column).distinct(), column, "left_anti")


def same_term(a: str, b: str):
    """Whether two arrays of identifiers share one, in any case."""
    low = lambda c: F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x)))
    return F.arrays_overlap(low(F.col(a)), low(F.col(b)))


def candidate_ontologies(targets: DataFrame, catalogue: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, ontology_id, ordinal) of the ontologies a target may be searched in.

    targets: (key, configured array<string> or null); catalogue: (ontology_id, ordinal, has_file). A configured list gives its
    known ones with a local file in the list's own order, repeats too; without one it is all with a local file, in the order
    of the catalogue.
    """
    local = catalogue.filter("has_file").select("ontology_id", F.col("ordinal").alias("_order"))
    listed = targets.filter("configured is not null").select(key, F.posexplode("configured").alias("ordinal", "ontology_id")).join(F.broadcast(local.select("ontology_id")), "ontology_id", "left_semi").select(key, "ontology_id", "ordinal")
    rows = local.orderBy("_order", "ontology_id").limit(MAX_ONTOLOGIES + 1).collect()
    if len(rows) > MAX_ONTOLOGIES:
        raise ValueError(f"more than {MAX_ONTOLOGIES} ontologies")
    names = F.array(*[F.lit(r["ontology_id"]) for r in rows]).cast("array<string>")
    free = targets.filter("configured is null").select(key, F.posexplode(names).alias("ordinal", "ontology_id")).select(key, "ontology_id", "ordinal")
    return listed.unionByName(free)
