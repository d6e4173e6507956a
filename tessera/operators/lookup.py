"""Exact lookup, field resolution and enrichment by identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.keys import harmonize_key, truthy
from tessera.operators.skew import skew_join


def exact_lookup(queries: DataFrame, entries: DataFrame, label: str = "label") -> DataFrame:
    """Hits of every query label: its columns, ``lookup_key``, ontology_id, term_key, index_name, index_rank, source_order, ``position``.

    A hit is an entry whose key is the normalised label, in any ontology. A term met through several entries counts
    once, at its best (index_rank, source_order); ``position`` numbers the hits of a query and ontology in that order,
    ties by term_key. Null labels have no hits; a label in a third of all rows is joined by broadcast of its hits.
    """
    keyed = queries.withColumn("lookup_key", harmonize_key(F.col(label)))
    order = [F.col("index_rank"), F.col("source_order"), F.col("term_key")]
    best = Window.partitionBy("ontology_id", "lookup_key", "term_key").orderBy("index_rank", "source_order", "index_name")
    once = entries.select("ontology_id", "lookup_key", "term_key", "index_name", "index_rank", "source_order").dropna(subset=["lookup_key"]).withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    placed = once.withColumn("position", F.row_number().over(Window.partitionBy("ontology_id", "lookup_key").orderBy(*order)))
    return skew_join(keyed, placed, ["lookup_key"])


def unique_hits(hits: DataFrame, by: list[str]) -> DataFrame:
    """The hits of queries that have exactly one distinct term over all ontologies."""
    counted = hits.groupBy(*by).agg(F.count_distinct("ontology_id", "term_key").alias("n"), F.min(F.struct("ontology_id", "term_key")).alias("t"))
    return counted.filter("n = 1").select(*by, "t.*")


def first_per_identity(hits: DataFrame, within: list[str], identity: Column, order: list[Column]) -> DataFrame:
    """One row per identity in every group: the first in ``order``; null identities stay apart from each other."""
    keyed = hits.withColumn("_id", identity)
    first = keyed.filter("_id is not null").withColumn("_n", F.row_number().over(Window.partitionBy(*within, "_id").orderBy(*order))).filter("_n = 1").drop("_n")
    return first.unionByName(keyed.filter("_id is null")).drop("_id")


def lookup_identity(row: str = "") -> Column:
    """First of id, accession, iri that is not null."""
    return F.coalesce(*[F.col(row + c) for c in ("id", "accession", "iri")])


def vector_identity(row: str = "") -> Column:
    """First of id, accession, iri, title that is neither null nor empty."""
    return truthy(*[F.col(row + c) for c in ("id", "accession", "iri", "title")])


def remote_identity(row: str = "") -> Column:
    """First of id, iri, accession that is neither null nor empty."""
    return truthy(*[F.col(row + c) for c in ("id", "iri", "accession")])


def field_names(registry: DataFrame) -> DataFrame:
    """(name, field_id): every normalised name of a field (field_id, canonical, aliases, ordinal); the first field of a name wins."""
    names = registry.select("field_id", "ordinal", F.explode(F.concat(F.array(F.col("field_id").cast("string"), "canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.select(harmonize_key(F.col("n")).alias("name"), "field_id", "ordinal").dropna(subset=["name"]).groupBy("name").agg(F.min_by("field_id", "ordinal").alias("field_id"))


def resolve_fields(values: DataFrame, registry: DataFrame, column: str) -> DataFrame:
    """``values`` with ``field_id``, null where no field has that name."""
    keyed = values.withColumn("name", harmonize_key(F.col(column)))
    return skew_join(keyed, field_names(registry), ["name"], "left")


def alias_conflicts(registry: DataFrame) -> DataFrame:
    """(name, fields): normalised names that more than one field claims."""
    names = registry.select("field_id", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    return names.select(harmonize_key(F.col("n")).alias("name"), "field_id").dropna(subset=["name"]).groupBy("name").agg(F.count_distinct("field_id").alias("fields")).filter("fields > 1")


def chosen(decisions: DataFrame, candidates: DataFrame, by: list[str]) -> DataFrame:
    """The candidate a decision names by id, accession or iri: the first in ``position``; decisions naming none are left out."""
    named = candidates.select("*", F.explode(F.array_distinct(F.filter(F.array("id", "accession", "iri"), lambda x: x.isNotNull()))).alias("decision"))
    met = decisions.join(named, [*by, "decision"])
    return met.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("position"))).filter("_n = 1").drop("_n")


def enriched(selected: DataFrame, local: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Selected terms with missing ``fields`` filled from the first local term that shares an identifier (any case).

    Both sides have id, accession and iri; the local side an ``ordinal``. Selected values win wherever they are not null.
    """
    ids = lambda: F.array_distinct(F.transform(F.filter(F.array("id", "accession", "iri"), lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x))))
    asked = selected.select(key, F.explode(ids()).alias("identifier"))
    known = local.select(F.explode(ids()).alias("identifier"), F.struct("ordinal", *fields).alias("t"))
    found = skew_join(known, asked, ["identifier"]).groupBy(key).agg(F.min("t").alias("t"))
    return selected.join(found, key, "left").select(*[F.coalesce(F.col(c), F.col(f"t.{c}")).alias(c) if c in fields else F.col(c) for c in selected.columns])
