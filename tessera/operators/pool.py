"""Candidate pools: balanced over ontologies, and preferred ontologies first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def balanced_pool(hits: DataFrame, thresholds: DataFrame | None = None, default: float = 0.5, reserved: int = 2, size: int = 10, ontologies: list[str] | None = None) -> DataFrame:
    """The pool of every query: at least ``reserved`` hits per ontology, then the best of the rest up to max(size, reserved ones).

    hits: (query_id, ontology_id, framework_rank, identity, position, score). Hits below their ontology's threshold
    (table ontology_id, threshold; else ``default``) are out, equal ones and finite scores are in; an identity counts
    once per ontology. Hits of ontologies that are not in ``ontologies``, if given, are out. The result has ``pool_rank`` by falling score, framework rank, position.
    """
    if ontologies is not None:
        hits = hits.filter(F.col("ontology_id").isin(*ontologies)) if ontologies else hits.filter(F.lit(False))
    if thresholds is not None:
        hits = hits.join(thresholds.select("ontology_id", "threshold"), "ontology_id", "left")
    else:
        hits = hits.withColumn("threshold", F.lit(None).cast("double"))
    finite = ~F.isnan("score") & (F.abs("score") != float("inf"))
    kept = hits.filter((F.col("score") >= F.coalesce("threshold", F.lit(default))) & finite).drop("threshold")
    by_score = [F.desc("score"), F.col("position")]
    kept = kept.withColumn("_i", F.row_number().over(Window.partitionBy("query_id", "ontology_id", "identity").orderBy(*by_score))).filter("_i = 1").drop("_i")
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "ontology_id").orderBy(*by_score)) <= reserved)
    overall = [F.desc("score"), F.col("framework_rank"), F.col("position"), F.col("ontology_id")]
    query = Window.partitionBy("query_id")
    kept = kept.withColumn("_n", F.sum(F.col("_r").cast("int")).over(query)).withColumn("_g", F.row_number().over(Window.partitionBy("query_id", "_r").orderBy(*overall)))
    pool = kept.filter(F.col("_r") | (F.col("_g") <= F.greatest(F.lit(size), "_n") - F.col("_n")))
    return pool.withColumn("pool_rank", F.row_number().over(query.orderBy(*overall))).drop("_r", "_n", "_g")


def preferred_pool(hits: DataFrame, preferred: list[str], limit: int, reserved: int = 2) -> DataFrame:
    """The first ``limit`` hits of every query, reservations first: the first hit of every preferred ontology, their second, ..., then the rest in order.

    hits: (query_id, ontology_id, position). Adds ``pool_rank``. A limit below 1 gives nothing.
    """
    order = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(preferred))):
        order = F.when(F.col("ontology_id") == name, k).otherwise(order)
    placed = hits.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "ontology_id").orderBy("position"))).withColumn("_p", order)
    is_reserved = F.col("_p").isNotNull() & (F.col("_k") <= reserved)
    rank = Window.partitionBy("query_id").orderBy(F.when(is_reserved, 0).otherwise(1), F.when(is_reserved, F.col("_k")).otherwise(F.col("position")), F.when(is_reserved, F.col("_p")).otherwise(0))
    return placed.withColumn("pool_rank", F.row_number().over(rank)).filter(F.col("pool_rank") <= limit).drop("_k", "_p")
