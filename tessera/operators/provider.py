"""Outside knowledge as data: remote search results, embeddings, prompts' candidate lists and layered settings."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.keys import clipped, truthy


def remote_hits(documents: DataFrame, by: list[str], rows: int = 25) -> DataFrame:
    """Search results as hits: the first ``rows`` of every search by ``position``, then those with ontology, iri, id and label.

    documents: by, position, ontology_name, iri, short_form, doc_id, obo_id, label. ``id`` is the first of short_form, doc_id, obo_id
    that is not empty; one hit per identity (id, iri or accession), the first.
    """
    first = documents.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("position"))).filter(F.col("_n") <= rows)
    made = first.select(*by, "position", F.lower("ontology_name").alias("ontology_id"), "iri", truthy(F.col("short_form"), F.col("doc_id"), F.col("obo_id")).alias("id"), F.col("obo_id").alias("accession"), F.col("label").alias("title"))
    whole = made.filter(F.coalesce(truthy(F.col("ontology_id")), F.lit("")) != "").filter("iri <> '' and id <> '' and title <> ''")
    return whole.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "id").orderBy("position"))).filter("_n = 1").drop("_n")


def ontology_metadata(replies: DataFrame) -> DataFrame:
    """(ontology_id, title, version, iri, n_terms) of staged metadata replies (ontology_id, payload JSON); one that is no object gives nulls."""
    at = lambda p: F.get_json_object("payload", p)
    return replies.select("ontology_id", F.coalesce(at("$.config.title"), at("$.title")).alias("title"), F.coalesce(at("$.config.version"), at("$.version")).alias("version"), F.coalesce(at("$.config.id"), at("$.iri")).alias("iri"), at("$.numberOfTerms").try_cast("bigint").alias("n_terms"))


def compact(hits: DataFrame, by: list[str], fields: list[str], limit: int = 10) -> DataFrame:
    """(by, candidates): the first ``limit`` hits by ``position`` as one JSON list, null members left out, descriptions clipped."""
    cells = [clipped(F.col(c)).alias(c) if c == "description" else F.col(c) for c in fields]
    ranked = hits.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("position"))).filter(F.col("_n") <= limit)
    lists = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*cells).alias("h")))).alias("x"))
    return lists.select(*by, F.to_json(F.transform("x", lambda x: x["h"]), {"ignoreNullFields": "true"}).alias("candidates"))


def embedded(texts: DataFrame, column: str, provider: Callable[[list[str]], list[list[float]]], dimensions: int, batch: int = 250) -> DataFrame:
    """``texts`` with ``vector``: the provider is called on the executors with at most ``batch`` texts at once.

    A wrong number of vectors or dimensions is an error; a null text has a null vector.
    """
    if dimensions < 1 or batch < 1:
        raise ValueError("dimensions and batch must be at least 1")

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), dtype=object)
        known = [i for i, x in enumerate(s) if x is not None]
        for a in range(0, len(known), batch):
            part = known[a : a + batch]
            vectors = provider([s.iloc[i] for i in part])
            if len(vectors) != len(part) or any(len(v) != dimensions for v in vectors):
                raise ValueError(f"the provider must give one vector of {dimensions} numbers per text")
            for i, v in zip(part, vectors):
                out.iloc[i] = [float(x) for x in v]
        return out

    return texts.withColumn("vector", embed(F.col(column)))


def layered(defaults: dict, overrides: dict | None) -> dict:
    """Settings with overrides; where both have a mapping, they are merged in turn."""
    out = dict(defaults)
    for k, v in (overrides or {}).items():
        out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def check_settings(threshold: float = 0.5, parent_depth: int = 2, child_depth: int = 1, offset: float = 0.1, limit: int = 10, max_queries: int = 3) -> None:
    """Errors for settings out of range: threshold in [-1, 1], depths at least 0, offset in [0, 2], limit at least 1, max_queries in [1, 3]."""
    def number(x):
        return isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf")

    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    for ok, what in ((number(threshold) and -1 <= threshold <= 1, "threshold"), (whole(parent_depth) and parent_depth >= 0, "parent_depth"), (whole(child_depth) and child_depth >= 0, "child_depth"), (number(offset) and 0 <= offset <= 2, "offset"), (whole(limit) and limit >= 1, "limit"), (whole(max_queries) and 1 <= max_queries <= 3, "max_queries")):
        if not ok:
            raise ValueError(f"{what} is out of range")
