"""Bounded walks over the term graph and the pick of relatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators import vector
from tessera.operators.skew import skew_join
from tessera.operators.vector import cosine
from tessera.session import staged


def edges(terms: DataFrame, entries: DataFrame) -> DataFrame:
    """(ontology_id, child, parent): normalised parent references (column ``refs``) resolved through id, accession and iri entries, without loops."""
    from tessera.functions.keys import harmonize_key

    refs = terms.select("ontology_id", F.col("term_key").alias("child"), F.explode("refs").alias("ref")).select("ontology_id", "child", harmonize_key(F.col("ref")).alias("lookup_key")).distinct()
    names = entries.filter(F.col("index_name").isin("id", "accession", "iri")).select("ontology_id", "lookup_key", F.col("term_key").alias("parent")).dropna().distinct()
    return skew_join(refs, names, ["ontology_id", "lookup_key"]).filter("child <> parent").select("ontology_id", "child", "parent").distinct()


def relatives(seeds: DataFrame, links: DataFrame, vectors: DataFrame, depth: int, direction: str) -> DataFrame:
    """(query_id, ontology_id, seed, relation, depth, term_key, score): the best relative of every seed at every depth.

    seeds: (query_id, ontology_id, term_key, vector of the query). The walk goes up ('parent') or down ('child') at most
    ``depth`` steps, only over terms with a vector; a term is reached once, and seeds are walked through but never given.
    Of the terms newly reached at a depth the one with the highest cosine is kept, then the smallest key. A query
    vector of norm zero has no relatives.
    """
    here, there = ("child", "parent") if direction == "parent" else ("parent", "child")
    step = links.select("ontology_id", F.col(here).alias("at"), F.col(there).alias("to"))
    step = skew_join(step, vectors.select("ontology_id", F.col("term_key").alias("to"), F.col("vector").alias("v")), ["ontology_id", "to"])
    base = staged(seeds.filter(F.exists("vector", lambda x: x != 0)).select("query_id", "ontology_id", F.col("term_key").alias("seed"), "vector"), "seeds")
    own = base.select("query_id", "ontology_id", F.col("seed").alias("to")).distinct()
    frontier = base.select("*", F.col("seed").alias("at"))
    visited = base.select("query_id", "ontology_id", "seed", F.col("seed").alias("to"))
    out = None
    keys = ["query_id", "ontology_id", "seed", "to"]
    for d in range(1, depth + 1):
        reached = skew_join(frontier, step, ["ontology_id", "at"]).dropDuplicates(keys).join(visited, keys, "left_anti")
        reached = staged(reached.select(*keys, "vector", "v"), "reached")
        scored = reached.join(own, ["query_id", "ontology_id", "to"], "left_anti").withColumn("score", cosine("vector", "v"))
        best = scored.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "ontology_id", "seed").orderBy(F.desc("score"), "to"))).filter("n = 1")
        best = best.select("query_id", "ontology_id", "seed", F.lit(direction).alias("relation"), F.lit(d).alias("depth"), F.col("to").alias("term_key"), "score")
        out = best if out is None else out.unionByName(best)
        visited = visited.unionByName(reached.select(*keys))
        frontier = reached.select("query_id", "ontology_id", "seed", "vector", F.col("to").alias("at"))
    if out is None:
        raise ValueError("depth must be at least 1")
    return out


def seeds_of(hits: DataFrame, queries: DataFrame, per_ontology: int = 2) -> DataFrame:
    """(query_id, ontology_id, term_key, vector): the first ``per_ontology`` hits by position, before any threshold, with their query's vector."""
    first = hits.filter(F.col("position") <= per_ontology).select("query_id", "ontology_id", "term_key")
    return skew_join(first, queries.select("query_id", "vector"), ["query_id"])


def search_many(queries: DataFrame, vectors: DataFrame, links: DataFrame, ontologies: list[str], dimensions: int, k: int = 10, parent_depth: int = 0, child_depth: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(hits, errors, relatives): ``vector.search_many``, and the relatives of the first hits of every ontology where a depth is given."""
    if k < 1 or min(parent_depth, child_depth) < 0:
        raise ValueError("k must be at least 1, depths at least 0")
    hits, errors = vector.search_many(queries, vectors, ontologies, dimensions, k)
    hits = staged(hits, "hits")
    found = None
    good = vectors.join(errors.select("ontology_id"), "ontology_id", "left_anti")
    for depth, direction in ((parent_depth, "parent"), (child_depth, "child")):
        if depth:
            part = relatives(seeds_of(hits, queries), links, good, depth, direction)
            found = part if found is None else found.unionByName(part)
    return hits, errors, found


def relatives_threshold(threshold: Column, offset: float = 0.1) -> Column:
    return F.greatest(F.lit(-1.0), threshold - F.lit(offset))


def pick_relatives(direct: DataFrame, found: DataFrame) -> DataFrame:
    """Of every query and ontology one relative per (relation, depth), greedily: parents before children, near before far.

    direct: (query_id, ontology_id, term_key) already chosen; found: relatives with score. Candidates go by bucket, then
    score, then key; one is taken if its bucket is free and its term not yet used.
    """
    bucket = F.when(F.col("relation") == "parent", F.col("depth")).otherwise(1000 + F.col("depth"))
    entry = F.struct(bucket.alias("b"), (-F.col("score")).alias("s"), "term_key", "relation", "depth")
    lists = found.groupBy("query_id", "ontology_id").agg(F.array_sort(F.collect_set(entry)).alias("c"))
    used = direct.groupBy("query_id", "ontology_id").agg(F.collect_set("term_key").alias("used"))
    joined = lists.join(used, ["query_id", "ontology_id"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    start = F.filter("c", lambda x: F.lit(False))
    taken = F.aggregate("c", start, lambda acc, x: F.when(F.exists(acc, lambda a: (a["b"] == x["b"]) | (a["term_key"] == x["term_key"])) | F.array_contains("used", x["term_key"]), acc).otherwise(F.concat(acc, F.array(x))))
    return joined.select("query_id", "ontology_id", F.explode(taken).alias("x")).select("query_id", "ontology_id", "x.relation", "x.depth", "x.term_key", (-F.col("x.s")).alias("score"))
