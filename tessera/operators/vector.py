"""Exact top-k search by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.session import staged


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(F.col(a).cast("array<double>"), F.col(b).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str):
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str):
    """Cosine similarity; -1 where a norm is zero, null for vectors of different length."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(F.lit(-1.0)))


#: Bytes of query vectors that executors get at once; more queries take a further scan of the vectors.
QUERY_BYTES = 64 << 20
#: Queries of one matrix product.
_ROWS = 512


def _best(scores: np.ndarray, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of every row, ties to the smallest term; terms has the shape of scores."""
    if scores.shape[1] <= k:
        return scores, terms
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    mask = scores >= least[:, None]
    for i in np.flatnonzero(mask.sum(1) > k):  # ties at the border
        at = np.flatnonzero(mask[i])
        mask[i] = False
        mask[i, sorted(at, key=lambda j: (-scores[i, j], terms[i, j]))[:k]] = True  # noqa: B023
    at = np.nonzero(mask)[1].reshape(len(scores), k)
    return np.take_along_axis(scores, at, 1), np.take_along_axis(terms, at, 1)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ontology_id, term_key, score, position): the k nearest terms of every query in every ontology.

    queries: (query_id, vector); vectors: (ontology_id, term_key, vector). Executors get the query vectors in blocks of at most
    QUERY_BYTES, each for one scan of the vectors; every partition holds a block against its vectors by matrix products and
    keeps its k best per query and ontology, and only these are shuffled for the final ranking. Ties go to the smallest
    term_key. Null vectors are left out; a vector of another length than the query's is an error.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = queries.sparkSession
    asked = queries.select("query_id", "vector").dropna()
    key_type, term_type = queries.schema["query_id"].dataType, vectors.schema["term_key"].dataType
    id_arrow, term_arrow = to_arrow_type(key_type), to_arrow_type(term_type)
    schema = f"query_id {key_type.simpleString()}, ontology_id string, term_key {term_type.simpleString()}, score double"

    def found(ids: list, matrix: np.ndarray) -> DataFrame:
        length = np.sqrt((matrix * matrix).sum(1))
        shared = spark.sparkContext.broadcast((ids, matrix / np.where(length > 0, length, 1)[:, None], length > 0))

        def near(batches):
            ids, q, real = shared.value
            best: dict = {}
            for b in batches:
                names, terms, column = np.array(b.column(0).to_pylist(), object), np.array(b.column(1).to_pylist(), object), b.column(2)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                if len(flat) != len(terms) * q.shape[1]:
                    raise ValueError(f"vectors must have {q.shape[1]} dimensions")
                v = flat.reshape(len(terms), -1)
                n = np.sqrt((v * v).sum(1))
                v = v / np.where(n > 0, n, 1)[:, None]
                for o in set(names.tolist()):
                    at = np.flatnonzero(names == o)
                    for low in range(0, len(ids), _ROWS):
                        part = slice(low, low + _ROWS)
                        scores = np.where(real[part, None] & (n[at] > 0)[None, :], q[part] @ v[at].T, -1.0)
                        mine = np.broadcast_to(terms[at], scores.shape)
                        if (low, o) in best:
                            scores, mine = np.concatenate([best[low, o][0], scores], 1), np.concatenate([best[low, o][1], mine], 1)
                        best[low, o] = _best(scores, mine, k)
            for (low, o), (scores, mine) in best.items():
                rows = np.repeat(np.arange(low, low + len(scores)), scores.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], id_arrow), pa.array([o] * len(rows), pa.string()), pa.array(mine.ravel().tolist(), term_arrow), pa.array(scores.ravel(), pa.float64())], ["query_id", "ontology_id", "term_key", "score"])

        return vectors.select("ontology_id", "term_key", "vector").dropna().mapInArrow(near, schema)

    parts: list[DataFrame] = []
    ids, block = [], []
    for row in asked.toLocalIterator():
        ids.append(row["query_id"])
        block.append(np.array(row["vector"], float))
        if len(block) * 8 * len(block[0]) >= QUERY_BYTES:
            parts.append(staged(found(ids, np.array(block)), "near"))
            ids, block = [], []
    if block:
        parts.append(found(ids, np.array(block)))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id", "ontology_id").orderBy(F.desc("score"), "term_key"))
    return out.withColumn("position", rank).filter(F.col("position") <= k)


def search_many(queries: DataFrame, vectors: DataFrame, ontologies: list[str], dimensions: int, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(hits, errors): ``top_k`` over the named ontologies; one with vectors of other dimensions is an error row, not a failure.

    errors: (ontology_id, error); ontologies without vectors give neither hits nor errors, as if they were not named.
    """
    named = vectors.filter(F.col("ontology_id").isin(*ontologies)) if ontologies else vectors.filter(F.lit(False))
    bad = named.filter(F.col("vector").isNotNull() & (F.size("vector") != dimensions)).groupBy("ontology_id").agg(F.count("*").alias("n"))
    errors = staged(bad.select("ontology_id", F.concat(F.col("n").cast("string"), F.lit(f" vectors have not {dimensions} dimensions")).alias("error")), "errors")
    return top_k(queries, named.join(errors.select("ontology_id"), "ontology_id", "left_anti"), k), errors
