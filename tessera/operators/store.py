"""Stored indexes of ontologies: terms, lookup keys, text postings and vectors by ontology, with their manifests.

A store is a folder of Parquet tables partitioned by ontology_id: terms, lookup, postings, lengths, vectors, manifest and
vector_manifest. An ontology's partitions are replaced as a whole, so a build that fails leaves the last one readable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.operators import catalog, fts
from tessera.session import staged

TABLES = ("terms", "lookup", "postings", "lengths", "vectors", "manifest", "vector_manifest")
#: Columns of an ontology's source and of its vectors; vectors are fresh while all of theirs are as they were.
SOURCE = ("path", "size", "mtime_ns", "kind")
VECTORS = ("path", "size", "mtime_ns", "model", "dimensions", "chunk_schema", "index_path")


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str, table: str) -> bool:
    path, files = _files(spark, f"{folder}/{table}")
    return files.exists(path)


def read(spark: SparkSession, folder: str, table: str, schema: str | StructType | None = None) -> DataFrame:
    """A table of the store; one that was never written is empty if its ``schema`` is given."""
    if not exists(spark, folder, table) and schema is not None:
        return spark.createDataFrame([], schema)
    return spark.read.option("basePath", f"{folder}/{table}").parquet(f"{folder}/{table}")


def remove(spark: SparkSession, folder: str, ontologies: Iterable[str]) -> list[str]:
    """Drop all partitions of the ontologies, text postings too; the names of those that were there."""
    gone = set()
    for table in TABLES:
        for name in set(ontologies):
            path, files = _files(spark, f"{folder}/{table}/ontology_id={name}")
            if files.exists(path):
                files.delete(path, True)
                if table == "manifest":
                    gone.add(name)
    return sorted(gone)


def write(folder: str, terms: DataFrame, entries: DataFrame, manifest: DataFrame, text: DataFrame, columns: list[str]) -> None:
    """Terms, lookup rows, text index and manifest of the ontologies in ``manifest``; what they had before is replaced.

    text: (ontology_id, term_key, columns...). An ontology of the manifest without rows in a table has none there afterwards.
    The manifest is written last: an ontology is indexed when its manifest says so.
    """
    spark = terms.sparkSession
    manifest = staged(manifest, "manifest")
    names = [r["ontology_id"] for r in manifest.select("ontology_id").collect()]  # one row per ontology
    of = lambda df: df.join(F.broadcast(manifest.select("ontology_id")), "ontology_id", "left_semi")
    postings, lengths = fts.index(of(text), columns)
    remove(spark, folder, names)
    for table, df in (("terms", of(terms)), ("lookup", of(entries)), ("postings", postings), ("lengths", lengths), ("manifest", manifest)):
        catalog.replace_partition(df, f"{folder}/{table}")


def write_vectors(folder: str, vectors: DataFrame, manifest: DataFrame) -> None:
    """Vectors (ontology_id, term_key, vector) and their manifest (ontology_id, columns VECTORS), the manifest last."""
    catalog.replace_partition(vectors, f"{folder}/vectors")
    catalog.replace_partition(manifest, f"{folder}/vector_manifest")


def text_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) for ``fts.search_index``."""
    return read(spark, folder, "postings"), read(spark, folder, "lengths")


def backfill_text(spark: SparkSession, folder: str, text: DataFrame, columns: list[str]) -> bool:
    """Make the text index of stored terms if there is none; whether it was made."""
    if exists(spark, folder, "postings"):
        return False
    postings, lengths = fts.index(text, columns)
    catalog.replace_partition(postings, f"{folder}/postings")
    catalog.replace_partition(lengths, f"{folder}/lengths")
    return True


def framework_order(names: Iterable[str], first: list[str]) -> list[str]:
    """The listed names that exist in the list's order, then the others sorted."""
    known = set(names)
    return [n for n in first if n in known] + sorted(known.difference(first))


def refresh(spark: SparkSession, folder: str, sources: DataFrame, load: Callable[[str], tuple[DataFrame, DataFrame, DataFrame]], columns: list[str], force: Iterable[str] = (), first: list[str] = ()) -> DataFrame:
    """(ordinal, ontology_id, status, error): bring the store to the ``sources`` (ontology_id, columns SOURCE).

    ``load`` gives (terms, entries, text) of one ontology. Fresh ones are left alone unless forced, new and changed ones are
    built, ones whose source is gone are removed. An ontology that fails has status failed and its error, and the
    others go on; what it had before stays. Builds run in the given order, then by name.
    """
    force = set(force)
    before = read(spark, folder, "manifest", "ontology_id string, path string, size long, mtime_ns long, kind string")
    status = {r["ontology_id"]: r["status"] for r in catalog.stale(sources, before, "ontology_id", SOURCE).collect()}
    unknown = force.difference(n for n, s in status.items() if s != "gone")
    if unknown:
        raise KeyError(f"unknown ontologies: {sorted(unknown)}")
    rows = []
    for k, name in enumerate(framework_order(status, list(first))):
        state, error = status[name], None
        if state == "gone":
            remove(spark, folder, [name])
        elif state != "fresh" or name in force:
            try:
                terms, entries, text = load(name)
                write(folder, terms, entries, sources.filter(F.col("ontology_id") == name), text, columns)
                state = "built"
            except Exception as e:  # noqa: BLE001 - one ontology's failure is a row of the report
                state, error = "failed", str(e).split("\n")[0][:500]
        rows.append((k, name, state, error))
    return spark.createDataFrame(rows, "ordinal int, ontology_id string, status string, error string")


def status_counts(report: DataFrame) -> DataFrame:
    """(status, n) of a report."""
    return report.groupBy("status").agg(F.count("*").alias("n"))


def stale_vectors(current: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """(ontology_id, status) of vectors by all columns of their manifest: new, changed, gone or fresh."""
    before = read(spark, folder, "vector_manifest", "ontology_id string, path string, size long, mtime_ns long, model string, dimensions int, chunk_schema int, index_path string")
    return catalog.stale(current, before, "ontology_id", VECTORS)
