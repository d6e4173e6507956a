"""Text expressions: index text, chunk text, file names, versions, HTML and JSON checks, query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.keys import collapse


def index_text(title: Column, synonyms: Column, description: Column, identifiers: Column) -> Column:
    """The searchable columns of a term as a struct; missing parts are empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(empty(title).alias("title"), empty(F.array_join(synonyms, " ")).alias("synonyms"), empty(description).alias("description"), empty(F.array_join(identifiers, " ")).alias("identifiers"))


def chunk_text(**parts: Column) -> Column:
    """One ``name: value`` line per given part, empty and null parts left out."""
    lines = [F.when(F.length(F.trim(v)) > 0, F.concat(F.lit(f"{k.replace('_', ' ')}: "), v)) for k, v in parts.items()]
    return F.concat_ws("\n", *lines)


def term_chunk(ontology_id: Column, title: Column, synonyms: Column, description: Column, accession: Column, iri: Column) -> Column:
    """The text a term is embedded by: six labelled lines, missing parts empty. synonyms: array of texts."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    given = F.array_join(F.filter(synonyms, lambda s: s.isNotNull() & (s != "")), "; ")
    lines = (("Ontology", ontology_id), ("Term", title), ("Synonyms", given), ("Description", description), ("Accession", accession), ("IRI", iri))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), empty(value)) for name, value in lines])


def folded_case(text: Column) -> Column:
    """Text for comparisons without case, by the full Unicode folding (``ß`` is ``ss``); ASCII stays on the JVM."""

    @F.pandas_udf("string")
    def fold(s):
        return s.str.casefold()

    return F.when(text.rlike(r"[^\x00-\x7f]"), fold(text)).otherwise(F.lower(text))


def file_name(url: Column) -> Column:
    """The last segment of a URL's path, or null."""
    return F.nullif(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "^[a-z]+://[^/]+/(?:.*/)?([^/]+)$", 1), F.lit(""))


def version_from_iri(iri: Column) -> Column:
    """The segment after /releases/, else the first ISO date, else null."""
    return F.coalesce(F.nullif(F.regexp_extract(iri, "/releases/([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract(iri, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")))


def looks_like_html(head: Column) -> Column:
    """Whether the first 4,096 characters, after an XML declaration, begin an HTML page."""
    start = F.lower(F.regexp_replace(F.ltrim(F.substring(head, 1, 4096)), r"^(?s)<\?xml.*?\?>\s*", ""))
    return start.rlike(r"^(<!doctype html|<html)")


def valid_queries(rows: DataFrame, by: str, limit: int = 3, forbidden: str = r"\[(?i:filter|dataset)\]") -> DataFrame:
    """(by, n, problem) of every reply's query texts: problem is null or the first of empty, too_many, duplicate, filter."""
    text = F.col("_folded")
    made = rows.withColumn("_folded", folded_case(collapse(F.col("query")))).groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(text).alias("d"), F.bool_or(F.coalesce(text, F.lit("")) == "").alias("e"), F.bool_or(F.coalesce(F.col("query").rlike(forbidden), F.lit(False))).alias("f"))
    problem = F.when(F.col("e"), "empty").when(F.col("n") > limit, "too_many").when(F.col("d") < F.col("n"), "duplicate").when(F.col("f"), "filter")
    return made.select(by, "n", problem.alias("problem"))


def with_filter(query: Column, condition: str) -> Column:
    return F.concat(F.lit("("), F.trim(query), F.lit(f") AND ({condition})"))
