"""Attribute-value rows to wide typed tables, by log-structured upserts (problem 3)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import shared_dir

#: The datatypes with a column type of their own; any other is text.
TYPED = ("integer", "decimal", "boolean", "date", "dateTime")
COLUMN_TYPES = {"integer": "decimal(38,0)", "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date", "dateTime": "timestamp", "string": "string"}


@dataclass(frozen=True)
class Attribute:
    """An attribute: its full predicate, its column in the wide table, its last segment and its type."""

    predicate: str
    column: str
    segment: str
    kind: str


def expand(name: Column, namespaces: dict[str, str]) -> Column:
    """``prefix:rest`` in full where the prefix is known, else unchanged."""
    out = name
    for prefix, namespace in sorted(namespaces.items()):
        out = F.when(F.startswith(name, F.lit(prefix + ":")), F.concat(F.lit(namespace), F.substring(name, len(prefix) + 2, 1 << 30))).otherwise(out)
    return out


def namespaces_of(prefixes: DataFrame, limit: int = 1000) -> dict[str, str]:
    """The prefix table as a dict; more than ``limit`` prefixes are an error."""
    rows = prefixes.select("prefix", "namespace").dropna().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} prefixes")
    return {r["prefix"]: r["namespace"] for r in rows}


def readable(value: Column, kind: str) -> Column:
    """The value as its type, or null where it is not readable.

    dateTime comes as seconds since 1970 (UTC), so that no session time zone plays a part.
    """
    text = F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")
    if kind == "integer":
        return F.when(text.rlike("^[+-]?[0-9]+$"), F.regexp_replace(text, "^([+-]?)0+(?=[0-9])", "$1").try_cast("decimal(38,0)"))
    if kind == "decimal":
        return F.when(text.rlike("^[+-]?[0-9]+(\\.[0-9]+)?$"), text.try_cast("decimal(38,10)"))
    if kind == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))
    if kind == "date":
        return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))
    if kind == "dateTime":
        shape = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
        zoned = F.when(text.rlike(shape + "(Z|[+-][0-9]{2}:[0-9]{2})$"), text).when(text.rlike(shape + "$"), F.concat(text, F.lit("Z")))
        return F.unix_seconds(zoned.try_cast("timestamp"))
    return text


def attributes_of(literals: DataFrame, max_columns: int = 5000) -> list[Attribute]:
    """The attributes of literal rows (predicate, datatype) with the type that most of their declaring rows declare.

    Ties go to the first datatype by name; an attribute no row declares is text. More than ``max_columns`` attributes
    are an error: a wide table of them would not be one. Two predicates with one last segment get ``x`` and ``x_2``.
    """
    kind = F.regexp_extract("datatype", "([^/#:]*)$", 1)
    counted = literals.groupBy("predicate", F.when(F.coalesce(F.col("datatype"), F.lit("")) != "", kind).alias("kind")).agg(F.count("*").alias("n"))
    best = counted.groupBy("predicate").agg(F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("n"), "kind"))).alias("best"))
    rows = best.select("predicate", "best.kind").limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"more than {max_columns} attributes")
    out, seen = [], {"subject": 1}
    for r in sorted(rows, key=lambda r: r["predicate"]):
        segment = r["predicate"].replace("#", "/").rstrip("/").rsplit("/", 1)[-1].rsplit(":", 1)[-1]
        seen[segment.lower()] = n = seen.get(segment.lower(), 0) + 1
        out.append(Attribute(r["predicate"], segment if n == 1 else f"{segment}_{n}", segment, r["kind"] if r["kind"] in TYPED else "string"))
    return out


# A cell of a delta or run is a struct whose natural order is the rule of the merge, so that min and least give the cell that stays:
# (value, version) where the smallest value counts, (-version, value) where the latest does. The version is the arrival.
RULES = ("smallest", "latest")
#: Buckets of a run; a task merges one bucket of all runs.
BUCKETS = 32


def _cell(value: Column, version: Column, rule: str) -> Column:
    made = F.struct(value.alias("value"), version.alias("version")) if rule == "smallest" else F.struct((-version).alias("order"), value.alias("value"))
    return F.when(value.isNotNull(), made)


def full_names(triples: DataFrame, names: dict[str, str]) -> DataFrame:
    """The triples with a subject and predicate, names in full."""
    return triples.filter(F.col("subject").isNotNull() & F.col("predicate").isNotNull()).select(
        "subject", expand(F.col("predicate"), names).alias("predicate"), "object_type", expand(F.col("object_value"), names).alias("object_name"), "object_value", expand(F.col("datatype"), names).alias("datatype"), "staged_at")


def delta(rows: DataFrame, attributes: list[Attribute], names: dict[str, str], rule: str = "smallest", by: list[str] | None = None) -> DataFrame:
    """A sparse wide delta of ``full_names`` rows: one row per subject (and ``by``) with a cell of value and version per attribute.

    A cell's version is the arrival of its value. Partial deltas are built before the shuffle, so that a hot subject
    reaches no task as single rows.
    """
    if rule not in RULES:
        raise ValueError(f"the rule must be one of {RULES}")
    is_class = (F.col("predicate") == names.get("rdf", "rdf:") + "type") & (F.col("object_name") == names.get("owl", "owl:") + "Class")
    version = F.coalesce(F.unix_micros("staged_at"), F.lit(0).cast("long"))
    cells = [F.min(_cell(F.when((F.col("predicate") == a.predicate) & (F.col("object_type") == "literal"), readable(F.col("object_value"), a.kind)), version, rule)).alias(f"c{i}") for i, a in enumerate(attributes)]
    return rows.groupBy(*(by or []), "subject").agg(F.max(F.coalesce(is_class, F.lit(False))).alias("is_class"), *cells)


def write_run(rows: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` written as a sorted run: bucketed by subject, one sorted file per bucket, in the shared folder.

    Runs of as many buckets are merged and compacted without a shuffle.
    """
    spark = rows.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{table}"
    rows.repartition(buckets, "subject").write.bucketBy(buckets, "subject").sortBy("subject").option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def upsert(state: DataFrame | None, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The state (a run) with the delta ``new`` in it, as a new run: per cell the one that stays by the rule of both.

    The delta becomes a run of its own, then both runs are merged bucket by bucket in the order of their subjects: only
    the delta is shuffled, whatever the size of the state. Merging is associative and commutative and a repeated delta
    changes nothing, so batches may arrive late, in any order, or again.
    """
    run = write_run(new, "wide_delta", buckets)
    if state is None:
        return run
    a, b = state.alias("a"), run.alias("b")
    columns = [c for c in state.columns if c not in ("subject", "is_class")]
    merged = a.hint("merge").join(b, F.col("a.subject") == F.col("b.subject"), "full").select(
        F.coalesce("a.subject", "b.subject").alias("subject"), (F.coalesce("a.is_class", F.lit(False)) | F.coalesce("b.is_class", F.lit(False))).alias("is_class"), *[F.least(f"a.{c}", f"b.{c}").alias(c) for c in columns])
    return write_run(merged, "wide_state", buckets)


def compact(runs: DataFrame) -> DataFrame:
    """One row per subject of a table of many runs (a run with several rows per subject), without a shuffle."""
    columns = [c for c in runs.columns if c not in ("subject", "is_class", "batch")]
    return runs.groupBy("subject").agg(F.max("is_class").alias("is_class"), *[F.min(c).alias(c) for c in columns])


def classes(state: DataFrame) -> DataFrame:
    """The wide table of a state: subjects that are classes, with the values of their cells."""
    columns = [c for c in state.columns if c not in ("subject", "is_class")]
    return state.filter("is_class").select("subject", *[F.col(f"{c}.value").alias(c) for c in columns])


def wide_table(triples: DataFrame, prefixes: DataFrame, rule: str = "smallest", max_columns: int = 5000, buckets: int = BUCKETS) -> tuple[DataFrame, list[Attribute]]:
    """One row per class subject with a typed column ``c0, c1, ...`` per attribute, in the order of the returned list.

    Log-structured upserts: each arrival batch (month of ``staged_at``) becomes a sparse wide delta with a version per cell;
    the deltas are written as sorted runs, which are compacted by the rule: ``smallest`` keeps the smallest readable value, as
    problem 3 asks, ``latest`` the value that arrived last (the smallest on ties). A later batch is added by ``upsert`` of its
    ``delta`` without touching what is there.

    Null subjects and predicates are dropped, values that do not fit their type give no cell (``rejected`` lists them; that
    includes integers of more than 38 digits and decimals of more than 28 before or 10 after the point, the bounds of a
    column), repeated rows change nothing, a subject without readable values gets a row of nulls, an empty input gives an
    empty table with no cells. dateTime cells hold seconds since 1970. Extra columns are ignored.
    """
    names = namespaces_of(prefixes)
    rows = full_names(triples, names)
    attributes = attributes_of(rows.filter("object_type = 'literal'"), max_columns)
    deltas = delta(rows.withColumn("batch", F.date_format("staged_at", "yyyyMM")), attributes, names, rule, ["batch"])
    return classes(compact(write_run(deltas, "wide_runs", buckets))), attributes


def rejected(triples: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(subject, predicate, kind, object_value): literals that give no cell because they do not fit their attribute's type."""
    names = namespaces_of(prefixes)
    rows = full_names(triples, names).filter("object_type = 'literal' and object_value is not null")
    unfit = F.lit(False)
    kind = F.lit(None).cast("string")
    for a in attributes_of(rows):
        if a.kind != "string":
            here = F.col("predicate") == a.predicate
            unfit = F.when(here, readable(F.col("object_value"), a.kind).isNull()).otherwise(unfit)
            kind = F.when(here, F.lit(a.kind)).otherwise(kind)
    return rows.filter(unfit).select("subject", "predicate", kind.alias("kind"), "object_value").distinct()


def typed(wide: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """The wide table with its attributes' own column names and types."""
    cols = [(F.timestamp_seconds(f"c{i}") if a.kind == "dateTime" else F.col(f"c{i}").cast(COLUMN_TYPES[a.kind])).alias(a.column) for i, a in enumerate(attributes)]
    return wide.select("subject", *cols)


def cell_text(value: Column, kind: str) -> Column:
    """A cell as text: plain integer, three places, true/false, ISO date, ISO second in UTC."""
    if kind == "decimal":
        return value.cast("decimal(38,3)").cast("string")
    if kind == "dateTime":
        at = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=value.cast("decimal(18,6)"))
        return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return value.cast("string")


def cells(wide: DataFrame, attributes: list[Attribute], kinds: tuple[str, ...] = TYPED) -> DataFrame:
    """(subject, column_name, cell) of the non-null cells of the given kinds; an unpivot without a shuffle."""
    made = [F.struct(F.lit(a.segment).alias("column_name"), cell_text(F.col(f"c{i}"), a.kind).alias("cell")) for i, a in enumerate(attributes) if a.kind in kinds]
    if not made:
        return wide.select("subject", F.lit("").alias("column_name"), F.lit("").alias("cell")).limit(0)
    return wide.select("subject", F.explode(F.array(*made)).alias("x")).select("subject", "x.column_name", "x.cell").filter("cell is not null")
