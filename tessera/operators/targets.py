"""Targets: extraction from nested documents, dedupe with provenance, additions and prunes, context text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.functions.keys import collapse, harmonize_key
from tessera.operators.nested import escape

#: The channel members that are read, and how.
CHANNEL_FIELDS = (("source", "field_value"), ("molecule", "field_value"), ("organism", "container_value"), ("characteristics", "tag_value"))


def resolve(document: object, pointer: str) -> object:
    """The value at a JSON Pointer (RFC 6901), or None."""
    at = document
    for part in pointer.split("/")[1:] if pointer else ():
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(at, dict) and part in at:
            at = at[part]
        elif isinstance(at, list) and re.fullmatch("[0-9]+", part) and int(part) < len(at):
            at = at[int(part)]
        else:
            return None
    return at


def _scalar(x: object) -> bool:
    return isinstance(x, (str, int, float)) and x is not None


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def _name(path: str) -> str:
    """The last segment that is no list index."""
    for part in reversed(path.split("/")):
        if part and not part.isdigit():
            return part.replace("~1", "/").replace("~0", "~")
    return ""


def _tags(x: object, path: str):
    if isinstance(x, dict):
        if _scalar(x.get("tag")) and _scalar(x.get("value")):
            yield x["tag"], x["value"], f"{path}/tag", f"{path}/value", path
            return
        for k, v in x.items():
            yield from _tags(v, f"{path}/{escape(str(k))}")
    elif isinstance(x, list):
        for k, v in enumerate(x):
            yield from _tags(v, f"{path}/{k}")


def _containers(x: object, path: str, field: str, start: str):
    """Values of objects below ``start``, which names the field; nothing is taken below an object whose value was taken."""
    if isinstance(x, dict):
        if _scalar(x.get("value")):
            yield field, x["value"], start, f"{path}/value", path
            return
        for k, v in x.items():
            if isinstance(v, (dict, list)):
                yield from _containers(v, f"{path}/{escape(str(k))}", field, start)
    elif isinstance(x, list):
        for k, v in enumerate(x):
            if isinstance(v, (dict, list)):
                yield from _containers(v, f"{path}/{k}", field, start)


def _leaves(x: object, path: str):
    if isinstance(x, dict):
        for k, v in x.items():
            at = f"{path}/{escape(str(k))}"
            if _scalar(v):
                yield str(k), v, at, at, path
            else:
                yield from _leaves(v, at)
    elif isinstance(x, list):
        for k, v in enumerate(x):
            if isinstance(v, (dict, list)):
                yield from _leaves(v, f"{path}/{k}")


def default_specs(document: object) -> list[tuple[str, str]]:
    """(pointer, mode) of the members of every sample's channels that are present."""
    packages = [("", document)] if isinstance(document, dict) else [(f"/{k}", p) for k, p in enumerate(document)] if isinstance(document, list) else []
    out = []
    for base, package in packages:
        samples = package.get("sample") if isinstance(package, dict) else None
        for i, sample in enumerate(samples if isinstance(samples, list) else ()):
            channels = sample.get("channel") if isinstance(sample, dict) else None
            for j, channel in enumerate(channels if isinstance(channels, list) else ()):
                out += [(f"{base}/sample/{i}/channel/{j}/{name}", mode) for name, mode in CHANNEL_FIELDS if isinstance(channel, dict) and name in channel]
    return out


def extracted(document: object, specs: list | None = None) -> list[tuple]:
    """(field, label, field path, label path, parent path) in visit order; unknown modes and missing paths give nothing.

    Modes: field_value (the scalar at the path), tag_value (tag and value pairs, not below a pair), container_value (values of
    objects, not below one that has a value, named by the path of the container), scalar (all scalar members below; also where a spec has no mode).
    """
    out: list[tuple] = []
    for spec in default_specs(document) if specs is None else specs:
        path, mode = (spec, "scalar") if isinstance(spec, str) else (spec if isinstance(spec, (tuple, list)) and len(spec) == 2 else (None, None))
        if not isinstance(path, str) or (x := resolve(document, path)) is None:
            continue
        if mode == "field_value":
            if _scalar(x):
                out.append((_name(path), x, path, path, _parent(path)))
        elif mode == "tag_value":
            out += _tags(x, path)
        elif mode == "container_value":
            out += _containers(x, path, _name(path), path)
        elif mode in ("scalar", None):
            out += _leaves(x, path)
    return out


TARGET = "id string, source string, pre_hz_field string, pre_hz_label string, pre_hz_field_path string, pre_hz_label_path string, parent_path string, ordinal int"


def extract_targets(records: DataFrame, key: str = "record_id", text: str = "metadata", specs: list | None = None) -> DataFrame:
    """One row per target of every document, ids ``target-0``, ... in visit order; texts that are not JSON give none.

    Values that are no text come as Python writes them (``True``, ``1.5``). A document's targets are bounded by the document.
    """
    names = [key] + [c.split()[0] for c in TARGET.split(", ")]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                try:
                    document = json.loads(value) if value is not None else None
                except (ValueError, RecursionError):
                    continue
                for n, (field, label, fp, lp, pp) in enumerate(extracted(document, specs)):
                    at.append(i)
                    rows.append((f"target-{n}", "metadata", str(field), str(label), fp, lp, pp, n))
            if rows:
                cols = [pa.array(c, pa.int32() if k == 7 else pa.string()) for k, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names)

    return records.select(key, text).mapInArrow(run, f"{key} {dict(records.dtypes)[key]}, {TARGET}")


def resolved_values(records: DataFrame, paths: DataFrame, key: str = "record_id", text: str = "metadata") -> DataFrame:
    """(key, path, value): the value at every distinct JSON Pointer (key, path) of a record as text; null where there is none or only a container.

    A record is parsed once for all its pointers, which are bounded by the record; null pointers are left out.
    """
    lists = paths.select(key, "path").dropna().groupBy(key).agg(F.array_sort(F.collect_set("path")).alias("paths"))

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, (value, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                try:
                    document = json.loads(value) if value is not None else None
                except (ValueError, RecursionError):
                    document = None
                for path in own:
                    x = resolve(document, path)
                    at.append(i)
                    rows.append((path, x if isinstance(x, str) else json.dumps(x) if _scalar(x) else None))
            if rows:
                cols = [pa.array(c, pa.string()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], [key, "path", "value"])

    return records.select(key, text).join(lists, key).mapInArrow(run, f"{key} {dict(records.dtypes)[key]}, path string, value string")


def dedupe_targets(targets: DataFrame, document: str = "record_id") -> DataFrame:
    """One target per document, field and label: the first, with all occurrences in order and dense new ids.

    targets: document, pre_hz_field, pre_hz_label, the three paths, ordinal. A document's targets are bounded by the document
    and shuffled once, by document.
    """
    paths = F.struct("ordinal", "pre_hz_field_path", "pre_hz_label_path", "parent_path")
    groups = targets.repartition(document).groupBy(document, "pre_hz_field", "pre_hz_label").agg(F.min("ordinal").alias("first"), F.array_sort(F.collect_list(paths)).alias("o"))
    place = F.row_number().over(Window.partitionBy(document).orderBy("first")) - 1
    return groups.select(document, F.concat(F.lit("target-"), place).alias("id"), "pre_hz_field", "pre_hz_label", F.size("o").alias("n_occurrences"), F.transform("o", lambda x: x.dropFields("ordinal")).alias("occurrences"))


def distinct_occurrences(occurrences: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Occurrences of a group without repeats of the same three paths; the first in ``ordinal`` stays."""
    paths = ["pre_hz_field_path", "pre_hz_label_path", "parent_path"]
    rank = Window.partitionBy(*by, *paths).orderBy(ordinal)
    return occurrences.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def merged_additions(proposals: DataFrame, targets: DataFrame, document: str = "record_id", per_source: int = 3) -> DataFrame:
    """Every proposal (document, ordinal, source_target_id, label, field_hint) with its ``outcome``.

    added (the first of its normalised field and label), merged (a later one from another source), or the reason against it:
    unknown_source_target, already_present, duplicate_proposal (same group, same source), per_source_limit_exceeded (counted
    over the proposals no other reason rejects).
    """
    keyed = proposals.withColumn("f", harmonize_key(F.col("field_hint"))).withColumn("l", harmonize_key(F.col("label")))
    known = targets.select(document, F.col("id").alias("source_target_id"), F.lit(True).alias("known")).distinct()
    present = targets.select(document, harmonize_key(F.col("pre_hz_field")).alias("f"), harmonize_key(F.col("pre_hz_label")).alias("l"), F.lit(True).alias("present")).distinct()
    j = keyed.join(known, [document, "source_target_id"], "left").join(present, [document, "f", "l"], "left")
    reason = F.when(F.col("known").isNull(), "unknown_source_target").when(F.col("present").isNotNull(), "already_present")
    j = j.withColumn("r", reason)
    same = Window.partitionBy(document, "r", "f", "l", "source_target_id").orderBy("ordinal")
    j = j.withColumn("r", F.when(F.col("r").isNull() & (F.row_number().over(same) > 1), "duplicate_proposal").otherwise(F.col("r")))
    source = Window.partitionBy(document, "r", "source_target_id").orderBy("ordinal")
    j = j.withColumn("r", F.when(F.col("r").isNull() & (F.row_number().over(source) > per_source), "per_source_limit_exceeded").otherwise(F.col("r")))
    group = Window.partitionBy(document, "r", "f", "l").orderBy("ordinal")
    outcome = F.when(F.col("r").isNotNull(), F.col("r")).when(F.row_number().over(group) == 1, "added").otherwise("merged")
    return j.select(document, "ordinal", "source_target_id", F.col("f").alias("field"), F.col("l").alias("label"), outcome.alias("outcome"))


def pruned(targets: DataFrame, prunes: DataFrame, document: str = "record_id") -> DataFrame:
    """Targets without the pruned ids."""
    return targets.join(prunes.select(document, F.col("target_id").alias("id")).distinct(), [document, "id"], "left_anti")


def free_ids(reserved: DataFrame, wanted: DataFrame, document: str = "record_id") -> DataFrame:
    """wanted (document, ordinal) with new ids ``target-k``: the smallest k not reserved (document, id) in the document, in order."""
    used = reserved.select(document, F.regexp_extract("id", "^target-([0-9]+)$", 1).try_cast("int").alias("k")).dropna().groupBy(document).agg(F.collect_set("k").alias("used"))
    lists = wanted.groupBy(document).agg(F.array_sort(F.collect_list("ordinal")).alias("asked")).join(used, document, "left")
    n = F.size("asked") + F.coalesce(F.size("used"), F.lit(0))
    free = F.filter(F.sequence(F.lit(0), n), lambda k: ~F.array_contains(F.coalesce("used", F.array().cast("array<int>")), k))
    return lists.select(document, free.alias("free"), F.posexplode("asked").alias("at", "ordinal")).select(document, "ordinal", F.concat(F.lit("target-"), F.get("free", F.col("at"))).alias("id"))


def context_text(items: DataFrame, document: str = "record_id", limit: int = 500) -> DataFrame:
    """(document, context): ``Study: T | f=l; f=l`` of at most ``limit`` characters.

    items: document, title, pre_hz_field, pre_hz_label, ordinal; a document without targets needs a row with null field and
    label to get its title. Entries are collapsed, in order, once per field and label, none without both. A title that does not
    fit is cut, blanks at its end removed and an ellipsis put, and nothing follows. The text ends before an entry that does
    not fit beside the others; one that is longer than ``limit`` by itself is cut to what is left. Null where there is nothing.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    field, label = collapse(F.col("pre_hz_field")), collapse(F.col("pre_hz_label"))
    named = items.select(document, collapse(F.col("title")).alias("title"), F.when((field != "") & (label != ""), F.struct(field.alias("f"), label.alias("l"))).alias("fl"), "ordinal")
    first = named.groupBy(document, "fl").agg(F.min("ordinal").alias("o"), F.min("title").alias("title"))
    entry = F.when(F.col("fl").isNotNull(), F.struct("o", F.concat("fl.f", F.lit("="), "fl.l").alias("e")))
    lists = first.groupBy(document).agg(F.min("title").alias("title"), F.array_sort(F.collect_list(entry)).alias("es"))
    shortened = lambda x, n: F.concat(F.rtrim(F.substring(x, F.lit(1), n)), F.lit("…"))
    state = lambda t, n, full: F.struct(t.alias("t"), n.alias("n"), full.alias("full"))
    study = F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, F.concat(F.lit("Study: "), "title")).otherwise(F.lit(""))
    start = F.when(F.length(study) > limit, state(shortened(study, F.lit(limit - 1)), F.lit(0), F.lit(True))).otherwise(state(study, F.lit(0), F.lit(False)))

    def add(acc, x):
        mark = F.when(acc["t"] == "", F.lit("")).when(acc["n"] == 0, F.lit(" | ")).otherwise(F.lit("; "))
        whole = F.concat(acc["t"], mark, x["e"])
        left = F.lit(limit) - F.length(acc["t"]) - F.length(mark)
        cut = (F.length(x["e"]) > limit) & (left > 1)
        return F.when(acc["full"], acc).when(F.length(whole) <= limit, state(whole, acc["n"] + 1, F.lit(False))).when(
            cut, state(F.concat(acc["t"], mark, shortened(x["e"], left - 1)), acc["n"] + 1, F.lit(True))).otherwise(state(acc["t"], acc["n"], F.lit(True)))

    return lists.select(document, F.nullif(F.aggregate("es", start, add, lambda acc: acc["t"]), F.lit("")).alias("context"))
