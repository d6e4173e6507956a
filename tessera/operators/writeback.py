"""Results written back into nested documents."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.operators.targets import resolve


def _above(pointer: str) -> str:
    return pointer.rpartition("/")[0] if "/" in pointer.strip("/") else ""


def apply_target(document: object, field_path: str, label_path: str, parent_path: str, field: str, label: str, term_id: str | None, onto: str | None) -> None:
    """Write one result beside the value it was read from; bad paths are ignored.

    The paths tell where: one path for field and label is a plain member, which gets the members hz_<field>, _id, _onto beside
    it, with a suffix _1, _2, ... while one of the names is taken by another result; a tag and a value get rows of the same
    names in the list of the pair; any other pair is a container, which gets a list hz_<field> of {value, id, onto} beside
    it. What is already there is not repeated; a member hz_<field> that is no list makes way for the container's list.
    """
    parent = resolve(document, parent_path)
    if not isinstance(parent, dict) or not isinstance(field_path, str) or not isinstance(label_path, str):
        return
    name = f"hz_{field}"
    more = {k: v for k, v in (("id", term_id), ("onto", onto)) if v is not None}
    if field_path == label_path:
        member = field_path.rpartition("/")[2].replace("~1", "/").replace("~0", "~")
        if field_path == "" or member not in parent:
            return
        k = 0
        while True:
            suffix = f"_{k}" if k else ""
            wanted = {f"{name}{suffix}": label} | {f"{name}_{part}{suffix}": v for part, v in more.items()}
            if all(parent.get(n) == v for n, v in wanted.items()):
                return
            if parent.keys().isdisjoint(wanted):
                parent.update(wanted)
                return
            k += 1
    if field_path.endswith("/tag") and label_path.endswith("/value") and "tag" in parent and "value" in parent:
        rows = resolve(document, _above(parent_path))
        if isinstance(rows, list):
            for tag, value in ((name, label), *((f"{name}_{part}", v) for part, v in more.items())):
                if (row := {"tag": tag, "value": value}) not in rows:
                    rows.append(row)
        return
    holder = resolve(document, _above(field_path))
    if isinstance(holder, dict):
        if not isinstance(holder.get(name), list):
            holder[name] = []
        if (row := {"value": label} | more) not in holder[name]:
            holder[name].append(row)


def write_back(records: DataFrame, results: DataFrame, key: str = "record_id", text: str = "metadata") -> DataFrame:
    """(key, text) of every record with its results written in; records without results, or that are not JSON, stay as they are.

    results: key, ordinal, pre_hz_field_path, pre_hz_label_path, parent_path, hz_field, hz_label, term_id, onto; rows without
    hz_field or hz_label are skipped, others applied in order. A document's results are bounded by the document.
    """
    part = F.struct("ordinal", "pre_hz_field_path", "pre_hz_label_path", "parent_path", "hz_field", "hz_label", "term_id", "onto")
    lists = results.filter("hz_field is not null and hz_label is not null").groupBy(key).agg(F.array_sort(F.collect_list(part)).alias("results"))
    kind = dict(records.dtypes)[key]

    def run(batches):
        for batch in batches:
            out = []
            for value, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    document = json.loads(value) if value is not None and rows else None
                except (ValueError, RecursionError):
                    document = None
                if document is None:
                    out.append(value)
                    continue
                for r in rows:
                    apply_target(document, r["pre_hz_field_path"], r["pre_hz_label_path"], r["parent_path"], r["hz_field"], r["hz_label"], r["term_id"], r["onto"])
                out.append(json.dumps(document, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, text])

    return records.select(key, text).join(lists, key, "left").mapInArrow(run, f"{key} {kind}, {text} string")
