"""Nested JSON records to flat tables that keep their parent links (problem 4)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORDS = {"t": ("true", "boolean"), "f": ("false", "boolean"), "n": ("null", "null")}
_CLOSE = {"{": "}", "[": "]"}


def escape(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


class _Repeated(Exception):
    """An object has one name twice."""


def _streamed(text: str) -> list[tuple[str, str, str | None]]:
    out, stack, path, i = [], [], "", _BLANK.match(text).end()
    skip = _BLANK.match

    def name(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("a name is missing")
        key, at = scanstring(text, at + 1, True)
        at = skip(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("a colon is missing")
        return key, skip(text, at + 1).end()

    while True:
        c = text[i : i + 1]
        if c in _CLOSE:
            out.append((path, "object" if c == "{" else "array", None))
            i = skip(text, i + 1).end()
            if text[i : i + 1] == _CLOSE[c]:
                i += 1
            elif c == "{":
                key, i = name(i)
                stack.append(["{", path, {key}])
                path = f"{path}/{escape(key)}"
                continue
            else:
                stack.append(["[", path, 0])
                path = f"{path}/0"
                continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
            out.append((path, "string", value))
        elif c in _WORDS:
            word, kind = _WORDS[c]
            if not text.startswith(word, i):
                raise ValueError("an unknown word")
            out.append((path, kind, word if kind == "boolean" else None))
            i += len(word)
        elif c and (m := _NUMBER.match(text, i)):
            out.append((path, "number", m.group()))
            i = m.end()
        else:
            raise ValueError("a value is missing")
        while stack:
            i = skip(text, i).end()
            c, top = text[i : i + 1], stack[-1]
            if c == ",":
                i = skip(text, i + 1).end()
                if top[0] == "[":
                    top[2] += 1
                    path = f"{top[1]}/{top[2]}"
                else:
                    key, i = name(i)
                    if key in top[2]:
                        raise _Repeated
                    top[2].add(key)
                    path = f"{top[1]}/{escape(key)}"
                break
            if c and c == _CLOSE[top[0]]:
                stack.pop()
                i += 1
            else:
                raise ValueError("an end is missing")
        else:
            if skip(text, i).end() != len(text):
                raise ValueError("text after the end")
            return out


def _walked(text: str) -> list[tuple[str, str, str | None]]:
    out, todo = [], [("", json.loads(text, parse_int=lambda x: ("number", x), parse_float=lambda x: ("number", x)))]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            out.append((path, "object", None))
            todo += [(f"{path}/{escape(k)}", v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            out.append((path, "array", None))
            todo += [(f"{path}/{k}", v) for k, v in reversed(list(enumerate(x)))]
        elif isinstance(x, tuple):
            out.append((path, *x))
        elif isinstance(x, bool):
            out.append((path, "boolean", str(x).lower()))
        else:
            out.append((path, "null" if x is None else "string", x))
    return out


def triples_of(text: str | None) -> list[tuple[str, str, str | None]]:
    """(JSON Pointer, kind, value as text) of every value in document order, containers included; the ordinal is the index.

    The text is parsed as a stream with a stack of its own, so depth is no limit. Null or anything that is not one
    whole JSON text gives no triples. A repeated name counts by its last value.
    """
    if text is None:
        return []
    try:
        return _streamed(text)
    except _Repeated:
        try:
            return _walked(text)
        except (ValueError, RecursionError):
            return []
    except ValueError:
        return []


_CHANNEL = re.compile(r"(/sample(?:/([0-9]+))?/channel(?:/([0-9]+))?)/(organism|characteristics)(?=/|$)")
_PLACE = re.compile(r"/sample(?:/([0-9]+))?(/channel(?:/([0-9]+))?)?")
_SERIES = re.compile(r"/series(?:/[0-9]+)?")
_PACKAGE = re.compile(r"/([0-9]+)")
_SCALAR = ("string", "number", "boolean")
#: The tables with a name of their own; every other group of objects is the table of its path without list indices.
ENTITIES = ("package", "series", "sample", "channel", "organism", "characteristic")
ITEM_COLUMNS = "entity string, item_path string, package int, package_path string, sample int, channel int, parent_path string, ordinal int, cells map<string,string>"


def _entity(path: str, rest: str, package_path: str, kinds: dict, leaves: dict) -> str | None:
    """The named table of an object, or None."""
    if rest == "":
        return "package"
    if _SERIES.fullmatch(rest) and (rest == "/series" or kinds[f"{package_path}/series"] == "array"):
        return "series"
    if m := _PLACE.fullmatch(rest):
        if m.group(2):
            return "channel" if m.group(3) is None or kinds[path.rpartition("/")[0]] == "array" else None
        return "sample" if m.group(1) is None or kinds[path.rpartition("/")[0]] == "array" else None
    if m := _CHANNEL.match(rest):
        below = rest[m.end() :]
        if m.group(4) == "organism":
            one = re.fullmatch(r"(/[0-9]+)?", below) and (not below or kinds[path.rpartition("/")[0]] == "array")
            return "organism" if "value" in leaves and one else None
        return "characteristic" if "tag" in leaves and "value" in leaves else None
    return None


def items_of(text: str | None, entities: frozenset | None = None) -> Iterator[tuple]:
    """The rows of the flat tables of one metadata text, in the order of ITEM_COLUMNS; only those of ``entities`` if given.

    Triples are grouped by the object that holds them (their repeated ancestor) and each group is pivoted into a row of
    the table of all objects at that path, list indices left out. A scalar in a list is a row with one cell of the empty name.
    """
    triples = triples_of(text)
    if not triples:
        return
    kinds = {path: kind for path, kind, _ in triples}
    groups: dict[str, dict[str, str]] = {}
    order: dict[str, int] = {}
    for ordinal, (path, kind, value) in enumerate(triples):
        if kind == "object":
            groups[path], order[path] = {}, ordinal
        elif kind in _SCALAR:
            above, _, leaf = path.rpartition("/")
            if path and kinds[above] == "object":
                groups[above][leaf.replace("~1", "/").replace("~0", "~")] = value
            else:
                groups[path], order[path] = {"": value}, ordinal
    many = kinds[""] == "array"
    for path, leaves in groups.items():
        package, package_path, rest = None, "", path
        if many:
            m = _PACKAGE.match(path)
            package, package_path, rest = int(m.group(1)), m.group(), path[m.end() :]
        entity = _entity(path, rest, package_path, kinds, leaves) if kinds[path] == "object" else None
        if entity is None:
            if entities is not None:
                continue
            at, names = package_path, []
            for part in rest.split("/")[1:]:
                if kinds[at] != "array":
                    names.append(part)
                at = f"{at}/{part}"
            entity = "/" + "/".join(names)
        if entities is not None and entity not in entities:
            continue
        m = _PLACE.match(rest)
        sample, channel = (None if x is None else int(x) for x in m.group(1, 3)) if m else (None, None)
        if entity == "characteristic":
            parent = path.rpartition("/")[0]
        elif path == package_path:
            parent = ""
        else:
            parent = path.rpartition("/")[0]
            while parent != package_path and kinds[parent] != "object":
                parent = parent.rpartition("/")[0]
        yield entity, path, package, package_path, sample, channel, parent, order[path], list(leaves.items())


def flat_items(records: DataFrame, key: str = "record_id", text: str = "metadata", entities: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of all flat tables of the records, with their place and cells: one pass over the texts, no shuffle.

    ``item_path`` is the pointer of the row's object, ``parent_path`` that of the object around it (of a characteristic: of the
    list or object that holds it); no scalar is lost: each is a cell of exactly one row. A record whose text is null, empty
    or not whole JSON gives no rows; a repeated record gives its rows again. Other columns of the input play no part.
    ``entities`` limits the tables that are made.
    """
    schema = f"{key} {dict(records.dtypes)[key]}, {ITEM_COLUMNS}"
    names = [key] + [c.strip().split(" ")[0] for c in ITEM_COLUMNS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    kinds = [types[c.strip().split(" ")[1]] for c in ITEM_COLUMNS.split(", ")]
    only = frozenset(entities) if entities is not None else None

    def shred(batches):
        for batch in batches:
            keys, rows = batch.column(0), []
            at: list[int] = []

            def flush():
                cols = list(zip(*rows)) or [()] * len(kinds)
                arrays = [keys.take(pa.array(at, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, kinds)]
                return pa.RecordBatch.from_arrays(arrays, names)

            for i, value in enumerate(batch.column(1)):
                for row in items_of(value.as_py(), only):
                    rows.append(row)
                    at.append(i)
                if len(rows) >= 20_000:
                    yield flush()
                    rows.clear()
                    at.clear()
            if rows:
                yield flush()

    return records.select(key, text).mapInArrow(shred, schema)


def members(items: DataFrame, entity: str, limit: int = 5000) -> list[str]:
    """The names of all cells of a table, sorted; more than ``limit`` are an error: a flat table of them would not be one."""
    names = items.filter(F.col("entity") == entity).select(F.explode(F.map_keys("cells")).alias("name")).distinct().limit(limit + 1)
    found = sorted(r["name"] for r in names.collect())
    if len(found) > limit:
        raise ValueError(f"more than {limit} members in {entity}")
    return found


def flat_table(items: DataFrame, entity: str, columns: list[str] | None = None) -> DataFrame:
    """One of the flat tables: its key, place and one text column per member (all ``members`` if ``columns`` is not given).

    A member named like a place column, or like another member in other case, gets ``_2``, ``_3``, ... added.
    """
    key = items.columns[0]
    place = [key, "item_path", *[c for c in ("package", "package_path", "sample", "channel") if entity in ENTITIES[3:] or c[:7] == "package" or (entity == "sample" and c == "sample")], "parent_path"]
    used, cells = {c.lower() for c in place}, []
    for name in members(items, entity) if columns is None else columns:
        out, n = name or "value", 1
        while out.lower() in used:
            n += 1
            out = f"{name or 'value'}_{n}"
        used.add(out.lower())
        cells.append(F.col("cells")[F.lit(name)].alias(out))
    return items.filter(F.col("entity") == entity).select(*place, *cells)
