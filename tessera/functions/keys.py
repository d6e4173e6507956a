"""Key normalisation, JSON Pointer parts and accession forms as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The characters of ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PUNCT = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
#: White space as Unicode sees it, with the four ASCII separators that are white space too.
_SPACE = "[\\s\\x{1c}-\\x{1f}]"


def harmonize_key(value: Column) -> Column:
    """Lower-case, strip white space, strip ASCII punctuation at the ends, join the rest by ``_``.

    Not idempotent, because ``_`` is punctuation: ``( foo )`` gives ``_foo_``, then ``foo``. Null stays null.
    """
    text = F.lower(value.cast("string"))
    text = F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")
    text = F.regexp_replace(text, f"^{_PUNCT}+|{_PUNCT}+$", "")
    return F.regexp_replace(text, f"(?U){_SPACE}+", "_")


def ascii_key(value: Column) -> Column:
    """``harmonize_key`` where only ASCII white space counts: other blanks remain in the key."""
    space = "[ \\t\\n\\x0b\\f\\r\\x{1c}-\\x{1f}]"
    text = F.regexp_replace(F.lower(value.cast("string")), f"^{space}+|{space}+$", "")
    text = F.regexp_replace(text, f"^{_PUNCT}+|{_PUNCT}+$", "")
    return F.regexp_replace(text, f"{space}+", "_")


def pointer_escape(segment: Column) -> Column:
    """A JSON Pointer segment (RFC 6901): ``~`` to ``~0``, then ``/`` to ``~1``."""
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_unescape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer_parent(pointer: Column) -> Column:
    """The pointer without its last segment; that of a one-segment pointer is ``''``."""
    return F.regexp_replace(pointer, "/[^/]*$", "")


def pointer_last(pointer: Column) -> Column:
    return pointer_unescape(F.regexp_extract(pointer, "([^/]*)$", 1))


def accession_from_iri(iri: Column) -> Column:
    """``A:B`` from an IRI whose last segment is ``A_B``, else null."""
    tail = F.regexp_extract(iri, "([^/#]*)$", 1)
    made = F.concat(F.regexp_extract(tail, "^([A-Za-z][A-Za-z0-9]*)_(.+)$", 1), F.lit(":"), F.regexp_extract(tail, "^([A-Za-z][A-Za-z0-9]*)_(.+)$", 2))
    return F.when(tail.rlike("^[A-Za-z][A-Za-z0-9]*_.+$"), made)


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"(?U){_SPACE}+", " "))


def clipped(text: Column, limit: int = 500) -> Column:
    """Collapsed text, cut to ``limit - 1`` characters and an ellipsis when longer than ``limit``."""
    flat = collapse(text)
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def truthy(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def term_key(*fields: Column) -> Column:
    """SHA-256 of the canonical JSON of the given aliased fields (pass them in alphabetical order)."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
