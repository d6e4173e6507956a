"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Folder of the tokenizers' files and the vocabulary used where none is named.
FOLDER, VOCABULARY = os.environ.get("TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces for the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters given to the tokenizer at once; longer texts are cut before blanks.
_STRETCH = 100_000


def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_BLANK = re.compile(r"(?<=\S)[ \n]")


def stretches(text: str) -> list[str]:
    """The whole text in stretches cut before a blank that follows another character, where the tokenizer begins a new piece in any case.

    A stretch ends at the last such blank within _STRETCH characters, or at the next one beyond: a run without blanks is
    never cut, so its tokens do not depend on where it stands.
    """
    out, at = [], 0
    while len(text) - at > _STRETCH:
        end = max(text.rfind(" ", at + 1, at + _STRETCH), text.rfind("\n", at + 1, at + _STRETCH))
        while end > at + 1 and text[end - 1].isspace():
            end -= 1
        if end <= at + 1:
            m = _BLANK.search(text, at + 1)
            if m is None:
                break
            end = m.start()
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def token_sizes(texts: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` and ``tokens`` (long), the number of tokens of the whole text; null and empty texts have 0. No shuffle."""
    path = path or f"{FOLDER}/{VOCABULARY}"
    fields = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", tokens long"

    def count(batches):
        encoding = _encoding(path)
        for batch in batches:
            sizes = [sum(len(encoding.encode_ordinary(s)) for s in stretches(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, "tokens"])

    return texts.select(*keep, F.col(text).alias("_text")).mapInArrow(count, schema)
