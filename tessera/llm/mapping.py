"""Free-typed values to the entries of a reference list (problem 7)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.llm.looks import cleaned, latin
from tessera.operators.skew import skew_join
from tessera.session import staged

#: Buckets of the rarity table that every executor gets (4 MB); it only sets the order of tokens, so shared buckets change no result.
BUCKETS = (1 << 20) - 3
#: A slip puts at most so many tokens of a word out and brings at most so many in: a letter and two pairs.
PER_SLIP = 3
#: A phrase is a remark if it stands beside at least REMARK_FORMS texts of entries and REMARK_SHARE of those that have anything
#: beside them; it must make up REMARK_PART of all such pairs, so that there are at most 1 / REMARK_PART remarks.
REMARK_FORMS, REMARK_SHARE, REMARK_PART = 3, 0.05, 0.001
#: A word in OWN_ROWS rows and more than a OWN_SHARE-th as often as the word it resembles is a word of its own, no slip.
OWN_ROWS, OWN_SHARE = 10, 10
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_INDEX = r"[\[(]\s*[0-9]+\s*[\])]"
_INDEX_RE = regex.compile(_INDEX)


def words_of(value: str) -> list[str]:
    """The words of a value as it looks, lower-case, without a bracketed number."""
    return _WORD.findall(_INDEX_RE.sub(" ", latin(cleaned(value))).lower())


def _split(values: DataFrame) -> DataFrame:
    """``value`` and its ``words``: ASCII values on the JVM, others in Python."""

    @F.pandas_udf("array<string>")
    def other(s):
        return s.map(words_of)

    plain = ~F.col("value").rlike(r"[^\x00-\x7f]")
    quick = F.regexp_extract_all(F.lower(F.regexp_replace("value", _INDEX, " ")), F.lit("[a-z0-9]+"), 0)
    return values.filter(plain).withColumn("words", quick).unionByName(values.filter(~plain).withColumn("words", other("value")))


def _shape(word: str) -> str:
    return "#" if word.isdigit() else "?" if len(word) == 1 and word.isalpha() else word


def without_remarks(words: list[str], remarks: list[tuple[str, ...]]) -> list[str]:
    """The words without the phrases of ``remarks`` (longest first), in which "#" stands for a number and "?" for a letter."""
    out, i = [], 0
    while i < len(words):
        for r in remarks:
            if tuple(map(_shape, words[i : i + len(r)])) == r:
                i += len(r)
                break
        else:
            out.append(words[i])
            i += 1
    return out or words


def without_glued(joined: str, remarks: list[tuple[str, ...]]) -> list[str]:
    """A word without a remark glued to one of its ends."""
    glued = [r[0] for r in remarks if len(r) == 1 and len(r[0]) > 3]
    return [cut for r in glued for cut in (joined.removeprefix(r), joined.removesuffix(r)) if cut != joined]


def slips(a: str, b: str, most: int) -> int:
    """Letters added, left out, changed or swapped with their neighbour, or ``most + 1`` if more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            n = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and i > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, before[j - 2] + 1)
            new.append(n)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def word_slips(length: int) -> int:
    """Slips allowed in a meant word of that length."""
    return 0 if length < 3 else 1 if length < 9 else 2


def joined_slips(length: int) -> int:
    """Slips allowed in a whole value written as one word."""
    return 1 if length < 12 else 2


@lru_cache(1 << 16)
def word_cost(word: str, meant: str) -> float | None:
    """0 for the same word, less than 2 for a shortened one or one with a slip, None for another word."""
    if word == meant:
        return 0.0
    if len(word) >= 3 and len(word) < len(meant) - 1 and meant.startswith(word):
        return 0.5
    most = 0 if len(word) < 2 else word_slips(len(meant))
    n = slips(word, meant, most)
    return float(n) if n <= most else None


def value_cost(words: list[str], meant: list[str], remarks: list[tuple[str, ...]], cost=word_cost) -> float | None:
    """The cost of reading ``words`` as ``meant``: every meant word once, in any order, and beside them remarks only.

    None where a word is missing or a word that is no remark is left over. Words written as one are compared as one.
    """
    if len(words) >= len(meant):
        left, total = list(words), 0.0
        for m in sorted(meant, key=len, reverse=True):
            best = min(((c, k) for k, w in enumerate(left) if (c := cost(w, m)) is not None), default=None)
            if best is None:
                break
            total += best[0]
            left.pop(best[1])
        else:
            if not left or without_remarks([*left, "\0"], remarks) == ["\0"]:
                return total + 0.1 * len(left)
    core = without_remarks(words, remarks)
    return joined_cost("".join(core), len(core), "".join(meant), len(meant), remarks)


def joined_cost(joined: str, n_words: int, whole: str, n_meant: int, remarks: list[tuple[str, ...]]) -> float | None:
    """The cost of reading ``n_words`` words written as one as ``n_meant`` others written as one."""
    if n_words != n_meant and len(whole) >= 6:
        if joined != whole and n_words == 1 and whole in without_glued(joined, remarks):
            return 1.2
        # More words than meant may be a word in pieces, never a word of their own with a slip.
        most = 0 if n_words > n_meant else joined_slips(len(whole))
        n = slips(joined, whole, most)
        if n <= most:
            return 1.0 + n
    return None


def tokens_of(text: str) -> frozenset[int]:
    """The letters of a word and its pairs of neighbours, ends included, as exact numbers."""
    codes = [1, *map(ord, text), 2]
    return frozenset(codes[1:-1]) | frozenset(a << 21 | b for a, b in zip(codes, codes[1:]))


def least_jaccard(size: int, most: int) -> float:
    """The Jaccard similarity that a word of at most ``most`` slips has at least with a meant word of ``size`` tokens."""
    return max(0.0, (size - PER_SLIP * most) / (size + PER_SLIP * most))


def _most_of_typed(kind: str, length: int) -> int:
    """The most slips any meant word may allow a typed one of that length."""
    allowed = word_slips if kind == "w" else joined_slips
    return max(allowed(n) for n in range(max(1, length - 2), length + 3) if abs(n - length) <= allowed(n) or n == length)


def similar_words(typed: DataFrame, meant: DataFrame) -> DataFrame:
    """(kind, typed, meant, cost) of all pairs of units (kind, unit) whose ``word_cost`` or ``slips`` are within bounds.

    A prefix-filter set-similarity join on letters and letter pairs. Every meant word asks for the Jaccard similarity its
    allowed slips leave; tokens are ordered by rarity among the meant words, and as a pair has all but PER_SLIP tokens a
    slip in common, only the first PER_SLIP * slips + 1 tokens of either side are joined (one for the starts of words,
    which must be met exactly). Lengths and positions sift the pairs, the Jaccard similarity is computed exactly, and
    then the slips are counted.
    """
    spark = typed.sparkSession
    parts = 3 * spark.sparkContext.defaultParallelism

    @F.pandas_udf("array<int>")
    def buckets(kind, unit):
        """Of the word's tokens and of those that end its starts."""
        return pd.Series([sorted({t % BUCKETS for t in tokens_of(x).union(*(tokens_of(x[:n]) for n in range(3, len(x) - 1) if k == "w"))}) for k, x in zip(kind, unit)])

    table = np.zeros(BUCKETS, np.int32)
    for r in meant.select(F.explode(buckets("kind", "unit")).alias("b")).groupBy("b").count().collect():  # at most BUCKETS rows
        table[r["b"]] = min(r["count"], np.iinfo(np.int32).max)
    rarity = spark.sparkContext.broadcast(table)

    def ordered(text: str) -> list[int]:
        counts = rarity.value
        return sorted(tokens_of(text), key=lambda t: (counts[t % BUCKETS], t))

    shape = "array<struct<token: bigint, at: int, size: int, start: string, most: int>>"

    @F.pandas_udf(shape)
    def index_rows(kind, unit):
        out = []
        for k, word in zip(kind, unit):
            most = word_slips(len(word)) if k == "w" else joined_slips(len(word))
            own = ordered(word)
            rows = [(t, i, len(own), word, most) for i, t in enumerate(own[: PER_SLIP * most + 1])]
            for n in range(3, len(word) - 1) if k == "w" else ():
                first = ordered(word[:n])
                rows.append((first[0], 0, len(first), word[:n], 0))
            out.append([dict(zip(("token", "at", "size", "start", "most"), r)) for r in rows])
        return pd.Series(out)

    @F.pandas_udf("array<struct<token: bigint, at: int, size: int>>")
    def asked_rows(kind, unit):
        counts, out = rarity.value, []
        for k, word in zip(kind, unit):
            own = ordered(word)
            out.append([{"token": t, "at": i, "size": len(own)} for i, t in enumerate(own[: PER_SLIP * _most_of_typed(k, len(word)) + 1]) if counts[t % BUCKETS]])
        return pd.Series(out)

    @F.pandas_udf("double")
    def verified(kind, unit, meant_unit, start, most):
        sets = lru_cache(1 << 15)(tokens_of)
        out = []
        for k, a, b, s, n in zip(kind, unit, meant_unit, start, most):
            x, y = sets(a), sets(s)
            both = len(x & y)
            if both < least_jaccard(len(y), n) * (len(x) + len(y) - both) - 1e-9:
                out.append(None)
            elif k == "w":
                out.append(word_cost(a, b))
            else:
                c = slips(a, b, n)
                out.append(float(c) if c <= n else None)
        return pd.Series(out, dtype="float64")

    right = staged(meant.select("kind", F.col("unit").alias("meant"), F.explode(index_rows("kind", "unit")).alias("y")).select("kind", "meant", "y.*").withColumnsRenamed({"at": "at_y", "size": "size_y"}), "meant-prefixes")
    left = staged(typed.repartition(parts).select("kind", "unit", F.explode(asked_rows("kind", "unit")).alias("x")).select("kind", "unit", "x.*"), "typed-prefixes")
    bound = PER_SLIP * F.col("most")
    # What is common can be no more than this token and the shorter rest; the longer set lacks `bound` tokens at most.
    rest = 1 + F.least(F.col("size") - F.col("at"), F.col("size_y") - F.col("at_y")) - 1
    fits = (F.abs(F.col("size") - F.col("size_y")) <= bound) & (rest >= F.greatest("size", "size_y") - bound) & (F.abs(F.length("unit") - F.length("start")) <= F.col("most"))
    met = skew_join(left, right, ["kind", "token"]).filter(fits).select("kind", "unit", "meant", "start", "most").distinct()
    costed = met.repartition(parts).withColumn("cost", verified("kind", "unit", "meant", "start", "most")).filter("cost is not null and not isnan(cost)")
    return costed.groupBy("kind", "unit", "meant").agg(F.min("cost").alias("cost"))


def learned_remarks(lists: DataFrame, forms: DataFrame) -> list[tuple[str, ...]]:
    """Phrases that stand beside the words of many different texts of entries, longest first, at most 1 / REMARK_PART.

    What is beside many entries says nothing about any of them; what belongs to an entry stands beside few. lists: (k, words),
    forms: (form, meant, anchor). Numbers and single letters count by their shape.
    """
    shape = lambda w: F.when(w.rlike("^[0-9]+$"), "#").when(w.rlike(r"^\p{L}$"), "?").otherwise(w)
    longer = lists.filter("size(words) > 1").select("words", F.explode(F.array_distinct("words")).alias("anchor"))
    met = skew_join(longer, forms.select("form", "meant", "anchor"), ["anchor"]).filter((F.size("words") > F.size("meant")) & (F.size(F.array_except("meant", "words")) == 0))
    rest = F.filter("words", lambda w: ~F.array_contains("meant", w))
    beside = staged(met.select("form", F.array_join(F.transform(rest, shape), " ").alias("phrase")).filter("phrase <> ''").distinct(), "beside")
    n = beside.agg(F.count("*").alias("pairs"), F.count_distinct("form").alias("forms")).first()
    least = max(REMARK_FORMS, REMARK_SHARE * n["forms"], REMARK_PART * n["pairs"])
    rows = beside.groupBy("phrase").count().filter(F.col("count") >= least).collect()
    return sorted((tuple(r["phrase"].split(" ")) for r in rows), key=lambda r: (-len(r), r))


def map_values(values: DataFrame, entries: DataFrame, remarks: Iterable[str] = ()) -> DataFrame:
    """(value, ref_id, canonical) for the distinct non-null ``value`` texts that stand for an entry (ref_id, canonical, aliases).

    Words of values and of entries meet in the set-similarity join of ``similar_words``, values written as one word likewise;
    a value meets an entry whose rarest word one of its words is similar to, and ``value_cost`` then checks all words.
    Remarks are learned from the values (``learned_remarks``), ``remarks`` adds known ones. A similar word that the reference
    list holds itself, or that is too frequent for a slip (shortened words may be frequent), is a word of its own and similar to no other. The closest entry
    is kept (least cost, then the highest Jaccard similarity of all letters and pairs, then the smallest ref_id).
    Values without words, or that stand for no entry, are left out; an entry with null or empty texts is never found. Null
    aliases count as none.
    """
    spark = values.sparkSession
    parts = 3 * spark.sparkContext.defaultParallelism
    texts = entries.select("ref_id", "canonical", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("value")).filter("value is not null")
    forms = staged(_split(texts).withColumnRenamed("words", "meant").filter("size(meant) > 0").select("ref_id", "canonical", "meant").distinct(), "forms")
    in_list = staged(forms.select(F.explode("meant").alias("word")).groupBy("word").agg(F.count("*").alias("n_forms")), "list-words")
    keyed = forms.select("ref_id", "canonical", "meant", F.xxhash64("ref_id", "meant").alias("form"), F.array_join("meant", "").alias("whole"))
    rarest = keyed.select("form", F.explode("meant").alias("word")).join(in_list, "word").groupBy("form").agg(F.min(F.struct("n_forms", (-F.length("word")).alias("l"), "word")).alias("a"))
    forms = staged(keyed.join(rarest.select("form", F.col("a.word").alias("anchor")), "form"), "anchored")

    counted = values.select("value").dropna().groupBy("value").agg(F.count("*").alias("n"))
    raw = staged(_split(counted.repartition(parts)).filter("size(words) > 0").withColumn("k", F.array_join("words", " ")), "raw-values")
    lists = staged(raw.groupBy("k").agg(F.first("words").alias("words"), F.sum("n").alias("n")), "lists")
    known = sorted({*(tuple(map(_shape, r.split())) for r in remarks), *learned_remarks(lists, forms)}, key=lambda r: (-len(r), r))
    notes = spark.sparkContext.broadcast(known)

    @F.pandas_udf("array<string>")
    def joined(s):
        """The words without remarks as one word; for a single one also what is left without a glued remark."""
        out = []
        for words in s:
            core = without_remarks(list(words), notes.value)
            whole = "".join(core)
            out.append([whole, *(without_glued(whole, notes.value) if len(core) == 1 else ())])
        return pd.Series(out)

    wholes = staged(lists.repartition(parts).select("k", F.explode(F.array_distinct(joined("words"))).alias("unit")), "wholes")
    words = lists.select("n", F.explode(F.array_distinct("words")).alias("unit")).groupBy("unit").agg(F.sum("n").alias("rows"))
    words = staged(words, "words")
    typed = words.select(F.lit("w").alias("kind"), "unit").unionByName(wholes.filter("length(unit) >= 4").select(F.lit("j").alias("kind"), "unit").distinct())
    meant = in_list.select(F.lit("w").alias("kind"), F.col("word").alias("unit")).unionByName(forms.filter("length(whole) >= 6").select(F.lit("j").alias("kind"), F.col("whole").alias("unit")).distinct())
    near = staged(similar_words(typed, meant), "near")

    # Similar words that are words of their own: of the list, or too frequent.
    alike = near.filter("kind = 'w'").join(in_list.select(F.col("word").alias("unit"), F.lit(True).alias("listed")), "unit", "left")
    alike = alike.join(words, "unit", "left").join(words.select(F.col("unit").alias("meant"), F.col("rows").alias("meant_rows")), "meant", "left")
    frequent = (F.col("rows") >= OWN_ROWS) & (F.col("rows") * OWN_SHARE > F.coalesce("meant_rows", F.lit(0))) & ~F.startswith("meant", "unit")
    own = (F.col("unit") != F.col("meant")) & (F.col("listed").isNotNull() | frequent)
    alike = staged(alike.filter(~own).select("unit", "meant", "cost"), "alike")

    parted = staged(lists.select("k", F.explode(F.array_distinct("words")).alias("unit")), "parted")
    pairs = staged(skew_join(parted, alike, ["unit"]).groupBy("k").agg(F.collect_list(F.struct("unit", "meant", "cost")).alias("pairs")), "pairs")
    by_word = skew_join(pairs.select("k", F.explode(F.array_distinct("pairs.meant")).alias("anchor")), forms.select("anchor", "form"), ["anchor"]).select("k", "form")
    by_whole = skew_join(wholes, near.filter("kind = 'j'").select("unit", F.col("meant").alias("whole")), ["unit"]).join(forms.select("whole", "form"), "whole").select("k", "form")
    met = staged(by_word.unionByName(by_whole).distinct(), "met")

    @F.pandas_udf("cost double, jaccard double")
    def closeness(words_, meant_, pairs_):
        rows = []
        for a, b, near_ in zip(words_, meant_, pairs_):
            a, b = list(a), list(b)
            table = {(p["unit"], p["meant"]): p["cost"] for p in near_} if near_ is not None else {}
            if (c := value_cost(a, b, notes.value, lambda w, m: table.get((w, m)))) is None:  # noqa: B023
                rows.append((None, None))
            else:
                x, y = tokens_of("".join(sorted(without_remarks(a, notes.value)))), tokens_of("".join(sorted(b)))
                rows.append((c, len(x & y) / len(x | y)))
        return pd.DataFrame(rows, columns=["cost", "jaccard"], dtype="float64")

    whole = met.join(lists.select("k", "words"), "k").join(pairs, "k", "left").join(forms.select("form", "meant", "ref_id", "canonical"), "form")
    checked = whole.repartition(parts).select("k", "ref_id", "canonical", closeness("words", "meant", "pairs").alias("c")).filter("c.cost is not null and not isnan(c.cost)")
    best = checked.groupBy("k").agg(F.min(F.struct("c.cost", (-F.col("c.jaccard")).alias("unlike"), "ref_id", "canonical")).alias("b"))
    return raw.select("value", "k").join(best, "k").select("value", "b.ref_id", "b.canonical")


def mapped(targets: DataFrame, reference: DataFrame, key: str = "target_id") -> DataFrame:
    """(key, kind, value, ref_id, status) of every non-null field and label: status is exact, mapped or unmatched (ref_id null)."""
    out = None
    for kind, column in (("field", "pre_hz_field"), ("label", "pre_hz_label")):
        rows = staged(targets.select(key, F.col(column).alias("value")).dropna(subset=["value"]), f"values-{kind}")
        found = staged(map_values(rows, reference.filter(F.col("kind") == kind)), f"mapped-{kind}")
        status = F.when(F.col("ref_id").isNull(), "unmatched").when(F.col("value") == F.col("canonical"), "exact").otherwise("mapped")
        part = skew_join(rows, found, ["value"], "left").select(key, F.lit(kind).alias("kind"), "value", "ref_id", status.alias("status"))
        out = part if out is None else out.unionByName(part)
    return out
