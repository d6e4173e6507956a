"""One consistent form for text that looks the same (problem 1)."""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import DataFrame, functions as F

from tessera.functions.keys import ascii_key
from tessera.operators.skew import skew_join
from tessera.session import staged

#: Letters of other scripts that look like a plain Latin letter in most type faces.
LOOK_ALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Տ": "S", "Լ": "L",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "ɡ": "g", "ı": "i", "ɑ": "a",
}
#: Letters that only pass for a Latin one among Latin letters; used in words that mix scripts, after the others.
SIMILAR = {"α": "a", "γ": "y", "η": "n", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "к": "k", "м": "m", "т": "t", "п": "n", "г": "r", "в": "b", "н": "h", "ⲁ": "a", "ⲉ": "e", "ⲓ": "i", "ⲕ": "k"}
#: By rule: Latin small capitals are read as the letter their name gives.
SIMILAR |= {chr(n): m.group(1).lower() for n in range(0x1D00, 0x1D26) if (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(chr(n), "")))}
_BLANKS = "\u0085                 　"
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}￹-￻]")
_HYPHENS = "﹣－"
#: Characters read as others: blanks, hyphens as the Unicode compatibility forms have them (the hyphen U+2010 and the dashes are characters of
#: their own there, not the hyphen-minus), and by rule the compatibility forms of full and half width,
#: of mathematical and letter-like alphabets, the ligatures and the micro sign.
_READ = {ord(c): " " for c in _BLANKS} | {ord(c): "-" for c in _HYPHENS} | {0x2011: "\u2010"}
for _c in [*range(0xFF01, 0xFFEF), *range(0xFB00, 0xFB07), 0xB5, *range(0x1D400, 0x1D800), *range(0x2100, 0x2150)]:
    if _c < 0x2100 or _c > 0x214F or len(unicodedata.normalize("NFKC", chr(_c))) == 1:
        _READ.setdefault(_c, unicodedata.normalize("NFKC", chr(_c)))
_WORD = regex.compile(r"[\p{L}\p{M}]+")


def cleaned(text: str) -> str:
    """Blanks as spaces, no invisible characters, width and ligature forms plain, accents composed; letters keep their script."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", _INVISIBLE.sub("", text.translate(_READ)))


def script(c: str) -> str:
    """The script of a letter as far as look-alikes need it; '' for marks."""
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n <= 0x1EFF or 0x250 <= n <= 0x2AF or 0x1D00 <= n <= 0x1D25:
        return "latin"
    if 0x300 <= n <= 0x36F:
        return ""
    if 0x370 <= n <= 0x3FF or 0x1F00 <= n <= 0x1FFF:
        return "greek"
    if 0x400 <= n <= 0x52F:
        return "cyrillic"
    if 0x13A0 <= n <= 0x13FF:
        return "cherokee"
    if 0x2C80 <= n <= 0x2CFF:
        return "coptic"
    return "armenian" if 0x530 <= n <= 0x58F else "other"


#: What ``visual_forms`` looks at on the JVM: the ranges of the letters above.
_FOREIGN = r"[\x{131}\x{250}-\x{2af}\x{370}-\x{58f}\x{13a0}-\x{13ff}\x{1d00}-\x{1d25}\x{1f00}-\x{1fff}\x{2c80}-\x{2cff}]"
_LATIN_TO = {s: {v: k for k, v in LOOK_ALIKES.items() if script(k) == s} for s in ("greek", "cyrillic", "armenian", "cherokee", "coptic")}


def scripts(text: str) -> dict[str, int]:
    """Letters by script."""
    counts: dict[str, int] = {}
    for c in unicodedata.normalize("NFD", text):
        if c.isalpha() and (s := script(c)):
            counts[s] = counts.get(s, 0) + 1
    return counts


def readings(word: str) -> list[str]:
    """Other readings of a word with look-alikes, that of its dominant script first; none if it has none.

    All its letters of other scripts must be look-alikes for a Latin reading, all its Latin ones for another script's. In a
    word that mixes scripts, letters that are only similar are read too, but no such reading comes before one without.
    """
    counts = scripts(word)
    variants = any(c in LOOK_ALIKES or c in SIMILAR for c in word)
    if set(counts) <= {"latin"} and not variants:
        return []
    out: list[str] = []
    parts = unicodedata.normalize("NFD", word)
    for table in (LOOK_ALIKES, SIMILAR | LOOK_ALIKES) if len(counts) > 1 or set(counts) == {"latin"} else (LOOK_ALIKES,):
        for s in sorted(counts.keys() | {"latin"}, key=lambda s: (-counts.get(s, 0), s)):
            if s == "latin":
                made = "".join(table.get(c, c) for c in parts)
            elif s in _LATIN_TO and len(counts) > 1:
                made = "".join(_LATIN_TO[s].get(c, c) for c in parts)
            else:
                continue
            made = unicodedata.normalize("NFC", made)
            if made != word and made not in out and set(scripts(made)) == {s}:
                out.append(made)
    return out


def latin(text: str) -> str:
    """The text with every word that has a Latin reading in that reading, whatever the vocabulary."""
    if text.isascii():
        return text

    def one(m):
        word = m.group()
        made = unicodedata.normalize("NFC", "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", word)))
        return made if all(script(c) in ("latin", "") for c in unicodedata.normalize("NFD", made)) else word

    return _WORD.sub(one, text)


def visual_forms(texts: DataFrame, column: str = "text") -> DataFrame:
    """(text, form) for the distinct non-null texts: the one consistent form of what the text looks like.

    Blanks, invisible characters, widths and accents are settled alone. Look-alike letters are replaced word by word, the
    reading of the word's dominant script first, only where the result is in the corpus vocabulary: the words of all texts
    as they are written, but those of look-alikes. A word is asked about if it mixes scripts; a word of look-alikes of one
    script only where the text around it has letters of another script and no text without look-alikes has that word. Visible
    differences (an accent, a letter, a hyphen) stay. An empty text has an empty form; a text of any length is handled
    word by word; a word in a third of all texts is no hot spot.
    """
    @F.pandas_udf("string")
    def clean(s):
        return s.map(cleaned)

    @F.pandas_udf("array<struct<word: string, mixed: boolean, made: array<string>>>")
    def suspects(s):
        def one(text):
            around = set(scripts(text))
            found = []
            for w in set(_WORD.findall(text)):
                if made := readings(w):
                    own = scripts(w)
                    if len(own) > 1 or set(own) == {"latin"} or around - set(own):
                        found.append({"word": w, "mixed": len(own) > 1 or set(own) == {"latin"}, "made": made})
            return found

        return s.map(one)

    @F.pandas_udf("string")
    def replaced(s, words, made):
        import pandas as pd

        out = []
        for text, w, m in zip(s, words, made):
            table = dict(zip(w, m))
            out.append(_WORD.sub(lambda x: table.get(x.group(), x.group()), text))
        return pd.Series(out)

    plain = ~F.col("text").rlike(r"[^\x00-\x7f]")
    distinct = texts.select(F.col(column).alias("text")).dropna().distinct()
    ascii_only = distinct.filter(plain).withColumn("clean", F.col("text"))
    other = distinct.filter(~plain).withColumn("clean", clean("text"))
    forms = staged(ascii_only.unionByName(other), "clean")

    foreign = forms.filter(F.col("clean").rlike(_FOREIGN))
    asked = staged(foreign.withColumn("x", F.explode(suspects("clean"))).select("text", "clean", "x.word", "x.mixed", "x.made"), "suspects")
    words = staged(asked.select("word", "mixed", "made").distinct().select("word", "mixed", F.posexplode("made").alias("rank", "made")).withColumn("low", F.lower("made")), "readings")
    all_words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("clean"), F.lit(r"[\p{L}\p{M}]+"), 0)).alias("low")).distinct()
    odd = words.select(F.lower("word").alias("low")).distinct()
    # A lower-cased capital such as that of a Greek letter may be a word of the corpus: words of suspects only count where other texts have them.
    own = staged(all_words(forms.join(asked.select("text").distinct(), "text", "left_anti")), "own-words")
    vocabulary = all_words(forms).join(odd, "low", "left_anti").unionByName(own).distinct()
    kept = words.filter("not mixed").select("word", F.lower("word").alias("low")).distinct().join(own, "low", "left_semi").select("word")
    repair = staged(words.join(vocabulary, "low", "left_semi").join(kept, "word", "left_anti").groupBy("word").agg(F.min_by("made", "rank").alias("right")), "repair")
    mended = skew_join(asked.select("text", "clean", "word"), repair, ["word"]).groupBy("text", "clean").agg(F.collect_list("word").alias("w"), F.collect_list("right").alias("m"))
    mended = mended.select("text", replaced("clean", "w", "m").alias("mended"))
    return forms.join(mended, "text", "left").select("text", F.coalesce("mended", "clean").alias("form"))


def look_up(targets: DataFrame, entries: DataFrame) -> DataFrame:
    """(target_id, entry_id): labels and label entries with one key as they look, where the stored key does not find the entry.

    Forms are made for distinct texts only; a label in a third of all rows meets its matches by broadcast. Null labels
    and keys match nothing; repeated rows give their pairs again under their own ids.
    """
    labels = staged(targets.select("target_id", F.col("pre_hz_label").alias("text")).dropna(), "labels")
    keys = staged(entries.filter("index_name = 'label'").select("entry_id", F.col("lookup_key").alias("text")).dropna(), "keys")
    forms = staged(visual_forms(labels.select("text").unionByName(keys.select("text"))).select("text", ascii_key(F.col("form")).alias("key")), "forms")
    left = labels.select("text").distinct().join(forms, "text").withColumn("stored", ascii_key(F.col("text")))
    right = keys.join(forms, "text").select("entry_id", "key", F.col("text").alias("lookup_key"))
    matches = left.join(right, "key").filter("stored <> lookup_key").select("text", "entry_id")
    return skew_join(labels, staged(matches, "matches"), ["text"]).select("target_id", "entry_id")
