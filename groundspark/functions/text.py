"""Text expressions: tokens, estimates, labels, normalisation. All are built-in column functions but NFC, folding and marks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: letters and digits as the tokenizer sees them, on Java and RE2 alike.
TOKEN = r"[0-9]+|[\p{L}\p{Nl}\p{No}]+"
SPACE = r"(?U)[\s\x1C-\x1F]"
CHARS_PER_TOKEN = 3.5


#: Characters of texts that are in NFC for certain: Latin letters as they stand, marks of punctuation, currency signs.
QUICK = r"^[\x{0}-\x{2FF}\x{1E00}-\x{1E99}\x{1EA0}-\x{1EFF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}]*\z"


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Unicode NFC, which Spark has no function for: only texts that a pattern can't vouch for go to Python; null stays null."""
    quick = text.rlike(QUICK)
    return F.when(quick, text).otherwise(_nfc(F.when(~quick, text)))


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def tokens(text: Column) -> Column:
    """Lower-case words and numbers, in order; text is NFC."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bag(words: Column) -> Column:
    """Words, then each pair of neighbours joined by _; repeats stay."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws("_", a, b))
    return F.when(n > 1, F.concat(words, pairs)).otherwise(words)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("int"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1C-\x1F]+"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 when a side is empty."""
    union = F.size(F.array_union(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def scalar(raw: Column) -> Column:
    """A frontmatter value: null, ~ and nothing are null; one layer of matching quotes goes."""
    value = strip(raw)
    unquoted = F.regexp_replace(value, "(?s)^\"(.*)\"$|^'(.*)'$", "$1$2")
    return F.when(value.isin("null", "~", ""), None).otherwise(unquoted)


#: Fixed: characters that extraction leaves behind, and what stands for them.
CHARACTER_FIXES = {
    "\ufeff": "", "\u00a0": " ", "\u00ad": "",
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2013": "-", "\u2014": "-", "\u2012": "-", "\u2015": "-",
}


def clean_characters(text: Column) -> Column:
    one = {k: v for k, v in CHARACTER_FIXES.items() if v}
    none = [k for k, v in CHARACTER_FIXES.items() if not v]
    return F.translate(text, "".join([*one, *none]), "".join(one.values()))


def squeeze_blanks(text: Column) -> Column:
    """Runs of blanks as one, nothing blank at line ends, and at most one empty line in a row, at the text's ends too."""
    out = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "(?U)[^\\S\n]+(?=\n|\\z)", "")
    for run, left in (("\\A\n+\\z", ""), ("\\A\n{2,}", "\n"), ("\n{2,}\\z", "\n"), ("\n{3,}", "\n\n")):
        out = F.regexp_replace(out, run, left)
    return out


class _Folding(dict):
    """What a character becomes, found when it is first met: lower case, and without marks where accents go."""

    def __init__(self, accents: bool):
        super().__init__()
        self.accents = accents

    def __missing__(self, code: int) -> str:
        piece = chr(code).lower()
        if not self.accents:
            piece = "".join(c for c in unicodedata.normalize("NFD", piece) if not unicodedata.combining(c)).replace("đ", "d")
        self[code] = piece
        return piece


_FOLDINGS = {accents: _Folding(accents) for accents in (False, True)}
_INTS = T.ArrayType(T.IntegerType())
FOLDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("at", _INTS), T.StructField("by", _INTS)])


def fold(text: str, accents: bool = False) -> tuple[str, list[int], list[int]]:
    """The folded text, and where in it (at) the distance to the place in the source changes, to what (by).

    Most letters fold to one character, so most texts have no such places.
    """
    table = _FOLDINGS[accents]
    folded = text.translate(table)
    odd = {c for c in set(text) if len(table[ord(c)]) != 1}
    at, by, shift = [], [], 0
    for j, c in enumerate(text) if odd else ():
        if c not in odd:
            continue
        n, here = len(table[ord(c)]), j - shift
        if n == 0:
            shift += 1
            at.append(here)
            by.append(shift)
        for extra in range(1, n):
            shift -= 1
            at.append(here + extra)
            by.append(shift)
    return folded, at, by


def _folded(texts: pd.Series, accents: bool) -> pd.DataFrame:
    made = [(None, None, None) if t is None else fold(t, accents) for t in texts]
    return pd.DataFrame(made, columns=["text", "at", "by"])


@F.pandas_udf(FOLDED)
def folded(texts: pd.Series) -> pd.DataFrame:
    """struct (text, at, by): lower case without accents and marks, as Unicode decomposes them; see `fold`."""
    return _folded(texts, accents=False)


@F.pandas_udf(FOLDED)
def lowered(texts: pd.Series) -> pd.DataFrame:
    """struct (text, at, by): lower case only."""
    return _folded(texts, accents=True)


def source_offset(at: Column, by: Column, place: Column) -> Column:
    """Where in the source the character at `place` of a folded text comes from; of several changes at one place the last holds."""
    return place + F.coalesce(F.get(by, F.size(F.filter(at, lambda a: a <= place)) - 1), F.lit(0))


def literal_pattern(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def excerpt(text: Column, start: Column, length: Column, width: int = 300, marks: tuple[str, str] = ("", "")) -> Column:
    """`width` characters around a hit, the hit between marks, on one line, with dots where text is left out."""
    n, w = F.length(text), F.lit(width)
    margin = F.greatest(F.lit(0), F.floor((w - length) / 2).cast("int"))
    hi = F.when(n <= w, n).otherwise(F.least(n, F.greatest(start - margin, F.lit(0)) + w))
    lo = F.when(n <= w, 0).otherwise(F.greatest(F.lit(0), hi - w))
    a, b = F.greatest(lo, start), F.least(hi, start + length)
    cut = lambda s, e: F.substring(text, s + 1, F.greatest(e - s, F.lit(0)))
    body = F.when(a < b, F.concat(cut(lo, a), F.lit(marks[0]), cut(a, b), F.lit(marks[1]), cut(b, hi))).otherwise(cut(lo, hi))
    return F.replace(F.concat(F.when(lo > 0, "…").otherwise(""), body, F.when(hi < n, "…").otherwise("")), F.lit("\n"), F.lit(" "))


@F.pandas_udf(T.LongType())
def marked_characters(texts: pd.Series) -> pd.Series:
    """Characters that are đ or Đ, or that Unicode decomposes into something with a mark."""
    marked = lambda c: c in "đĐ" or any(map(unicodedata.combining, unicodedata.normalize("NFD", c)))
    return texts.map(lambda t: None if t is None else sum(t.count(c) for c in set(t) if marked(c)))


def diacritic_ratio(text: Column) -> Column:
    """Share of marked characters; 0 for an empty text."""
    return F.when(F.length(text) > 0, marked_characters(text) / F.length(text)).otherwise(0.0)
