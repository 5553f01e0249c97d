"""Text functions of chunking and retrieval; native expressions unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode-aware regular expressions see it, words, and units (words or single marks).
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"[\p{L}\p{N}_]+"
UNIT = rf"{WORD}|[^\p{{L}}\p{{N}}_{SPACE_CLASS}]"
#: Words that a query does without.
STOP_WORDS = (
    "a an and are as be by can does for from how in is it of on or the this to what when which who with "
    "extract identify list prepare state summarize entry matrix row"
).split()


def token_count(text: Column) -> Column:
    """The larger of the number of units and a third of the UTF-8 bytes, rounded up."""
    return F.greatest(unit_count(text), F.floor((F.octet_length(text) + 2) / 3).cast("int"))


def unit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("int")


def joined_count(units: Column, octets: Column, parts: Column, gap: int) -> Column:
    """token_count of parts joined by `gap` bytes of white space, from sums over them."""
    return F.greatest(units, F.floor((octets + gap * (parts - 1) + 2) / 3)).cast("int")


def stable_id(*parts: Column | str) -> Column:
    """24 hex digits of the SHA-256 of the parts, NUL between them; null parts count as empty."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\0", *cols), 256), 1, 24)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold_case(text: Column) -> Column:
    """Case folding of the scripts that lower() and one more rule cover."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze_lines(text: Column) -> Column:
    """Each line's tabs and spaces as single spaces, none at its ends; no empty lines around the text."""
    line = lambda x: F.trim(F.regexp_replace(x, r"[\t \x{a0}]+", " "))
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]", -1), line)
    return F.regexp_replace(F.array_join(lines, "\n"), rf"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def clean(text: Column, normalise: bool = True) -> Column:
    return squeeze_lines(nfkc(text) if normalise else text)


def normalized(text: Column) -> Column:
    """Only letters, digits and underscores, case folded."""
    return fold_case(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))


def margin_key(text: Column, normalise: bool = True) -> Column:
    """A margin's text with every number as #."""
    return F.regexp_replace(fold_case(clean(text, normalise)), r"\p{Nd}+", "#")


def query_tokens(query: Column) -> Column:
    """Words of a query without stop words (all, if nothing else is left), of the first 80 each once."""
    words = F.regexp_extract_all(query, F.lit(WORD), F.lit(0))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    telling = F.filter(words, lambda w: ~F.array_contains(stops, fold_case(w)))
    return F.array_distinct(F.slice(F.when(F.size(telling) > 0, telling).otherwise(words), 1, 80))


def query_variants(query: Column) -> Column:
    """Up to two other wordings: without the instruction around the subject, and with acronyms spelled out."""
    ends = r"^[ .?]+|[ .?]+$"
    bare = F.regexp_replace(query, r"(?i)^(?:please\s+)?(?:extract|identify|summarize|state|list|prepare)\s+", "")
    bare = F.regexp_replace(bare, r"(?i)\b(?:for|in)\s+the\s+(?:technical |commercial )?compliance[- ]matrix\b", "")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, rf"[{SPACE_CLASS}]+", " ")), ends, "")
    spelled = F.regexp_replace(F.regexp_replace(query, r"(?i)\bEMD\b", "earnest money deposit"), r"(?i)\bOEM\b", "original equipment manufacturer")
    first = F.when((bare != "") & (fold_case(bare) != fold_case(F.regexp_replace(query, ends, ""))), bare)
    return F.slice(F.array_distinct(F.array_compact(F.array(first, F.when(spelled != query, spelled)))), 1, 2)


def answer_text(text: Column) -> Column:
    """Case-folded words, one space between them."""
    return F.array_join(F.regexp_extract_all(fold_case(text), F.lit(WORD), F.lit(0)), " ")


@lru_cache(maxsize=1)
def _unmarked() -> tuple[str, str]:
    """Characters that change without their diacritics, and what they become; the marks themselves are at the end and become nothing.

    Made by rule over all of Unicode. A character of which several would remain (as Hangul syllables) stays as it is."""
    changed, plain, marks = [], [], []
    for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000))):
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c):
            rest = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if rest != c and len(rest) == 1:
                changed.append(c)
                plain.append(rest)
    return "".join(changed + marks), "".join(plain)


def plain_letters(text: Column) -> Column:
    """Lower case without diacritics, by one table of characters for all scripts."""
    return F.translate(F.lower(text), *_unmarked())


def index_terms(text: Column) -> Column:
    """Terms of the lexical index: lower case, without diacritics, letters and digits."""
    return F.regexp_extract_all(plain_letters(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit_vector(v: Column) -> Column:
    """A vector in doubles, brought to length 1."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


#: Texts of an Arrow batch that are Python's strings at once.
AT_ONCE = 128
_UNIT = re.compile(r"\w+|[^\w\s]")
_SENTENCE = re.compile(r"[.!?]\s+|\n\s*\n")
_GAP = re.compile(r"\s+")


def fitting_prefix(text: str, at: int, budget: int) -> int:
    """Where the longest prefix of text[at:] ends that has at most `budget` units and 3 * budget bytes, past its first character.

    Both counts grow with the prefix, so the end is the nearer of two places that are found directly."""
    octets, by_bytes = 0, len(text)
    for i in range(at, min(len(text), at + 3 * budget + 1)):
        octets += len(text[i].encode())
        if octets > 3 * budget:
            by_bytes = i
            break
    by_units = by_bytes
    for n, m in enumerate(_UNIT.finditer(text, at, by_bytes)):
        if n == budget:
            by_units = m.start()
            break
    return max(at + 1, min(by_bytes, by_units))


def split_text(text: str, budget: int) -> list[str]:
    """Parts of a text, each within the budget of token_count, that join to the text.

    A part ends behind its last sentence or blank line, else behind its last white space, if that lies beyond a third of what
    would fit; else where the budget ends."""
    out, at = [], 0
    while at < len(text):
        end = fitting_prefix(text, at, budget)
        if end < len(text):
            part = text[at:end]
            for stop in (_SENTENCE, _GAP):
                last = None
                for last in stop.finditer(part):
                    pass
                if last is not None and last.end() > len(part) // 3:
                    end = at + last.end()
                    break
        out.append(text[at:end])
        at = end
    return out or [text]


def split_parts(text: Column, budget: int) -> Column:
    """array<string> of split_text; texts within the budget don't go to Python. A few texts at a time are Python's strings."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(x: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        some = [pa.array([[] if t is None else split_text(t, budget) for t in x.slice(lo, AT_ONCE).to_pylist()], kind) for lo in range(0, len(x), AT_ONCE)]
        return pa.concat_arrays(some) if some else pa.array([], kind)

    return F.when(token_count(text) <= budget, F.array(text)).otherwise(cut(F.when(token_count(text) > budget, text)))
