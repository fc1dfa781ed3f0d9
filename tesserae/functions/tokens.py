"""Identifier-aware tokens as columns, and the same for query strings.

Base tokens are runs of letters and numbers, without accents and lower-cased. An ASCII token of 2 to 256 characters with
inner boundaries (camelCase, ACRONYMWord, letter/digit) becomes its segments at consecutive positions; in an index the
whole token also stands at the position of its first segment, without adding to the length of the text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
BOUNDARY = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
MAX_SEGMENTS = 64


@cache
def _accents() -> tuple[str, str]:
    """Letters with marks and their bare letters, from the canonical decompositions."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        bare = [c for c in unicodedata.normalize("NFD", chr(cp)) if unicodedata.category(c) != "Mn"]
        if len(bare) == 1 and bare[0] != chr(cp) and chr(cp).isalpha():
            pairs.append((chr(cp), bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), *_accents())


def fold_text(s: str) -> str:
    return s.lower().translate(str.maketrans(*_accents()))


def _segmented(t: Column) -> Column:
    return t.rlike(r"^[A-Za-z0-9]{2,256}$") & t.rlike(BOUNDARY)


def index_tokens(text: Column) -> Column:
    """array<struct<term, whole>> in order of position; whole is set at the first segment of a compound."""

    def one(t: Column) -> Column:
        parts = F.split(t, BOUNDARY, MAX_SEGMENTS)
        return F.when(
            _segmented(t),
            F.transform(parts, lambda s, i: F.struct(F.lower(s).alias("term"), F.when(i == 0, F.lower(t)).alias("whole"))),
        ).otherwise(F.array(F.struct(fold(t).alias("term"), F.lit(None).cast("string").alias("whole"))))

    return F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), one))


_TOKEN = regex.compile(TOKEN)
_BOUNDARY = re.compile(BOUNDARY)


def query_tokens(text: str) -> list[str]:
    """Terms of a query word: segments only."""
    out: list[str] = []
    for t in _TOKEN.findall(text):
        if re.fullmatch(r"[A-Za-z0-9]{2,256}", t) and _BOUNDARY.search(t):
            out += [s.lower() for s in _BOUNDARY.split(t, MAX_SEGMENTS - 1)]
        else:
            out.append(fold_text(t))
    return out


def trigrams(text: Column) -> Column:
    """All substrings of three characters, lower-cased, in one pass over the text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?s)(?=(.{3}))."), 1)
