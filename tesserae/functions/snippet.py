"""Highlighted excerpts.

The excerpt of a body is the window of twelve tokens with the most distinct phrases (the earliest of equals; a lone hit
has five tokens before it), matched tokens in brackets, an ellipsis at each end that leaves text out. Without a match in
the body it is the first twelve tokens, unmarked. Null or empty bodies give an empty excerpt.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.query import Phrase
from .tokens import query_tokens

_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
WIDTH, BEFORE = 12, 5


def excerpt(body: str | None, wanted: list[Phrase], width: int = WIDTH, marks: tuple[str, str] = ("[", "]")) -> str:
    spans = [m.span() for m in _TOKEN.finditer(body or "")]
    if not spans:
        return ""
    terms: list[str] = []  # segments, and the token each belongs to
    owner: list[int] = []
    for k, (a, b) in enumerate(spans):
        for t in query_tokens(body[a:b]):
            terms.append(t)
            owner.append(k)
    hits: list[tuple[int, int, int]] = []  # phrase, first token, last token
    for p, phrase in enumerate(wanted):
        n = len(phrase.terms)
        for i in range(len(terms) - n + 1):
            if all(terms[i + j] == phrase.terms[j] or j == n - 1 and phrase.prefix and terms[i + j].startswith(phrase.terms[j]) for j in range(n)):
                hits.append((p, owner[i], owner[i + n - 1]))
    start = 0
    if hits:
        best = -1
        for _, first, _ in hits:
            a = max(0, min(first - BEFORE, len(spans) - width))
            inside = {p for p, x, y in hits if a <= x and y < a + width}
            if len(inside) > best:
                best, start = len(inside), a
    end = min(len(spans), start + width)
    marked = {k for _, x, y in hits for k in range(x, y + 1) if start <= x and y < end}
    out = "" if start == 0 else "…"
    at = 0 if start == 0 else spans[start][0]
    for k in range(start, end):
        a, b = spans[k]
        out += body[at:a] + (marks[0] + body[a:b] + marks[1] if k in marked else body[a:b])
        at = b
    return out + (body[at:] if end == len(spans) else "…")


def with_snippets(hits: DataFrame, docs: DataFrame, wanted: list[Phrase], width: int = WIDTH, marks: tuple[str, str] = ("[", "]")) -> DataFrame:
    """hits (few rows, with id) with a column snippet; bodies are fetched for the hits only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "snippet": [excerpt(b, wanted, width, marks) for b in pdf["body"]]})

    bodies = docs.select("id", "body").join(F.broadcast(hits.select("id")), "id", "left_semi")
    return hits.join(bodies.mapInPandas(run, "id long, snippet string"), "id", "left")
