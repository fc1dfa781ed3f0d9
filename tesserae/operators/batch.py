"""Many queries against all documents in one pass.

The distinct phrases of the queries form a tree of terms that every task has; a document's token arrays are run through
it, so that each document gives its phrases with their weighed counts, whatever the number of queries that ask for them.
A query (a set of phrases) is then looked for only in the documents of its rarest phrase, beside the phrases found
there, and each slice of documents gives on the best of every query alone: nothing of the size of queries times documents is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CANDIDATES = 1 << 21  # pairs of query and document looked at together


@dataclass
class PhraseTree:
    terms: pa.Array  # the distinct terms
    keys: np.ndarray  # node * number of terms + term, sorted
    children: np.ndarray
    phrase: np.ndarray  # by node, the phrase that ends there or -1
    size: int  # phrases

    @classmethod
    def of(cls, phrases: list[tuple[str, ...]]) -> PhraseTree:
        """Of distinct phrases, numbered by their place."""
        number: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for k, terms in enumerate(phrases):
            at = 0
            for t in terms:
                at = nodes.setdefault((at, number.setdefault(t, len(number))), len(nodes) + 1)
            ends[at] = k
        keys = np.array([node * len(number) + term for node, term in nodes], np.int64)
        order = np.argsort(keys)
        phrase = np.full(len(nodes) + 1, -1, np.int64)
        phrase[list(ends)] = list(ends.values())
        return cls(pa.array(list(number), pa.string()), keys[order], np.array(list(nodes.values()), np.int64)[order], phrase, len(phrases))

    def step(self, node: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The child of each node by a term, or -1."""
        key = node * len(self.terms) + term
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((term >= 0) & (self.keys[at] == key), self.children[at], -1)

    def places(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(row, phrase) of every place where a phrase starts; a token is its term, and its whole if it begins a compound."""
        flat, count = tokens.flatten(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = [pc.fill_null(pc.index_in(flat.field(k), value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("term", "whole")]
        row, end = np.repeat(np.arange(len(count)), count), np.repeat(np.cumsum(count), count)
        start, node, depth, found = np.arange(len(flat)), np.zeros(len(flat), np.int64), 0, []
        while len(start):
            going = [(start[hit], new[hit]) for k in ids for new in [self.step(node, k[start + depth])] for hit in [new >= 0]]
            start, node = (np.concatenate(x) for x in zip(*going))
            ends = self.phrase[node] >= 0
            found.append((row[start[ends]], self.phrase[node[ends]]))
            depth += 1
            inside = start + depth < end[start]
            start, node = start[inside], node[inside]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def phrases_of(tree: PhraseTree, weights: dict[str, float]):
    """(id, len, name, body as token arrays) -> (id, len, phrases, tf): the phrases of each document in order of number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(tree.places(b.column(k)), w) for k, w in weights.items()]
            keys, inverse = np.unique(np.concatenate([r * tree.size + p for (r, p), _ in each]), return_inverse=True)
            tf = np.bincount(inverse, np.concatenate([np.full(len(r), w) for (r, _), w in each]), len(keys))
            at = pa.array(np.searchsorted(keys, np.arange(b.num_rows + 1) * tree.size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in ((keys % tree.size).astype(np.int32), tf)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("len"), *lists], names=["id", "len", "phrases", "tf"])

    return run


@dataclass
class Asked:
    """Queries as phrases, the rarest first, ordered by it."""

    ids: np.ndarray
    phrases: np.ndarray  # of all queries, one after the other
    starts: np.ndarray  # where a query's phrases begin; one more at the end
    by_lead: np.ndarray  # where the queries led by a phrase begin; one more at the end

    @classmethod
    def of(cls, queries: dict[int, list[int]], df: np.ndarray) -> Asked:
        ranked = sorted((sorted(p, key=lambda k: (df[k], k)), q) for q, p in queries.items())
        sizes = np.array([len(p) for p, _ in ranked], np.int64)
        leads = np.array([p[0] for p, _ in ranked], np.int64)
        return cls(np.array([q for _, q in ranked], np.int64), np.array([k for p, _ in ranked for k in p], np.int64), np.concatenate([[0], np.cumsum(sizes)]), np.searchsorted(leads, np.arange(len(df) + 1)))

    def scored(self, ids: np.ndarray, keys: np.ndarray, part: np.ndarray, size: int, a: int, b: int) -> tuple[np.ndarray, ...]:
        """(query, id, score) of the documents that have all phrases, for the found phrases a to b as the rarest; keys are
        row * size + phrase of all found ones, part what each adds to a score."""
        lead = keys[a:b] % size
        count = self.by_lead[lead + 1] - self.by_lead[lead]
        entry = np.repeat(np.arange(a, b), count)
        query = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.by_lead[lead], count)
        score, row, k = part[entry], keys[entry] // size, 1
        while len(more := np.flatnonzero(self.starts[query] + k < self.starts[query + 1])):
            key = row[more] * size + self.phrases[self.starts[query[more]] + k]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            has = keys[at] == key
            score[more] += np.where(has, part[at], 0.0)
            keep = np.ones(len(query), bool)
            keep[more[~has]] = False
            query, score, row, k = query[keep], score[keep], row[keep], k + 1
        return query, ids[row], np.floor(score * 1e9 + 0.5) / 1e9


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < limit
    return query[keep], ids[keep], score[keep]


def best_of(asked: Asked, idf: np.ndarray, average: float, limit: int, k1: float, b: float):
    """(id, len, phrases, tf) -> (asked, id, score): of every slice the best `limit` documents of each query, by score to
    nine places and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, length = (x.column(k).to_numpy(zero_copy_only=False) for k in ("id", "len"))
            row = np.repeat(np.arange(len(ids)), pc.list_value_length(x.column("phrases")).to_numpy(zero_copy_only=False))
            phrase, tf = (x.column(k).flatten().to_numpy(zero_copy_only=False) for k in ("phrases", "tf"))
            keys = row * len(idf) + phrase
            part = idf[phrase] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / average))
            total = np.cumsum(asked.by_lead[phrase + 1] - asked.by_lead[phrase])
            cuts = np.searchsorted(total, np.arange(CANDIDATES, total[-1] if len(total) else 0, CANDIDATES), "right")
            edges = np.unique(np.concatenate([[0], cuts, [len(keys)]]))
            out = [_best(*asked.scored(ids, keys, part, len(idf), lo, hi), limit) for lo, hi in zip(edges, edges[1:])]
            if out:
                query, found, score = _best(*(np.concatenate(c) for c in zip(*out)), limit)
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[query]), pa.array(found), pa.array(score)], names=["asked", "id", "score"])

    return run
