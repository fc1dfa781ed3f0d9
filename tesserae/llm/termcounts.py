"""Counts of all terms and runs of terms: in how many places, in how many records.

Method: a suffix array with common-prefix intervals, over blocks of records. Suffixes (never past their record) are
sorted by their first terms with prefix doubling; the lengths of the common prefixes of neighbours cut the array into the
interval of each n-gram, for every n at once: single terms and longer runs are read off the same array. The length of an
interval is the number of occurrences, and subtracting the neighbours within the interval that belong to one record (the
suffix before of the same record is in it as well) gives the number of records. Blocks hold disjoint records, so their
counts add up; a block is a bounded number of terms, and only its counts are shuffled.

Defined results: null and empty values are no records; a value without terms is a record without terms; repeated rows
are separate records; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import slices
from ..session import spread
from .codes import Terms

BLOCK_TERMS = 2_000_000
SLICE_BYTES = 2 << 20


def suffix_array(codes: np.ndarray, record: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` codes or more, a shorter one before its extensions, and the terms left in
    the record of each place. codes are 0, 1, ..."""
    n = len(codes)
    ends = np.append(np.flatnonzero(record[1:] != record[:-1]), n - 1)
    left = np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n) + 1
    rank, width = codes.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable")
    while width < depth:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:]
        after[left <= width] = 0  # nothing of the record is left
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n, np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width *= 2
        if rank[order[-1]] == n:
            break  # all suffixes differ
    return order, left


def common_prefixes(codes: np.ndarray, left: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of the common prefix of each suffix in order with the one before it; 0 for the first."""
    a, b = order[:-1], order[1:]
    room = np.minimum(np.minimum(left[a], left[b]), most)
    length = np.zeros(len(codes), np.int32)
    live = np.arange(len(a))
    for k in range(most):
        live = live[room[live] > k]
        live = live[codes[a[live] + k] == codes[b[live] + k]]
        length[live + 1] = k + 1
    return length


def interval_counts(codes: np.ndarray, record: np.ndarray, most: int, depth: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length up to most: (length, place of one occurrence, occurrences, records) of every n-gram."""
    n = len(codes)
    if not n:
        return
    record = np.cumsum(np.append(0, record[1:] != record[:-1]))
    order, left = suffix_array(codes, record, max(most, depth))
    prefix = common_prefixes(codes, left, order, most)
    room, owner = left[order], record[order]
    # the suffix before in the array that starts in the same record
    by_record = np.argsort(owner, kind="stable")
    before = np.full(n, -1)
    same = owner[by_record][1:] == owner[by_record][:-1]
    before[by_record[1:][same]] = by_record[:-1][same]
    for d in range(1, most + 1):
        first = prefix < d  # a new interval
        interval = np.cumsum(first) - 1
        whole = room >= d
        again = whole & (before >= 0)
        again[again] = interval[before[again]] == interval[again]
        k = int(interval[-1]) + 1
        occurrences = np.bincount(interval[whole], minlength=k)
        duplicates = np.bincount(interval[again], minlength=k)
        start = order[np.flatnonzero(first)]
        real = occurrences > 0
        yield d, start[real], occurrences[real], (occurrences - duplicates)[real]


class _Block:
    """Terms of some records, held as numbers, with the letters of the distinct ones."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.hashes: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: np.ndarray, sizes: np.ndarray, words) -> None:
        names, at, codes = np.unique(hashes, return_index=True, return_inverse=True)
        self.codes.append(codes.reshape(-1))
        self.sizes.append(sizes)
        self.hashes.append(names)
        self.words.append(words(at))
        self.held += len(hashes)

    def counts(self, most: int, depth: int) -> Iterator[pa.RecordBatch]:
        every, at, back = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        words = pa.concat_arrays([w.cast(pa.string()) for w in self.words]).take(pa.array(at))
        shift = np.cumsum([0, *map(len, self.hashes)])
        codes = np.concatenate([back.reshape(-1)[s : s + len(h)][c] for s, h, c in zip(shift, self.hashes, self.codes)])
        sizes = np.concatenate(self.sizes)
        record = np.repeat(np.arange(len(sizes)), sizes)
        for d, start, occurrences, records in interval_counts(codes, record, most, depth):
            for a in range(0, len(start), 100_000):
                z = slice(a, a + 100_000)
                gram = [words.take(pa.array(codes[start[z] + k])) for k in range(d)]
                text = gram[0] if d == 1 else pa.compute.binary_join_element_wise(*gram, " ")
                yield pa.RecordBatch.from_arrays(
                    [text, pa.array(np.full(len(text), d, np.int32)), pa.array(occurrences[z].astype(np.int64)), pa.array(records[z].astype(np.int64))],
                    names=["term", "n", "occurrences", "records"],
                )


def _counts(most: int, depth: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in slices(batches, "value", SLICE_BYTES):
            col = b.column("value")
            if whole:  # every value is a record of one term
                names = col.dictionary_encode()
                hashes = np.array([xxhash.xxh64_intdigest(x) for x in names.dictionary.to_pylist()], np.uint64)
                block.add(hashes[names.indices.to_numpy()], np.ones(len(col), np.int64), partial(_pick, col))
            else:
                t = Terms(col)
                if len(t.hash):
                    block.add(t.hash, np.bincount(t.row, minlength=len(col)), t.text)
            if block.held >= BLOCK_TERMS:
                yield from block.counts(most, depth)
                block = _Block()
        if block.held:
            yield from block.counts(most, depth)

    return run


def _pick(col: pa.Array, at: np.ndarray) -> pa.Array:
    return col.take(pa.array(at))


def term_counts(df: DataFrame, column: str, max_n: int = 1, whole: bool = False, depth: int = 4) -> DataFrame:
    """(term, n, occurrences, records) of every run of 1..max_n terms of column; with whole, of every value as stored.

    depth: terms by which suffixes are ordered at least; max_n of them if that is more."""
    src = df.select(F.col(column).cast("string").alias("value")).filter("value is not null and value <> ''")
    part = spread(src).mapInArrow(_counts(max_n, depth, whole), "term string, n int, occurrences long, records long")
    return part.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_counts(fields: dict[str, tuple[DataFrame, str, bool]], limits: DataFrame) -> DataFrame:
    """(field, term, occurrences, records, mark) over fields {field: (table, column, whole)}; mark is 'rare' under
    limits.min_records records, 'common' above limits.max_percent of the field's records, else null. Of both, rare."""
    counts, totals = None, None
    for field, (df, column, whole) in fields.items():
        c = term_counts(df, column, 1, whole).select(F.lit(field).alias("field"), "term", "occurrences", "records")
        n = df.filter(F.col(column).isNotNull() & (F.col(column) != "")).agg(F.count("*").alias("total")).select(F.lit(field).alias("field"), "total")
        counts = c if counts is None else counts.unionByName(c)
        totals = n if totals is None else totals.unionByName(n)
    limits = limits.filter("field is not null").groupBy("field").agg(F.max("min_records").alias("min_records"), F.max("max_percent").alias("max_percent"))
    # one row per field on this side: bounded by the call
    rules = F.broadcast(totals.join(limits, "field", "left"))
    mark = F.when(F.col("records") < F.col("min_records"), "rare").when(F.col("records") * 100 > F.col("max_percent") * F.col("total"), "common")
    return counts.join(rules, "field", "left").select("field", "term", "occurrences", "records", mark.alias("mark"))
