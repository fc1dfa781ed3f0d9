"""Arrow columns as numpy arrays of code points, terms and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

#: A term: a longest run of letters and numbers.
TERM = regex.compile(r"[\p{L}\p{N}]+")


def terms_of(text: str | None) -> list[str]:
    """Lower-cased terms. Lower-casing the whole text first is the same but for two characters whose lower case
    depends on or adds neighbours; such texts are lower-cased term by term."""
    if not text:
        return []
    if "İ" in text or "Σ" in text:
        return [t.lower() for t in TERM.findall(text)]
    return TERM.findall(text.lower())


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices whose strings in column have at most max_bytes (or one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(column)
        wide = pa.types.is_large_string(col.type)
        ends = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(ends, int(ends[at]) + max_bytes, "right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (shift-multiply avalanche)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(h.astype(np.uint64))


def run_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of width consecutive values of codes (uint64)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n] + np.uint64(k + 1))
    return h
