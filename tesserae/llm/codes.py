"""Arrow strings as numpy code points, and terms as hashes, without a Python string per row or term."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex

from ..functions.arrays import mixed, terms_of

_WIDE = 0x110000  # stands for the lower case of U+0130, which is two characters
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def parts_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def code_points(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets of the rows among them."""
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.int32), ends
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    code = raw[at].astype(np.int32)
    wide = np.flatnonzero(code >= 0xC0)
    place, first = at[wide], code[wide]
    follow = [np.append(raw, np.zeros(3, np.uint8))[place + k].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two = (first & 0x1F) << 6 | follow[0]
    three = (first & 0x0F) << 12 | follow[0] << 6 | follow[1]
    four = (first & 0x07) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2]
    code[wide] = np.where(first < 0xE0, two, np.where(first < 0xF0, three, four))
    return code, np.append(0, np.cumsum(lead))[ends]


def utf8(code: np.ndarray, ends: np.ndarray) -> pa.Array:
    """String column of rows of code points."""
    code = code.astype(np.int32, copy=False)
    if not len(code) or code.max() < 0x80:
        raw, size = code.astype(np.uint8), ends
    else:
        n = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        stop = np.append(0, np.cumsum(n))
        size, start = stop[ends], stop[:-1]
        raw = np.empty(int(stop[-1]), np.uint8)
        one = n == 1
        raw[start[one]] = code[one]
        for k, mark in ((2, 0xC0), (3, 0xE0), (4, 0xF0)):
            hit = np.flatnonzero(n == k)
            c, s = code[hit], start[hit]
            raw[s] = mark | c >> 6 * (k - 1)
            for j in range(1, k):
                raw[s + j] = 0x80 | c >> 6 * (k - 1 - j) & 0x3F
    small = size[-1] < 1 << 31
    buffers = [None, pa.py_buffer(size.astype(np.int32 if small else np.int64)), pa.py_buffer(raw)]
    return pa.Array.from_buffers(pa.string() if small else pa.large_string(), len(ends) - 1, buffers)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether terms hold it, its lower case, and a hash."""
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    inside = np.zeros(_WIDE + 1, bool)
    inside[[ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, every)))]] = True
    inside[_WIDE] = True
    lower = np.arange(_WIDE + 1, dtype=np.int32)
    for c in every:
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    lower[0x130] = _WIDE
    return inside, lower, mixed(np.arange(1, _WIDE + 2, dtype=np.uint64))


class Terms:
    """The terms of a string column in order: hash and row of each, and its letters for writing it out."""

    def __init__(self, col: pa.Array) -> None:
        inside, lower, hashes = _tables()
        raw, ends = parts_of(col)
        code, ends = code_points(raw, ends)
        if (code == 0x3A3).any():  # the lower case of a sigma depends on its place in the term
            words = [terms_of(t) for t in col.to_pylist()]
            flat = [w.replace("i̇", chr(0x130)) for ws in words for w in ws]
            row = np.repeat(np.arange(len(words)), [len(w) for w in words])
            code = lower[np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.int32)]
            stop = np.cumsum([len(w) for w in flat], dtype=np.int64) if flat else np.empty(0, np.int64)
            start = np.append(0, stop)[:-1]
        else:
            at = np.flatnonzero(inside[code])
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            edge = np.isin(at, ends[1:-1]) if len(ends) < 64 else _member(at, ends[1:-1], len(code))
            new |= edge  # a term ends with its row
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(at))
            row = np.searchsorted(ends, at[start], "right") - 1
            code = lower[code[at]]
        self.code, self.start, self.stop, self.row = code, start, stop, row
        size = stop - start
        self.hash = np.empty(0, np.uint64)
        if len(start):
            with np.errstate(over="ignore"):
                power = np.cumprod(np.full(int(size.max()), _FACTOR | np.uint64(1), np.uint64))
                place = np.arange(len(code)) - np.repeat(start, size)
                total = np.add.reduceat(hashes[code] * power[place], start)
                self.hash = mixed(total + size.astype(np.uint64) * _FACTOR)

    def text(self, which: np.ndarray) -> pa.Array:
        """Terms by number, as strings."""
        size = (self.stop - self.start)[which]
        ends = np.append(0, np.cumsum(size))
        at = np.arange(int(ends[-1])) + np.repeat(self.start[which] - ends[:-1], size)
        code = self.code[at]
        if (code == _WIDE).any():
            letters = np.array(["".join("i̇" if c == _WIDE else chr(c) for c in code[a:b]) for a, b in zip(ends, ends[1:])], object)
            return pa.array(letters, pa.string())
        return utf8(code, ends)


def _member(values: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    flag = np.zeros(n + 1, bool)
    flag[places] = True
    return flag[values]
