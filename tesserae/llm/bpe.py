"""Byte-level BPE with a rank queue in a hierarchical bitmap.

All pre-tokens that a batch has not seen before lie in one linked list of symbols, kept apart by separators. A bucket for
each merge rank holds the list positions of pairs with that rank; a three-level bitmap over the ranks finds the lowest
non-empty bucket by find-first-set. Its merges are done from left to right, for many words as one array operation; entries
whose symbols have changed since are stale and skipped. Work is linear in the merges, for a pre-token of 100,000 bytes as for one of five.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import regex

TOKENIZER_DIR = os.environ.get("TESSERAE_TOKENIZERS", "/opt/tokenizers")

#: The public pre-token pattern of the byte-level tokenizers, and the same for texts of ASCII only.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"

_SEPARATOR, _DEAD = 0xFFFF, 0xFFFE
MANY = 10_000  # symbols of a list from which on whole buckets are merged as arrays; the ids are the same either way


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 stands for itself, the others
    take code points from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    fresh = iter(range(256, 512))
    return [chr(b if b in plain else next(fresh)) for b in range(256)]


class RankBitmap:
    """A set of ranks below 64**3 with find-first-set."""

    def __init__(self) -> None:
        self.low = [0] * 4096
        self.mid = [0] * 64
        self.top = 0

    def add(self, rank: int) -> None:
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def pop(self) -> int:
        """Remove and return the lowest rank, or -1."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        m = self.mid[b]
        a = (b << 6) | ((m & -m).bit_length() - 1)
        w = self.low[a]
        rank = (a << 6) | ((w & -w).bit_length() - 1)
        self.low[a] = w = w & (w - 1)
        if not w:
            self.mid[b] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank


class BytePairEncoder:
    """Encodes with the vocabulary file `name`.json; keeps at most max_known pre-tokens."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, max_known: int = 400_000) -> None:
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        symbols = _byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.byte_id = np.array([vocab[c] for c in symbols], np.int64)
        self.id_bytes = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.pair: dict[int, int] = {}
        merged = []
        made = {int(i): -1 for i in self.byte_id}
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            # new pairs rank after the merge that makes them, so buckets are emptied in ascending order
            if made.get(a, rank) >= rank or made.get(b, rank) >= rank:
                raise ValueError("merges refer to later merges")
            made.setdefault(c, rank)
            self.pair.setdefault(a << 16 | b, rank)
            merged.append((a, b, c))
        if max(vocab.values()) >= _DEAD or len(merged) > 64**3:
            raise ValueError("vocabulary too large")
        self.merged = merged
        keys = np.array(sorted(self.pair), np.int64)
        self._keys, self._ranks = keys, np.array([self.pair[int(k)] for k in keys], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}
        self.max_known = max_known
        self._any, self._ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN)

    def split(self, text: str) -> list[str]:
        return (self._ascii if text.isascii() else self._any).findall(text)

    def _merge(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        n = int(sizes.sum()) + len(raw)
        start = np.cumsum(sizes + 1) - sizes - 1
        gaps = start + sizes
        body = np.ones(n, bool)
        body[gaps] = False
        symbol = np.full(n, _SEPARATOR, np.int64)
        symbol[body] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        keys = symbol[:-1] << 16 | symbol[1:]
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        hit = np.flatnonzero(self._keys[at] == keys)
        rank = self._ranks[at[hit]]
        order = np.argsort(rank, kind="stable")
        queue = RankBitmap()
        if len(order):
            rank, hit = rank[order], hit[order]
            cut = np.append(0, np.flatnonzero(rank[1:] != rank[:-1]) + 1)
            filled = dict(zip(rank[cut].tolist(), np.split(hit, cut[1:])))
            for r in filled:
                queue.add(r)
            symbol = (self._merge_many if n > MANY else self._merge_few)(symbol, queue, filled)
        live = symbol != _DEAD
        place = np.cumsum(live)
        flat = symbol[live].tolist()
        heads = (place[start] - 1).tolist()
        tails = (place[gaps] - 1).tolist()
        return [tuple(flat[i:j]) for i, j in zip(heads, tails)]

    def _merge_few(self, symbol: np.ndarray, queue: RankBitmap, filled: dict[int, np.ndarray]) -> np.ndarray:
        """Empty the queue place by place; for short lists."""
        n = len(symbol)
        buckets = {r: p.tolist() for r, p in filled.items()}
        sym = symbol.tolist()
        after = list(range(1, n + 1))
        prior = list(range(-1, n - 1))
        pair, merged, pop, add = self.pair.get, self.merged, queue.pop, queue.add
        while (r := pop()) >= 0:
            a, b, c = merged[r]
            for p in sorted(buckets.pop(r)):
                q = after[p]
                if sym[p] != a or sym[q] != b:
                    continue  # stale
                sym[p], sym[q] = c, _DEAD
                after[p] = q = after[q]
                prior[q] = p
                for at, key in ((p, c << 16 | sym[q]), (prior[p], sym[prior[p]] << 16 | c)):
                    k = pair(key)
                    if k is not None and at >= 0:
                        if k in buckets:
                            buckets[k].append(at)
                        else:
                            buckets[k] = [at]
                            add(k)
        return np.array(sym, np.int64)

    def _merge_many(self, symbol: np.ndarray, queue: RankBitmap, filled: dict[int, np.ndarray]) -> np.ndarray:
        """Empty the queue a bucket at a time; for long lists of many words, or very long words."""
        n = len(symbol)
        sym = np.append(symbol, _SEPARATOR)
        after, prior = np.arange(1, n + 2), np.arange(-1, n)
        buckets = {r: [p] for r, p in filled.items()}
        keys, ranks, last = self._keys, self._ranks, len(self._keys) - 1
        while (r := queue.pop()) >= 0:
            a, b, c = self.merged[r]
            held = buckets.pop(r)
            p = held[0] if len(held) == 1 else np.concatenate(held)
            q = after[p]
            p = p[(sym[p] == a) & (sym[q] == b)]  # the others are stale
            if not len(p):
                continue
            if len(held) > 1 or a == b:
                p = np.unique(p)
            if a == b:  # of a run of equal symbols every second pair merges, from the left
                q = after[p]
                linked = np.append(False, q[:-1] == p[1:])
                first = np.maximum.accumulate(np.where(linked, 0, np.arange(len(p))))
                p = p[(np.arange(len(p)) - first) % 2 == 0]
            q = after[p]
            sym[p], sym[q] = c, _DEAD
            q = after[q]
            after[p] = q
            prior[q] = p
            left = prior[p]
            at = np.concatenate([p, left])
            key = np.concatenate([c << 16 | sym[q], sym[left] << 16 | c])
            i = np.minimum(np.searchsorted(keys, key), last)
            hit = (keys[i] == key) & (at >= 0)
            if not hit.any():
                continue
            at, new = at[hit], ranks[i[hit]]
            if len(new) > 1:
                order = np.argsort(new, kind="stable")
                at, new = at[order], new[order]
                cut = np.append(0, np.flatnonzero(new[1:] != new[:-1]) + 1)
                found = zip(new[cut].tolist(), np.split(at, cut[1:]))
            else:
                found = ((int(new[0]), at),)
            for k, places in found:
                if k in buckets:
                    buckets[k].append(places)
                else:
                    buckets[k] = [places]
                    queue.add(k)
        return sym[:n]

    def learn(self, pieces: list[list[str]]) -> None:
        """Make every pre-token of pieces known."""
        known = self.known
        fresh = list({w for p in pieces for w in p if w not in known})
        if len(known) + len(fresh) > self.max_known:
            known.clear()
            fresh = list({w for p in pieces for w in p})
        at = 0
        while at < len(fresh):  # a bounded list at a time
            size, to = 0, at
            while to < len(fresh) and (size < 1 << 22 or to == at):
                size += len(fresh[to])
                to += 1
            known.update(zip(fresh[at:to], self._merge(fresh[at:to])))
            at = to

    def encode(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """The ids of every pre-token of every text."""
        pieces = [self.split(t) for t in texts]
        self.learn(pieces)
        get = self.known.__getitem__
        return [list(map(get, p)) for p in pieces]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of single pre-tokens."""
        known = self.known
        if any(w not in known for w in words):
            self.learn([words])
        return [known[w] for w in words]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(e)) for e in self.encode(texts)]

    def count(self, texts: list[str]) -> list[int]:
        return [sum(map(len, e)) for e in self.encode(texts)]


_encoders: dict[tuple, BytePairEncoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> BytePairEncoder:
    """One encoder for each process."""
    if (name, folder) not in _encoders:
        _encoders[name, folder] = BytePairEncoder(name, folder)
    return _encoders[name, folder]
