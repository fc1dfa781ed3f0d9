"""Splitting oversized texts at natural boundaries, with overlap.

Recursive bisection over the text's pre-tokens: a span larger than max_tokens - overlap_tokens is cut at the strongest
boundary of its middle third (paragraph, line, sentence, clause, blank, any pre-token; the nearest to the middle of
equals), and its halves likewise. A pre-token larger than that is cut between tokens that end on a whole character.
Then every piece but the first takes overlap_tokens tokens before its start (fewer where that would fall inside a
character, or where reading the piece by itself would need more than max_tokens).

Token counts are those of the piece encoded by itself: a piece starting at a pre-token reads as before, and pieces that
start inside one, or end in several blank pre-tokens, are encoded again.

Defined results: null, empty and not oversized texts give no piece (with keep_small, one piece, or none for null);
repeated rows are split each; limits with null or non-positive max_tokens are ignored, overlaps are taken as at least 0
and at most half the limit; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import slices
from ..session import spread
from .bpe import TOKENIZER_DIR, BytePairEncoder, encoder
from .encode import TOKENIZER

KINDS = ("token", "word", "blank", "clause", "sentence", "line", "paragraph", "end")
_BLANK = np.zeros(0x110000, bool)
_BLANK[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_STOP = np.zeros(0x110000, bool)
_STOP[[ord(c) for c in ".!?…。！？؟।"]] = True
_CLAUSE = np.zeros(0x110000, bool)
_CLAUSE[[ord(c) for c in ",;:)]}、，；："]] = True


class _Text:
    """Units of a text (pre-tokens, or parts of very large ones): character ends, token ends, boundary strengths."""

    def __init__(self, text: str, words: list[str], ids: list[tuple[int, ...]], largest: int, enc: BytePairEncoder) -> None:
        self.text, self.words, self.ids, self.enc = text, words, ids, enc
        chars = np.fromiter(map(len, words), np.int64, len(words))
        tokens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.word = range(len(words) + 1)  # the word a unit starts in
        inner = np.zeros(len(words) + 1, bool)
        if tokens.max(initial=0) > largest:
            c, t, w, inside = [], [], [], []
            for k in range(len(words)):
                if tokens[k] <= largest:
                    c.append(chars[k]), t.append(tokens[k]), w.append(k), inside.append(False)
                else:
                    a = b = 0
                    for n, m in self.places(k):
                        c.append(m - a), t.append(n - b), w.append(k), inside.append(b > 0)
                        a, b = m, n
            chars, tokens, self.word, inner = np.array(c), np.array(t), [*w, len(words)], np.array([*inside, False])
        ends = np.append(0, np.cumsum(chars))
        self.char, self.token = ends.tolist(), np.append(0, np.cumsum(tokens)).tolist()
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = ends[1:-1]
        before, after = code[at - 1], code[at]
        two = code[np.maximum(at - 2, 0)]
        s = np.ones(len(at), np.int8)
        blank = _BLANK[after]
        s[blank | _BLANK[before]] = 2
        s[blank & _CLAUSE[before]] = 3
        s[blank & _STOP[before]] = 4
        line = (before == 10) & (after != 10)
        s[line] = 5
        s[line & (two == 10)] = 6
        s[inner[1:-1]] = 0
        self.strength = b"\x07" + s.tobytes() + b"\x07"
        self.is_blank = _BLANK[code].tobytes()
        self.inner = inner.tobytes()

    def places(self, k: int) -> list[tuple[int, int]]:
        """(tokens, characters) after each token of word k that ends a whole character."""
        raw = self.words[k].encode("utf-8", "surrogatepass")
        out, b, chars, last = [], 0, 0, 0
        for n, i in enumerate(self.ids[k], 1):
            b += len(self.enc.id_bytes[i])
            if b == len(raw) or raw[b] & 0xC0 != 0x80:
                chars += sum(x & 0xC0 != 0x80 for x in raw[last:b])
                last = b
                out.append((n, chars))
        return out

    def bisect(self, most: int) -> list[int]:
        """Unit numbers of the cuts, the ends included."""
        token, strength = self.token, self.strength
        cuts, stack = [0], [(0, len(token) - 1)]
        while stack:
            i, j = stack.pop()
            a = token[i]
            size = token[j] - a
            if size <= most or j - i == 1:
                cuts.append(j)
                continue
            mid = a + size / 2
            lo = bisect_left(token, mid - size / 6, i + 1, j)
            hi = bisect_right(token, mid + size / 6, i + 1, j)
            near = bisect_left(token, mid, i + 1, j)
            if lo < hi:  # strongest of the middle third; of equals the one nearest to the middle
                best = max(strength[lo:hi])
                x, y = strength.rfind(best, lo, min(near, hi)), strength.find(best, max(near, lo), hi)
            else:
                x, y = (near - 1 if near - 1 > i else -1), (near if near < j else -1)
            k = y if x < 0 else x if y < 0 or mid - token[x] <= token[y] - mid else y
            stack.append((k, j))
            stack.append((i, k))
        return cuts

    def overlap_starts(self, unit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
        """(character, tokens of overlap, first whole unit) of possible starts before unit, the widest first."""
        token, char = self.token, self.char
        t = token[unit]
        want = max(0, t - overlap)
        m = bisect_right(token, want) - 1
        if token[m] == want:
            yield char[m], t - want, m
        elif not self.inner[m] and not self.inner[m + 1]:  # a whole word: look inside
            for n, c in self.places(self.word[m])[:-1]:
                if token[m] + n >= want:
                    yield char[m] + c, t - token[m] - n, m + 1
                    break
        for x in range(m + 1, unit + 1):
            yield char[x], t - token[x], x

    def count(self, start: int, i: int, j: int) -> int:
        """Tokens of the text from character start, at or inside the unit before unit i, up to unit j, read by itself."""
        token, char, blank = self.token, self.char, self.is_blank
        end = char[j]
        if self.inner[j] or self.inner[i]:
            return self.enc.count([self.text[start:end]])[0]
        n, k = token[j] - token[i], j
        while k > i and blank[char[k] - 1] and blank[char[k - 1] : char[k]].count(1) == char[k] - char[k - 1]:
            k -= 1
        if k < j - 1:  # several blank words at the end are read as one
            if k == i:
                return self.enc.count([self.text[start:end]])[0]
            n += len(self.enc.encode_words([self.text[char[k] : end]])[0]) - token[j] + token[k]
        if start == char[i]:
            return n
        # inside a word: the part of it and the next word are split again; the rest reads as before
        if i < k and not blank[char[i + 1] - 1]:
            head = self.enc.split(self.text[start : char[i + 1]])
            if head[-1] == self.words[self.word[i]]:
                return n + sum(map(len, self.enc.encode_words(head[:-1])))
        return self.enc.count([self.text[start:end]])[0]


def split_text(text: str, words: list[str], ids: list[tuple[int, ...]], max_tokens: int, overlap: int, enc: BytePairEncoder, made: dict[int, _Text]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (start character, end character, tokens, overlap tokens, kind of the end) of an oversized text."""
    most = max(1, max_tokens - overlap)
    largest = max(map(len, ids))
    while True:
        size = most if largest > most else 0  # without very large words the units are the same for every limit
        if size not in made:
            made[size] = _Text(text, words, ids, most, enc)
        u = made[size]
        cuts = u.bisect(most)
        pieces = []
        for i, j in zip(cuts, cuts[1:]):
            for start, over, first in u.overlap_starts(i, overlap) if i and overlap else [(u.char[i], 0, i)]:
                n = u.count(start, first, j)
                if n <= max_tokens:
                    break
            pieces.append((start, u.char[j], n, over, u.strength[j]))
        if all(p[2] <= max_tokens for p in pieces) or most == 1:
            return pieces
        most = max(1, most * 3 // 4)  # parts of very large pre-tokens can need more tokens by themselves


def _split(limits: list[tuple[str, int, int]], name: str, folder: str, keep_small: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        fields = ("doc_id", "limit_name", "piece", "pieces", "start_char", "end_char", "n_tokens", "overlap_tokens", "boundary", "text")
        types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        for b in slices(batches, "text", 2 << 20):
            keys, texts = b.column("key").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            words = [enc.split(t) for t in texts]
            enc.learn(words)
            rows: list[list] = [[] for _ in fields]
            for key, text, w in zip(keys, texts, words):
                ids = list(map(enc.known.__getitem__, w)) if text else []
                total = sum(map(len, ids))
                made: dict[int, _Text] = {}
                for limit, most, overlap in limits:
                    if total > most:
                        pieces = split_text(text, w, ids, most, overlap, enc, made)
                    elif keep_small and text:
                        pieces = [(0, len(text), total, 0, 7)]
                    else:
                        continue
                    for k, (start, end, n, over, kind) in enumerate(pieces):
                        for r, v in zip(rows, (key, limit, k, len(pieces), start, end, n, over, KINDS[kind], text[start:end])):
                            r.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=list(fields))

    return run


def split(docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, folder: str = TOKENIZER_DIR, keep_small: bool = False) -> DataFrame:
    """Pieces of every text over a limit: doc_id, limit_name, piece, pieces, start_char, end_char, n_tokens,
    overlap_tokens, boundary (kind of place where the piece ends), text."""
    # the table of limits is a setting: a few rows
    rows = limits.filter("max_tokens >= 1").select("limit_name", "max_tokens", "overlap_tokens").distinct().orderBy("limit_name", "max_tokens").collect()
    rules = [(r[0], int(r[1]), min(max(0, int(r[2] or 0)), int(r[1]) // 2)) for r in rows]
    src = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).filter("text is not null and text <> ''")
    return spread(src).mapInArrow(
        _split(rules, name, folder, keep_small),
        "doc_id long, limit_name string, piece int, pieces int, start_char long, end_char long, n_tokens int, overlap_tokens int, boundary string, text string",
    )


def split_report(pieces: DataFrame) -> DataFrame:
    """For each limit: documents cut, pieces, largest piece, and pieces by kind of end."""
    kinds = [F.sum((F.col("boundary") == k).cast("long")).alias(f"at_{k}") for k in KINDS]
    docs = F.sum((F.col("piece") == 0).cast("long")).alias("documents")
    return pieces.groupBy("limit_name").agg(docs, F.count("*").alias("pieces"), F.max("n_tokens").alias("largest"), *kinds)


def coverage(pieces: DataFrame, docs: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(limit_name, within_limit, overlapping, whole, same_text): no piece is over its limit; none starts after the end of
    the one before, or repeats more than the overlap; pieces reach from the first to the last character of their text; and
    each is the part of the text that its places say. Ids are expected to be unique."""
    before = Window.partitionBy("doc_id", "limit_name").orderBy("piece")
    rules = limits.groupBy("limit_name").agg(F.max("max_tokens").alias("max_tokens"), F.max("overlap_tokens").alias("most_overlap"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("full"), F.length(text_col).alias("chars"))
    j = pieces.withColumn("reached", F.lag("end_char").over(before)).join(F.broadcast(rules), "limit_name").join(texts, "doc_id")
    first, last = F.col("piece") == 0, F.col("piece") == F.col("pieces") - 1
    follows = F.when(first, F.col("start_char") == 0).otherwise((F.col("start_char") <= F.col("reached")) & (F.col("reached") < F.col("end_char")))
    return j.groupBy("limit_name").agg(
        F.bool_and(F.col("n_tokens").between(1, F.col("max_tokens"))).alias("within_limit"),
        F.bool_and((F.col("overlap_tokens") <= F.greatest(F.lit(0), "most_overlap")) & (first | (F.col("start_char") <= F.col("reached")))).alias("overlapping"),
        F.bool_and(follows & (~last | (F.col("end_char") == F.col("chars")))).alias("whole"),
        F.bool_and(F.expr("text = substring(full, start_char + 1, end_char - start_char)")).alias("same_text"),
    )
