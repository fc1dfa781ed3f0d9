"""Text read under a wrong encoding: finding it and reading it again.

A chain undoes readings: write the text in the encoding it was read under, read the bytes in the encoding they were
written in; up to three steps. Every candidate is compressed with a zstandard dictionary per language, and the chain
with the least description length, its own cost included, is taken; if none beats the text as it is, the text is left
unchanged. Whole suspicious passages are tried first, then single lines, then sentences, so that a text garbled in part
is mended in part.

A passage is suspicious, and only then tried, if it has a word with a letter beyond ASCII that the language samples
don't have, a sign next to a letter, a quote, dash or ellipsis inside a word (or at its edge, if a reading of both gives
a word of the samples), a control character, or a run of 7-bit escapes. All its readings are compressed. One that
explains nothing, leaving as many such places (unless its bytes are valid UTF-8 and bring no letter that neither text nor
samples have), costs DOUBT more, or ODD_COST if capitals inside words or unknown letters go. A further step starts from
every reading that explains something and still leaves something; a reading met again by a longer chain isn't tried twice,
as the shorter chain is the cheaper one.

Word lists and dictionaries are made from counts over all labelled texts, whole (`LanguageModel.fit`): of each language the
words and signs that one of COMMON of its texts has, the dictionary being these words in order of frequency. The share
bounds them by the number of words in a text, whatever the number of texts.

Defined results: null and empty texts are unchanged and no case; a text with U+FFFD other than one at its very end is a
case that can't be recovered, marked as lossy (the passages around are still mended); repeated rows are handled each; an empty table, or
an empty sample, gives no change.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import slices
from ..session import spread

#: Encodings a text may have been read under, and single-byte ones it may have been written in.
READ = ("cp1252", "latin-1", "cp1251", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp1250", "cp852", "iso8859-2", "iso8859-15", "mac_cyrillic", "cp1253", "cp1254", "iso8859-5")
WRITTEN = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "iso8859-5", "cp1250", "mac_cyrillic", "iso8859-15")

STEP_COST = 2.0  # bytes to name one step of a chain
UTF8_COST = 0.5  # the same if the bytes turn out to be UTF-8, which they hardly are by chance
MARGIN = 0.5  # bytes by which a chain has to beat the text as it is
MAX_STEPS = 3
ODD_COST = 1.0  # bytes for a reading that leaves as many suspicious places and is less odd otherwise
COMMON = 2000  # a word or sign belongs to a language if one of so many of its texts has it
DOUBT = 8.0  # bytes for a reading as odd as the text, and for each further odd place

_WORD = regex.compile(r"[\p{L}\p{M}]*[^\x00-\x7f\P{L}][\p{L}\p{M}]*")
#: Letters, marks, typographic quotes and dashes, blanks, invisible characters: not odd beside a letter.
_PLAIN = r"\p{L}\p{M}“”‘’«»„‚–—…\p{Zs}\p{Cf}" + chr(0xFFFD)
_SIGN = regex.compile(rf"(?<=\p{{L}})[^\x00-\x7f{_PLAIN}]|[^\x00-\x7f{_PLAIN}¿¡](?=\p{{L}})|[\x80-\x9f]")
#: Quotes, dashes and ellipses where no text has them: between two letters, low quotes also after a word. They are é à ä ö
#: ñ ó of the DOS and Macintosh encodings.
_INSIDE = regex.compile(r"(?<=\p{L})[“”‘„‚–—…](?=\p{L})|(?<=\p{L})[‚„](?![‚„“”‘’])")
_EDGED = regex.compile(r"[\p{L}\p{M}“”‘’„‚–—…]*[“”‘’„‚–—…][\p{L}\p{M}“”‘’„‚–—…]*")
_INNER_CAPITAL = regex.compile(r"(?<=\p{Ll})[^\x00-\x7f\P{Lu}]")
_KNOWN_SCRIPT = regex.compile(r"[\p{Latin}\p{Cyrillic}]")
_CYRILLIC = regex.compile(r"\p{Cyrillic}{2,}")
_SCRIPTS = [regex.compile(rf"\p{{{k}}}") for k in ("Latin", "Cyrillic", "Greek", "Armenian")]
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1a\x1c-\x1f]")  # not the escape of terminal logs
_COMMON = regex.compile(r"[\p{M}\p{Sc}\p{P}\p{Zs}\p{Cf}\xA0-\xBF]")
_SEVEN = re.compile(r"\+(?:[A-Za-z0-9/+]{3,})-?")
_CHUNK = re.compile(r"[A-Za-z]*[^\x00-\x7f][^\x00-@\[-`{-\x7f]*")  # letters and others beyond ASCII


@cache
def _reading(codec: str) -> tuple[dict[int, int], str]:
    """Character -> byte of a single-byte encoding, and its 256 characters; bytes without one read as the control
    character of their value."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {ord(c): b for b, c in reversed(list(enumerate(chars)))}, "".join(chars)


def _bytes(text: str, codec: str) -> bytes | None:
    """text written in codec, or None if it can't be."""
    to = _reading(codec)[0]
    try:
        return bytes([to[ord(c)] for c in text])
    except KeyError:
        return None


def _mixed(word: str) -> bool:
    """Letters of two scripts in a word."""
    return sum(bool(k.search(word)) for k in _SCRIPTS) > 1


def _filled(texts: list[str], most: int) -> bytes:
    """The texts, one per line, that fit into `most` bytes as a whole."""
    out = b""
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass") + b"\n"
        if len(out) + len(raw) <= most:
            out += raw
    return out


def _beyond(text: str) -> str:
    """The words of text with anything beyond ASCII: all that can be odd beside them is in them."""
    return " ".join([w for w in text.replace("\n", " ").split(" ") if not w.isascii()])


class LanguageModel:
    """Dictionaries and word lists of the sample languages."""

    def __init__(self, samples: dict[str, list[str]], dictionary_bytes: int = 64 << 10) -> None:
        self.data = {k: _filled(v, dictionary_bytes) for k, v in sorted(samples.items()) if v}
        seen: Counter[str] = Counter()
        for texts in samples.values():
            for t in texts:
                seen.update({w.lower() for w in _WORD.findall(t)})
        self.signs = frozenset(c for texts in samples.values() for t in texts for c in set(t) if c > "\x7f" and not c.isalpha())
        self.letters = frozenset(c for texts in samples.values() for t in texts for c in set(t) if c.isalpha())
        self.words = frozenset(w for w, n in seen.items() if n > 1)
        self._tools: list[zstandard.ZstdCompressor] | None = None
        self._edged: dict[str, bool] = {}
        self._chains: dict[tuple[str, bool], tuple[str, tuple[str, ...]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None, "_edged": {}, "_chains": {}}

    @classmethod
    def fit(cls, documents: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr", "pt", "ru"), sample_docs: int | None = None) -> LanguageModel:
        """From all labelled texts of documents (doc_id, text, lang), of any length. Words, as between blanks and as runs of letters, and signs are counted by language
        in the tasks, once a text; those in a COMMON-th of its texts come to the driver. sample_docs, for trials only, takes
        as many texts a language."""
        usable = documents.filter(F.col("lang").isin(*languages) & (F.length("text") > 0))
        if sample_docs is not None:
            usable = usable.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))).filter(F.col("n") <= sample_docs)
        each = spread(usable.select("lang", "text", F.xxhash64("text").alias("h"))).mapInArrow(_counted, "lang string, part string, texts long, low long, high long")
        counts = each.groupBy("lang", "part").agg(F.sum("texts").alias("texts"), F.min("low").alias("low"), F.max("high").alias("high"))
        totals = {r.lang: r["count"] for r in usable.groupBy("lang").count().collect()}
        total = F.lit(None).cast("long")
        for k, n in totals.items():
            total = F.when(F.col("lang") == k, F.lit(n)).otherwise(total)
        common = counts.filter(F.col("texts") * COMMON >= total)
        rows = sorted(tuple(r) for r in common.select("lang", "texts", "part", "low", "high").collect())
        model = cls({})
        # the most frequent words last, where they are cheapest to refer to
        words = {k: [part for lang, _, part, *_ in rows if lang == k] for k in sorted({r[0] for r in rows})}
        model.data = {k: " ".join(v).encode("utf-8", "surrogatepass") for k, v in words.items() if v}
        within: dict[str, tuple[int, int]] = {}
        for _, _, part, low, high in rows:
            if _WORD.fullmatch(part):
                a, b = within.get(part.lower(), (low, high))
                within[part.lower()] = min(a, low), max(b, high)
        model.words = frozenset(w for w, (a, b) in within.items() if a < b)  # in two different texts at least
        model.signs = frozenset(part for _, _, part, *_ in rows if len(part) == 1 and part > "\x7f" and not part.isalpha())
        model.letters = frozenset(c for v in words.values() for w in v for c in w if c.isalpha())
        return model

    def length(self, text: str) -> int:
        """Bytes of text compressed with the best language's dictionary."""
        if self._tools is None:
            self._tools = []
            for data in self.data.values():
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=6)
                self._tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        raw = text.encode("utf-8", "surrogatepass")
        return min((len(t.compress(raw)) for t in self._tools), default=len(raw))

    def odd(self, text: str) -> int:
        """Suspicious places and strange signs, capitals inside words, and letters of the samples' scripts that the samples
        don't have; not in words of two scripts, which hold look-alike letters."""
        n = self.suspicion(text) + self.strange(text)
        if text.isascii():
            return n
        text = _beyond(text)
        n += len(_INNER_CAPITAL.findall(text))
        if any(c not in self.letters and c.isalpha() for c in set(text)):
            for w in _WORD.findall(text):
                new = sum(c not in self.letters and _KNOWN_SCRIPT.match(c) is not None for c in w)
                n += new if new and not _mixed(w) else 0
        return n

    def foreign(self, text: str, origin: str) -> int:
        """Letters that neither origin nor the samples have."""
        new = {c for c in set(text) - set(origin) if c not in self.letters and c.isalpha()}
        return sum(map(text.count, new)) if new else 0

    def brought(self, text: str, origin: str) -> int:
        """Foreign letters, and words of two scripts or of Cyrillic that origin hasn't."""
        n = max(0, sum(map(_mixed, _WORD.findall(text))) - sum(map(_mixed, _WORD.findall(origin))))
        return n + self.foreign(text, origin) + max(0, len(_CYRILLIC.findall(text)) - len(_CYRILLIC.findall(origin)))

    def strange(self, text: str) -> int:
        """Signs beyond ASCII that are neither common nor in the samples."""
        if text.isascii():
            return 0
        new = {c for c in set(text) if c > "\x7f" and c not in self.signs and not c.isalpha() and not _COMMON.match(c)}
        return sum(map(text.count, new)) if new else 0

    def suspicion(self, text: str) -> int:
        """Places of text that the samples don't explain."""
        n = len(_CONTROL.findall(text)) + (len(_SEVEN.findall(text)) if "+" in text else 0)
        if text.isascii():
            return n
        text = _beyond(text)
        n += len(_SIGN.findall(text)) + sum(w.lower() not in self.words for w in _WORD.findall(text))
        return n + sum(len(_INSIDE.findall(w)) or self.hides_word(w) for w in _EDGED.findall(text))

    def hides_word(self, token: str) -> bool:
        """Letters with quotes, dashes or ellipses that are a word of the samples under another encoding."""
        if token not in self._edged:
            if len(self._edged) >= 100_000:
                self._edged.clear()
            self._edged[token] = any(map(str.isalpha, token)) and any(c.lower() in self.words for c in candidates(token))
        return self._edged[token]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text, h) -> (lang, part, texts, low, high): the texts that hold a word or a sign beyond ASCII, and the least and
    greatest hash of them."""
    for b in slices(batches, "text"):
        found: dict[tuple[str, str], list[int]] = {}
        for lang, text, h in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), b.column("h").to_pylist()):
            parts = set(text.split())
            if not text.isascii():
                parts.update(_WORD.findall(_beyond(text)))
                parts.update(c for c in set(text) if c > "\x7f" and not c.isalpha())
            for p in parts:
                x = found.setdefault((lang, p), [0, h, h])
                x[0] += 1
                if h < x[1]:
                    x[1] = h
                elif h > x[2]:
                    x[2] = h
        keys, values = list(found), list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), *(pa.array([v[i] for v in values], pa.int64()) for i in range(3))], names=["lang", "part", "texts", "low", "high"])


def word_candidates(text: str, model: LanguageModel) -> dict[str, str]:
    """Readings one step away in which only suspicious words are read again, all that can be in the same way."""
    spans = [m.span() for m in _CHUNK.finditer(text)]
    spans = [(a, b) for a, b in spans if model.suspicion(text[max(0, a - 1) : b + 1])]
    found: dict[str, dict[tuple[int, int], str]] = {}
    for a, b in spans:
        for new, step in candidates(text[a:b], every=True).items():
            for k in step.split():
                found.setdefault(k, {})[a, b] = new
    out: dict[str, str] = {}
    for step, by_span in sorted(found.items()):
        new, at = [], 0
        for (a, b), piece in sorted(by_span.items()):
            if model.suspicion(piece) <= model.suspicion(text[a:b]):
                new += [text[at:a], piece]
                at = b
        out.setdefault("".join([*new, text[at:]]), step)
    out.pop(text, None)
    return out


def candidates(text: str, every: bool = False) -> dict[str, str]:
    """Readings one step away: text -> name of the step (with every, of all steps that give it)."""
    out: dict[str, str] = {}
    if not text.isascii():
        letters = sum(map(str.isalpha, text))
        for read in READ:
            raw = _bytes(text, read)
            if raw is None:
                continue
            for written in WRITTEN:
                if written == read:
                    continue
                if written == "utf-8":
                    try:
                        new = raw.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                else:
                    new = raw.decode("latin-1").translate(_reading(written)[1])
                    if sum(map(str.isalpha, new)) < letters:
                        continue
                if new != text:
                    out[new] = f"{out[new]} {read}>{written}" if every and new in out else out.get(new, f"{read}>{written}")
    if "+" in text and _SEVEN.search(text):
        new = _SEVEN.sub(_seven, text)
        if new != text:
            out.setdefault(new, "ascii>utf-7")
    if _CONTROL.search(text):
        for read in ("latin-1", "cp1252"):
            raw = _bytes(text, read)
            for wide in ("utf-16-le", "utf-16-be"):
                try:
                    out.setdefault(raw.decode(wide) if raw else text, f"{read}>{wide}")
                except UnicodeDecodeError:
                    pass
    out.pop(text, None)
    return out


def _seven(m: re.Match) -> str:
    try:
        new = m.group().encode("ascii").decode("utf-7")
    except UnicodeDecodeError:
        return m.group()
    return new if all(c.isprintable() for c in new) else m.group()


def best_chain(text: str, model: LanguageModel, words: bool = False) -> tuple[str, tuple[str, ...]]:
    """The reading of least description length and its steps; (text, ()) if that is text itself."""
    key = (text, words)
    if key not in model._chains:
        if len(model._chains) >= 20_000:
            model._chains.clear()
        model._chains[key] = _best_chain(text, model, words)
    return model._chains[key]


def _best_chain(text: str, model: LanguageModel, words: bool) -> tuple[str, tuple[str, ...]]:
    best, steps = text, ()
    least = model.length(text) - MARGIN
    front = [(text, ())]
    met = {text}
    for _ in range(MAX_STEPS):
        fresh: dict[str, tuple[float, tuple[str, ...]]] = {}
        for t, s in front:
            limit, signs, was = model.suspicion(t), model.strange(t), model.odd(t)
            for c, k in (word_candidates(t, model) if words else candidates(t)).items():
                if c in met:
                    continue
                # bytes that happen to be UTF-8 speak for themselves; other readings must explain something or pay for it
                n, extra = model.suspicion(c), 0.0
                if n > limit or model.strange(c) > signs or n == limit and not (k.endswith("utf-8") and not model.foreign(c, t)):
                    more = model.odd(c) + model.brought(c, t) - was
                    extra = ODD_COST if more < 0 else DOUBT * (1 + more)
                if c not in fresh or extra < fresh[c][0]:
                    fresh[c] = (extra, (*s, k))
        priced = sorted((model.length(c) + extra + sum(UTF8_COST if k.endswith("utf-8") else STEP_COST for k in s), c) for c, (extra, s) in fresh.items())
        if not priced:
            break
        if priced[0][0] < least:
            least, best = priced[0]
            steps = fresh[best][1]
        # garbled twice: readings that explain something have a further step
        met |= fresh.keys()
        front = [(c, fresh[c][1]) for _, c in priced if not fresh[c][0] and model.suspicion(c)]
        if not front:
            break
    return best, steps


def mend(text: str | None, model: LanguageModel) -> tuple[str | None, list[str]]:
    """The text read as it was written, and the chains used ('' if nothing was)."""
    if not text or not model.data or not model.suspicion(text):
        return text, []
    lines = text.split("\n")
    odd = [k for k, x in enumerate(lines) if model.suspicion(x)]
    chains: list[str] = []
    whole = "\n".join(lines[k] for k in odd)
    new, steps = best_chain(whole, model)
    if steps and not model.suspicion(new) and new.count("\n") == len(odd) - 1:
        for k, x in zip(odd, new.split("\n")):
            lines[k] = x
        return "\n".join(lines), [" ".join(steps)]
    for k in odd:
        new, steps = best_chain(lines[k], model)
        if steps:
            chains.append(" ".join(steps))
            lines[k] = new
        for _ in range(MAX_STEPS):  # words garbled in different ways
            if not model.suspicion(lines[k]):
                break
            lines[k], steps = best_chain(lines[k], model, words=True)
            if not steps:
                break
            chains.append(" ".join(steps))
    return "\n".join(lines), list(dict.fromkeys(chains))


def is_lossy(text: str | None) -> bool:
    """Holds a replacement character other than one at its very end."""
    return bool(text) and "�" in text[:-1] or text == "�" * 2


def _mend(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str | None, list[str]]] = {}
        for b in slices(batches, "text", 4 << 20):
            out = {"mended": [], "chain": [], "garbled": [], "recovered": [], "lossy": []}
            known.clear()
            for t in b.column("text").to_pylist():
                new, chains = known[t] if t in known else known.setdefault(t, mend(t, model))
                lossy = is_lossy(t)
                out["mended"].append(new)
                out["chain"].append(" | ".join(chains) or None)
                out["garbled"].append(bool(chains) or lossy)
                out["recovered"].append(bool(chains) and not lossy)
                out["lossy"].append(lossy)
            keep = [k for k in b.schema.names if k != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array(out["mended"], pa.string()), pa.array(out["chain"], pa.string()), pa.array(out["garbled"], pa.bool_()), pa.array(out["recovered"], pa.bool_()), pa.array(out["lossy"], pa.bool_())],
                names=[*keep, *out],
            )

    return run


def mended(df: DataFrame, id_col: str, text_col: str, model: LanguageModel) -> DataFrame:
    """(rec_id, mended, chain, garbled, recovered, lossy) of every row."""
    src = df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text"))
    return spread(src).mapInArrow(_mend(model), "rec_id long, mended string, chain string, garbled boolean, recovered boolean, lossy boolean")
