"""One form for text that looks the same.

The UTF-8 buffer of an Arrow column becomes one numpy array of code points for a whole slice of rows, with a separator
after each row. A lookup table maps every code point to itself, to a plainer one, to several (through expansion offsets) or
to none; separate marks are composed with their letters by sorted-pair lookups over the array; and in words of mixed
scripts the look-alike letters are gathered into the script of the word's unmistakable letters. The codes are written
back as UTF-8 buffers, and rows are compared as Arrow arrays: there is no Python string of any row.

What is brought to its plain form: width forms, ligatures and letter variants, characters with a canonical equal
(Kelvin, Angstrom), blanks other than the space, invisible characters (kept: joiners between emoji or in scripts that
need them, variation selectors after symbols), marks apart from their letter, and letters of another script within a
word. What is kept: words wholly of one script, superscripts, fractions, signs, typographic punctuation, U+FFFD.

Defined results: null gives null and no change, empty gives empty; the form of a form is itself; repeated rows are
handled each; an empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import slices
from ..session import spread
from .codes import code_points, parts_of, utf8

_ODD = np.arange(256) >= 0x80
_ODD[[*range(9), *range(14, 32)]] = True
_END = 0x110000  # between rows
_DROP, _MANY = -1, -2

#: Letters of Cyrillic and Greek that look like a Latin letter.
CYRILLIC_LIKE = "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl ԍg ѵv АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԌG ԚQ ԜW ӀI ҮY ёë їï ЁË ЇÏ"
GREEK_LIKE = "αa οo νv ιi ρp υu γy κk χx ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϊï ΪÏ ΐḯ όó άá ίí"
#: Greek and Cyrillic letters that look the same but have no Latin like.
GREEK_CYRILLIC_LIKE = "ΓГ ΠП ΦФ ΛЛ"
#: Letters of Armenian, Cherokee, Coptic and Lisu that look like a Latin letter.
ARMENIAN_LIKE = "\u0585o \u057du \u0578n \u0570h \u0581g \u0566q \u0575j \u0555O \u054dU \u054fS \u053cL"
CHEROKEE_LIKE = "\u13aaA \u13f4B \u13dfC \u13a0D \u13acE \u13c0G \u13bbH \u13a5i \u13abJ \u13e6K \u13deL \u13b7M \u13e2P \u13a1R \u13daS \u13a2T \u13d9V \u13b3W \u13c3Z"
COPTIC_LIKE = "\u2c9fo \u2c9eO \u2ca3p \u2ca2P \u2ca5c \u2ca4C \u2c8eH \u2c98M \u2c9aN \u2ca6T \u2c94K \u2c92I \u2c82B"
LISU_LIKE = "\ua4d0B \ua4d1P \ua4d3D \ua4d4T \ua4d6G \ua4d7K \ua4d9J \ua4daC \ua4dcZ \ua4ddF \ua4dfM \ua4e0N \ua4e1L \ua4e2S \ua4e3R \ua4e6V \ua4e7H \ua4eaW \ua4ebX \ua4ecY \ua4eeA \ua4f0E \ua4f2I \ua4f3O \ua4f4U"
#: Blocks of each script: Latin, Greek, Cyrillic, Armenian, Cherokee, Coptic, Lisu.
SCRIPTS = (
    ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)), ((0x370, 0x3FF), (0x1F00, 0x1FFF)), ((0x400, 0x52F), (0xA640, 0xA69F)),
    ((0x531, 0x587),), ((0x13A0, 0x13F5), (0xAB70, 0xABBF)), ((0x2C80, 0x2CEE),), ((0xA4D0, 0xA4F7),),
)
LATIN, GREEK, CYRILLIC = 1, 2, 3


@cache
def _tables() -> dict[str, np.ndarray]:
    plain = np.arange(_END + 1, dtype=np.int64)
    many: list[str] = []
    many_at = np.zeros(_END + 1, np.int32)
    ccc = np.zeros(_END + 1, np.uint8)
    pairs: dict[int, int] = {}
    kept_widths = {"<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
    for cp in range(0xA0, _END):
        if 0xAC00 <= cp <= 0xD7A3 or 0x3400 <= cp <= 0x4DBF or 0x4E00 <= cp <= 0x9FFF or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2F7FF or cp >= 0x2FA20:
            continue
        c = chr(cp)
        ccc[cp] = unicodedata.combining(c)
        kind = unicodedata.category(c)
        parts = unicodedata.decomposition(c).split()
        if kind == "Zs":
            plain[cp] = 32 if cp != 0x1680 else cp
        elif kind == "Cf" and not 0x600 <= cp <= 0x8E2 and cp not in (0x110BD, 0x110CD) and not 0x13430 <= cp <= 0x1343F and not 0xFFF9 <= cp <= 0xFFFB:
            plain[cp] = _DROP
        elif parts and parts[0] in kept_widths or parts and parts[0] == "<compat>" and (0xFB00 <= cp <= 0xFB17 or cp in (0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3) or 0x2160 <= cp <= 0x217F):
            to = unicodedata.normalize("NFKC", c)
            if len(to) == 1:
                plain[cp] = ord(to)
            else:
                plain[cp] = _MANY
                many_at[cp] = len(many)
                many.append(to)
        elif parts and parts[0][0] != "<":
            to = unicodedata.normalize("NFC", c)
            if len(to) == 1 and to != c:
                plain[cp] = ord(to)
            elif to == c and len(parts) == 2:
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
    plain[[0x115F, 0x1160, 0x3164, 0xFFA0, 0x34F, 0x17B4, 0x17B5]] = _DROP
    plain[0xFE00:0xFE10] = _DROP
    plain[0xE0000:0xE01F0] = _DROP
    plain[[0x2028, 0x2029]] = 10
    plain[0x2800] = 32
    # joiners and selectors beside these code points have a work to do
    needs = np.zeros(_END + 1, bool)
    for a, b in ((0x600, 0x8FF), (0x900, 0x109F), (0x1780, 0x18AF), (0x2190, 0x2BFF), (0x3030, 0x303D), (0x1F000, 0x1FAFF), (0xA8E0, 0xA8FF), (0xFE0E, 0xFE0F)):
        needs[a : b + 1] = True
    needs[[0xA9, 0xAE, 0x203C, 0x2049, 0x2122, 0x2139, 0x20E3]] = True
    selected = needs.copy()
    selected[[*range(0x30, 0x3A), 0x23, 0x2A]] = True  # keycaps
    selected[0x3400:0xA000] = True  # ideographic variants
    keys = np.array(sorted(pairs), np.int64)
    seconds = np.zeros(_END + 1, bool)
    seconds[keys & 0x1FFFFF] = True
    first, second = np.zeros(_END + 1, np.int64), np.zeros(_END + 1, np.int64)
    for key, cp in pairs.items():
        if ccc[key & 0x1FFFFF]:
            first[cp], second[cp] = key >> 21, key & 0x1FFFFF
    script = np.zeros(_END + 1, np.int8)
    for s, spans in enumerate(SCRIPTS, 1):
        for a, b in spans:
            for cp in range(a, b + 1):
                if chr(cp).isalpha() and cp not in (0xAA, 0xBA, 0xB5):
                    script[cp] = s
    like = np.zeros((len(SCRIPTS) + 1, _END + 1), np.int32)  # like[s][cp]: the letter of script s that looks like cp
    same: list[tuple[str, ...]] = []
    for source in (CYRILLIC_LIKE, GREEK_LIKE, GREEK_CYRILLIC_LIKE, ARMENIAN_LIKE, CHEROKEE_LIKE, COPTIC_LIKE, LISU_LIKE):
        text = source.replace(" ", "")
        same += [tuple(text[k : k + 2]) for k in range(0, len(text), 2)]
    for x, y in same:
        for p, q in ((x, y), (y, x)):
            if not like[script[ord(q)]][ord(p)]:
                like[script[ord(q)]][ord(p)] = ord(q)
    for x, y in same:  # Greek and Cyrillic through the Latin letter
        s, other = int(script[ord(x)]), GREEK + CYRILLIC - int(script[ord(x)])
        if s in (GREEK, CYRILLIC) and script[ord(y)] == LATIN and (z := int(like[other][ord(y)])):
            like[other][ord(x)] = z
            like[s][z] = like[s][z] or ord(x)
    return {
        "plain": plain, "many_at": many_at, "many_codes": np.array([ord(ch) for m in many for ch in m], np.int64),
        "many_start": np.cumsum([0, *map(len, many)]), "ccc": ccc, "keys": keys, "values": np.array([pairs[int(k)] for k in keys], np.int64),
        "seconds": seconds, "first": first, "second": second, "needs": needs, "selected": selected, "script": script, "like": like,
    }


def _plain(code: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Codes after the lookup table."""
    to = t["plain"][code]
    joiner = np.flatnonzero((code == 0x200C) | (code == 0x200D))
    if len(joiner):
        kept = (joiner > 0) & (joiner < len(code) - 1)
        kept &= t["needs"][code[np.maximum(joiner - 1, 0)]] & t["needs"][code[np.minimum(joiner + 1, len(code) - 1)]]
        to[joiner[kept]] = code[joiner[kept]]
    chosen = np.flatnonzero((code >= 0xFE00) & (code <= 0xFE0F) | (code >= 0xE0100) & (code <= 0xE01EF))
    if len(chosen):
        kept = (chosen > 0) & t["selected"][code[np.maximum(chosen - 1, 0)]]
        to[chosen[kept]] = code[chosen[kept]]
    control = (code < 32) & (code != 9) & (code != 10) & (code != 13) & (code != 12) & (code != 11)
    to[control] = _DROP
    size = np.ones(len(code), np.int64)
    size[to == _DROP] = 0
    wide = np.flatnonzero(to == _MANY)
    which = t["many_at"][code[wide]]
    size[wide] = t["many_start"][which + 1] - t["many_start"][which]
    source = np.repeat(np.arange(len(code)), size)
    out = to[source]
    if len(wide):
        first = (np.cumsum(size) - size)[wide]
        spread = np.repeat(np.arange(len(wide)), size[wide])
        step = np.arange(len(spread)) - np.repeat(np.cumsum(size[wide]) - size[wide], size[wide])
        out[first[spread] + step] = t["many_codes"][t["many_start"][which][spread] + step]
    return out


def _order_marks(code: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Runs of two or more marks in canonical order."""
    k = ccc[code]
    wrong = np.flatnonzero((k[1:] > 0) & (k[:-1] > k[1:]))
    if len(wrong):
        run = np.cumsum(k == 0)
        hit = np.flatnonzero(np.isin(run, run[wrong]) & (k > 0))
        code = code.copy()
        code[hit] = code[hit[np.lexsort((hit, k[hit], run[hit]))]]
    return code


def _compose(code: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Marks joined with their letters."""
    ccc, keys, values = t["ccc"], t["keys"], t["values"]
    if not t["seconds"][code].any() and not ((code >= 0x1161) & (code <= 0x11C2)).any():
        return code
    while True:  # a composed letter with further marks is taken apart first, so that all its marks can be ordered
        first = t["first"][code]
        follow = np.append(ccc[code[1:]] > 0, False)
        apart = (first > 0) & follow
        if not apart.any():
            break
        size = 1 + apart.astype(np.int64)
        at = (np.cumsum(size) - size)[apart]
        second = t["second"][code[apart]]
        first = first[apart]
        code = np.repeat(code, size)
        code[at], code[at + 1] = first, second
    code = _order_marks(code, ccc)
    while True:
        k = ccc[code]
        place = np.arange(len(code))
        base = np.maximum.accumulate(np.where(k == 0, place, 0))
        mark = np.flatnonzero(t["seconds"][code])
        mark = mark[mark > 0]
        at = np.where(k[mark] == 0, mark - 1, base[mark])
        clear = (at == mark - 1) | (k[mark - 1] < k[mark])
        mark, at = mark[clear], at[clear]
        pair = code[at] << 21 | code[mark]
        i = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[i] == pair
        mark, at, to = mark[hit], at[hit], values[i[hit]]
        at, one = np.unique(at, return_index=True)
        mark, to = mark[one], to[one]
        later = ~np.isin(at, mark)  # a letter that is itself being joined waits for the next round
        at, mark, to = at[later], mark[later], to[later]
        # Hangul syllables by their formula
        v = np.flatnonzero((code[1:] >= 0x1161) & (code[1:] <= 0x1175) & (code[:-1] >= 0x1100) & (code[:-1] <= 0x1112)) + 1
        s = code[:-1] - 0xAC00
        f = np.flatnonzero((code[1:] >= 0x11A8) & (code[1:] <= 0x11C2) & (s >= 0) & (s < 11172) & (s % 28 == 0)) + 1
        at = np.concatenate([at, v - 1, f - 1])
        mark = np.concatenate([mark, v, f])
        to = np.concatenate([to, 0xAC00 + ((code[v - 1] - 0x1100) * 21 + code[v] - 0x1161) * 28, code[f - 1] + code[f] - 0x11A7])
        if not len(at):
            break
        code = code.copy()
        code[at] = to
        keep = np.ones(len(code), bool)
        keep[mark] = False
        code = code[keep]
    return code


def _one_script(code: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Codes with look-alike letters in the script of their word."""
    s = t["script"][code]
    if not (s > 1).any():
        return code
    letter = s > 0
    inside = letter | (t["ccc"][code] > 0)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    word = np.cumsum(start)[letter] - 1
    if not len(word):
        return code
    at = np.flatnonzero(letter)
    sc, c = s[at], code[at]
    n = int(word[-1]) + 1
    kinds = np.flatnonzero(np.bincount(sc, minlength=len(SCRIPTS) + 1))  # scripts that occur
    count = np.stack([np.bincount(word[sc == k], minlength=n) for k in kinds])
    mixed = (count > 0).sum(axis=0) > 1
    if not mixed.any():
        return code
    # a script fits if every letter of the word is of it or looks like one of it
    foreign = np.stack([np.bincount(word[(sc != k) & (t["like"][k][c] == 0)], minlength=n) for k in kinds])
    score = np.where(foreign == 0, count * 4 + np.maximum(4 - kinds, 0)[:, None], -1)
    target = kinds[score.argmax(axis=0)]
    target[(score.max(axis=0) < 0) | ~mixed] = 0
    goal = target[word]
    out = code.copy()
    for k in kinds:
        hit = (goal == k) & (sc != k)
        out[at[hit]] = t["like"][k][c[hit]]
    return out


def plain_column(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The plain form of every row, and whether it differs."""
    changed = np.zeros(len(col), bool)
    raw, ends = parts_of(col)
    # rows of printable ASCII are plain
    rows = np.flatnonzero(np.diff(np.append(0, np.cumsum(_ODD[raw]))[ends]))
    if not len(rows):
        return col, changed
    t = _tables()
    some = col.take(pa.array(rows))
    code, ends = code_points(*parts_of(some))
    wide = np.full(len(code) + len(rows), _END, np.int64)
    wide[np.arange(len(code)) + np.repeat(np.arange(len(rows)), np.diff(ends))] = code
    out = _compose(_one_script(_compose(_plain(wide, t), t), t), t)
    stop = np.flatnonzero(out == _END)
    form = utf8(out[out != _END], np.append(0, stop - np.arange(len(rows)))).cast(col.type)
    changed[rows] = pc.not_equal(form, some).to_numpy(zero_copy_only=False)
    index = np.arange(len(col))
    index[rows] = len(col) + np.arange(len(rows))
    return pa.concat_arrays([col, form]).take(pa.array(index)), changed


def same_look(texts: list[str | None]) -> tuple[list[str | None], np.ndarray]:
    """plain_column of a list."""
    form, changed = plain_column(pa.array(texts, pa.string()))
    return form.to_pylist(), changed


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 2 << 20):
        form, changed = plain_column(b.column("text"))
        keep = [k for k in b.schema.names if k != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), form.cast(pa.string()), pa.array(changed)], names=[*keep, "form", "changed"])


def plain_forms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rec_id, form, changed) of every row."""
    return spread(df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).alias("text"))).mapInArrow(_forms, "rec_id long, form string, changed boolean")
