"""Text that lost its end.

Hidden limits come first: the length of every text is recomputed as it would be stored - characters, UTF-8 bytes, UTF-16
units, with entities, with JSON escapes, with CR LF line ends - and texts are counted by source, measure and length. A
length far more frequent than its neighbours is a storage limit; limits named in the options count as they are. Plain
measures are tried first, the others on what those leave unexplained. A text as long as a limit is truncated (evidence
'limit', with measure and value) unless its ending shows it complete.

Endings then decide about the other texts, those cut in transfer: the last line is held against the form of its text
(prose, rows of a list, table, settings, code; the form is that of the NEAR_LINES lines before), and the last word
against the words of all texts: one never seen whole elsewhere, but seen as the beginning of longer words, is cut, and so
is an unknown word that ends as no known one does. Such a text needs the proof of its ending (evidence 'ending').

A closing formula (a greeting, a name) is a last line of at most SHORT_LINE characters that ends `closing` different
texts or more.

Defined results: null and empty texts are no case and count in no share; a null or unknown source is a source of its
own (null); repeated rows are handled each; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import slices
from ..session import staged

PLAIN_MEASURES = ("chars", "bytes")
OTHER_MEASURES = ("utf16", "crlf_chars", "crlf_bytes", "entity_chars", "entity_bytes", "entity_quote_chars", "entity_quote_bytes", "json_chars", "json_bytes", "json_ascii")

RARER = 20  # times that a line is rarer than the longer ones it begins, for it to be one of them cut short
SHORT_LINE = 40  # longest line, in characters, that can be a closing formula
NEAR_LINES = 8  # lines before the last one that show the form of a text there

_INVISIBLE = "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
_BLANK = re.compile(r"\s")
_SEGMENT = regex.compile(r"\p{Lu}?[\p{Ll}\p{M}\p{Lo}]+|\p{Lu}+(?!\p{Ll})|\p{Lu}")
_LAST = regex.compile(r"(?:\p{Lu}?[\p{Ll}\p{M}\p{Lo}]+|\p{Lu}+)$")
_BULLET = re.compile(r"\s*(?:[-*•+]|\d+[.)])\s+\S")
_SETTING = re.compile(r"\s*[\w.-]+\s*=\s*\S")
_DATE = re.compile(r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4})$")
_PART_DATE = re.compile(r"(?:\d{4}-\d{0,2}|\d{4}-\d{2}-\d?|\d{1,2}\.\d{0,2}|\d{1,2}\.\d{1,2}\.\d{0,3})$")
_STOP = re.compile(r"[.!?…。][\"'”’»)\]]*$")
_INNER_STOP = re.compile(r"[.!?…。][\"'”’»)]*\s+(?=\S)")
_CODE_END = re.compile(r"[;{}]\s*$")


def ending(text: str) -> tuple[str, str, str]:
    """(verdict 'cut', 'whole' or 'open'; form of the last line; last word part)."""
    t = text.rstrip(_INVISIBLE)
    if not t:
        return "whole", "none", ""
    if t[-1] in "\r\n":
        return "whole", "line end", ""
    if t[-1] == "�":
        return "cut", "character", ""
    lines = t.split("\n")
    line = lines[-1]
    before = [x for x in lines[:-1] if x.strip()]
    if _BLANK.match(t[-1]):
        bare = line.rstrip()
        return ("open" if _STOP.search(bare) else "cut"), "blank", ""
    m = _LAST.search(line)
    last = m.group().lower() if m else ""
    near = before[-NEAR_LINES:]
    # table rows: as many commas as the rows before
    commas = Counter(x.count(",") for x in near if x.count(",") >= 2 and not _STOP.search(x))
    if commas and (k := commas.most_common(1)[0])[1] >= min(2, len(near)) and ", " not in near[-1]:
        if line.count(",") < k[0]:
            return "cut", "row", last
        field = line.rsplit(",", 1)[1]
        if not field or _PART_DATE.match(field) or (field.isdigit() and any(_DATE.search(x) for x in near)):
            return "cut", "row", last
        return ("whole" if _DATE.search(field) else "open"), "row", last
    settings = [x for x in near if _SETTING.match(x)]
    if len(settings) * 2 > len(near) or (near and near[-1].lstrip().startswith("[") and near[-1].rstrip().endswith("]") and "=" in line):
        if line.startswith("["):
            return ("whole" if line.endswith("]") else "cut"), "setting", last
        key, sign, value = line.partition("=")
        value = value.strip()
        if not sign or not value or value.startswith('"') and (len(value) < 2 or not value.endswith('"')):
            return "cut", "setting", last
        return ("whole" if value.endswith('"') else "open"), "setting", last
    if _BULLET.match(line) or re.fullmatch(r"\s*[-*•+]\s?", line):
        words = line.split()
        if len(words) < 2:
            return "cut", "list", last
        word = words[-1]
        if _STOP.search(line) and not re.search(r"/[^\s]*\.$", line):
            return "whole", "list", last
        if not word[-1].isalnum() and word[-1] not in ")]\"'”»":
            return "cut", "list", last
        if "/" in word and not re.search(r"\.[A-Za-z0-9]{1,5}$", word):
            return "cut", "list", last
        if "/" in word and re.search(r"\.[A-Za-z]\w{2,4}$", word):
            return "open", "path", last
        rows = [x.split()[-1] for x in near if _BULLET.match(x)]
        if re.fullmatch(r"[a-z]+", word) and rows and not any(re.fullmatch(r"[a-z]+", x) for x in rows):
            return "cut", "list", last
        return "open", "list", last
    code = [x for x in lines[-NEAR_LINES:-1] if _CODE_END.search(x) or re.match(r"\s*(?:def |return |#include|import |let |static |for |if )", x) or re.search(r"\w\(.*\)\s*(?:[;:]|#.*)?$|\w = \w", x)]
    if len(code) * 2 >= max(1, len(near)) and code and not re.match(r"\s*(?://|#)\s", line):
        if _CODE_END.search(line) or re.search(r"\)\s*:?$", line) and line.count("(") == line.count(")"):
            return "whole", "code", last
        if line.count("(") != line.count(")") or line.count("[") != line.count("]") or line.count('"') % 2 or not re.search(r"[\w)\]\"']$", line):
            return "cut", "code", last
        if sum(bool(_CODE_END.search(x)) for x in code) > len(code) * 0.8 and not re.search(r"//|#", line):
            return "cut", "code", last
        return "open", "code", last
    # prose
    if _STOP.search(line):
        # a stop after some digits or in a path may be one inside a number, a date or a name
        half = re.search(r"(?<!\d)\d{1,3}\.$|/[^\s]*\.$", line) and not _DATE.search(line[:-1])
        return ("open" if half else "whole"), "sentence", last
    if line.rstrip()[-1] in ",;:-–—([{/\\=&+<":
        return "cut", "sentence", last
    if re.match(r"#+ \S|=+ ", line):
        return "open", "heading", last
    if _INNER_STOP.search(line):
        return "cut", "sentence", last
    words = line.split()
    spoken = sum(bool(_STOP.search(x)) for x in near)
    if len(words) >= 4 and spoken and re.match(r"[\"“«¿¡('‘]*[^\W\d_a-z]", line):
        return "cut", "sentence", last
    if re.match(r"\d{1,4}[-.]\d", line):
        return "cut", "sentence", last
    return "open", "short", last


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", 4 << 20):
        found = [ending(x) for x in b.column("text").to_pylist()]
        keep = [k for k in b.schema.names if k != "text"]
        ends = [x.rstrip(_INVISIBLE).rsplit("\n", 2)[-2:] for x in b.column("text").to_pylist()]
        cols = [pa.array([f[k] for f in found], pa.string()) for k in range(3)]
        cols.append(pa.array([e[-1] if len(e[-1]) <= SHORT_LINE else None for e in ends], pa.string()))
        cols.append(pa.array([e[0] if len(e) > 1 and 0 < len(e[0]) <= SHORT_LINE else None for e in ends], pa.string()))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *cols], names=[*keep, "verdict", "form", "last", "last_line", "line_before"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word parts that don't stand at the end of a text."""
    count: Counter[str] = Counter()
    for b in slices(batches, "text", 4 << 20):
        for x in b.column("text").to_pylist():
            parts = _SEGMENT.findall(x)
            if not x.rstrip(_INVISIBLE).endswith("\n"):
                del parts[-1:]
            count.update(parts)
        if len(count) > 200_000:
            yield _emit(count)
            count.clear()
    if count:
        yield _emit(count)


def _emit(count: Counter[str]) -> pa.RecordBatch:
    low: Counter[str] = Counter()
    for k, n in count.items():
        low[k.lower()] += n
    return pa.RecordBatch.from_arrays([pa.array(low.keys(), pa.string()), pa.array(low.values(), pa.int64())], names=["part", "n"])


def _beginnings(sizes: list[int]):
    """(h, n): hash of the first k characters of every part, for the lengths k that last words have. Every part is read
    once; parts longer than k are at most all characters divided by k, so that the rows stay few however long parts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes: list[int] = []
            counts: list[int] = []
            for part, n in zip(b.column("part").to_pylist(), b.column("n").to_pylist()):
                state, at = xxhash.xxh64(seed=42), 0  # as the engine's xxhash64
                for k in sizes:
                    if k >= len(part):
                        break
                    state.update(part[at:k].encode("utf-8", "surrogatepass"))
                    at = k
                    hashes.append(state.intdigest())
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(counts, pa.int64())], names=["h", "n"])

    return run


def measures(text: Column) -> dict[str, Column]:
    """Lengths of text in every measure."""
    chars, size = F.length(text), F.octet_length(text)

    def number(pattern: str) -> Column:
        return chars - F.length(F.regexp_replace(text, pattern, ""))

    lines, amp, angle, quote = number("\n"), number("&"), number("[<>]"), number('"')
    slash, tabs = number(r"\\"), number("[\t\r]")
    four = number(r"[\x{10000}-\x{10FFFF}]")
    entity = 4 * amp + 3 * angle
    escapes = lines + quote + slash + tabs
    wide = number(r"[^\x00-\x7f]")
    return {
        "chars": chars, "bytes": size, "utf16": chars + four,
        "crlf_chars": chars + lines, "crlf_bytes": size + lines,
        "entity_chars": chars + entity, "entity_bytes": size + entity,
        "entity_quote_chars": chars + entity + 5 * quote, "entity_quote_bytes": size + entity + 5 * quote,
        "json_chars": chars + escapes, "json_bytes": size + escapes,
        "json_ascii": chars + escapes + 5 * wide + 6 * four,
    }


def _spikes(lengths: DataFrame, names: tuple[str, ...], least: int, share: float, times: float, span: int) -> DataFrame:
    """(source, measure, value, n): lengths of at least `least` texts and a share of the source's, at least `times` as
    frequent as those within `span` of them."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in names]))
    count = lengths.select("source", pairs.alias("p")).groupBy("source", "p.measure", "p.value").agg(F.count("*").alias("n"))
    around = Window.partitionBy("source", "measure").orderBy("value").rangeBetween(-span, span)
    near = (F.sum("n").over(around) - F.col("n")) / (2.0 * span)
    size = lengths.groupBy("source").agg(F.count("*").alias("size"))
    return count.withColumn("near", near).join(size, "source").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("size")) & (F.col("n") >= times * (F.col("near") + 0.25))).select("source", "measure", "value", "n")


def storage_limits(lengths: DataFrame, declared: DataFrame, least: int = 5, share: float = 0.002, times: float = 6.0, span: int = 30) -> DataFrame:
    """(source, measure, value, n, declared) limits exposed by lengths (source, h: hash of the text, all measures);
    declared: source, value in bytes. Equal texts of a source count once."""
    lengths = lengths.select("source", "h", *PLAIN_MEASURES, *OTHER_MEASURES).dropDuplicates(["source", "h"]).drop("h")
    known = declared.select("source", F.lit("bytes").alias("measure"), "value").distinct()
    plain = staged(_spikes(lengths, PLAIN_MEASURES, least, share, times, span))
    simple = plain.select("source", "measure", "value").unionByName(known).distinct()
    rest = lengths
    for k in PLAIN_MEASURES:
        hit = simple.filter(F.col("measure") == k).select("source", F.col("value").alias(k))
        rest = rest.join(hit, ["source", k], "left_anti")
    other = _spikes(rest.select(*lengths.columns), OTHER_MEASURES, least, share, times, span)
    # the number of a declared limit, reached in another form
    return plain.unionByName(other).join(known.select("source", "value").distinct().withColumn("declared", F.lit(True)), ["source", "value"], "left").select("source", "measure", "value", "n", F.coalesce("declared", F.lit(False)).alias("declared"))


def exposed_limits(texts: DataFrame, declared: DataFrame) -> DataFrame:
    """storage_limits of texts (source, text) and declared (source, value)."""
    src = texts.select(F.coalesce("source", F.lit("")).alias("source"), "text").filter("text is not null and text <> ''")
    declared = declared.select(F.coalesce("source", F.lit("")).alias("source"), F.col("value").cast("int").alias("value")).filter("value is not null")
    lengths = staged(src.select("source", F.xxhash64("text").alias("h"), *[c.alias(k) for k, c in measures(F.col("text")).items()]))
    return storage_limits(lengths, declared).withColumn("source", F.when(F.col("source") != "", F.col("source")))


def truncated(texts: DataFrame, declared: DataFrame, closing: int = 5) -> DataFrame:
    """(origin, rec_id, source, form, at_limit, evidence, measure, value, truncated) of every text that is neither null nor
    empty; measure and value of the limit are given where it is the evidence.

    texts: origin, rec_id, source, text; declared: source, value (bytes)."""
    src = texts.select("origin", "rec_id", F.coalesce("source", F.lit("")).alias("source"), "text").filter("text is not null and text <> ''")
    declared = declared.select(F.coalesce("source", F.lit("")).alias("source"), F.col("value").cast("int").alias("value")).filter("value is not null")
    look = staged(src.select("origin", "rec_id", "source", F.xxhash64("text").alias("h"), *[c.alias(k) for k, c in measures(F.col("text")).items()], "text").mapInArrow(_look, _LOOK))
    limits = storage_limits(look, declared)
    pairs = limits.select("source", "measure", "value").unionByName(declared.select("source", F.lit("bytes").alias("measure"), "value")).distinct()
    # limits are few: a handful for each source; they are grouped into one row per source
    by_source = pairs.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("measure", "value"))).alias("limits"))
    reached = " or ".join(f"p.measure = '{k}' and p.value = {k}" for k in (*PLAIN_MEASURES, *OTHER_MEASURES))
    hit = F.expr(f"try_element_at(filter(limits, p -> {reached}), 1)")
    # a character cut in two can cost up to three bytes, or gain two as U+FFFD
    near = F.expr("try_element_at(filter(limits, p -> p.measure = 'bytes' and bytes between p.value - 3 and p.value + 2), 1)")
    atl = look.join(by_source, "source", "left").withColumn("hit", hit).withColumn("near", near).drop("limits")
    last = atl.filter("verdict = 'open' and last <> ''").select("last").distinct()
    parts = staged(src.select("text").mapInArrow(_parts, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")))
    sizes = sorted(r[0] for r in last.select(F.length("last")).distinct().collect())  # no more than the longest has characters
    known = last.select("last", F.xxhash64("last").alias("h"))
    longer = parts.mapInArrow(_beginnings(sizes), "h long, n long").join(known, "h").groupBy("last").agg(F.sum("n").alias("longer"))
    whole = parts.join(last, F.col("part") == F.col("last"), "left_semi").select(F.col("part").alias("last"), F.col("n").alias("whole"))
    ends = parts.filter("length(part) >= 4").groupBy(F.expr("right(part, 3)").alias("tail")).agg(F.sum("n").alias("ended"))
    # closing formulas: short lines that end many different texts, or stand before their last line, and aren't far rarer
    # than the longer ones they begin: those are closings cut short, however many
    every = look.select("h", F.explode(F.array("last_line", "line_before")).alias("line")).filter("line is not null and line <> ''").groupBy("line").agg(F.count_distinct("h").alias("alike"))
    lines = staged(every.filter(F.col("alike") >= closing))
    starts = (
        lines.select("alike", F.explode(F.expr("transform(sequence(1, greatest(size(split(line, ' ')) - 1, 1)), i -> array_join(slice(split(line, ' '), 1, i), ' '))")).alias("last_line"), "line")
        .filter("last_line <> line")
        .groupBy("last_line")
        .agg(F.sum("alike").alias("going_on"))
    )
    inside = (
        lines.select("alike", F.explode(F.expr("transform(sequence(1, greatest(length(line) - 1, 1)), i -> substring(line, 1, i))")).alias("start"), "line")
        .filter("start <> line")
        .groupBy("start")
        .agg(F.sum("alike").alias("extended"))
    )
    closings = lines.join(inside, F.col("line") == F.col("start"), "left").select(F.col("line").alias("last_line"), ((F.col("alike") * RARER >= F.coalesce("extended", F.lit(0)))).alias("closing"))
    joined = atl.join(longer, "last", "left").join(whole, "last", "left").join(closings, "last_line", "left").join(starts, "last_line", "left")
    joined = joined.withColumn("tail", F.expr("right(last, 3)")).join(ends, "tail", "left")
    whole_n, longer_n = F.coalesce("whole", F.lit(0)), F.coalesce("longer", F.lit(0))
    broken = (F.col("last") != "") & (longer_n > 0) & ((whole_n == 0) | (whole_n * 60 < longer_n))
    # a word seen nowhere, and ending as no word does
    broken = broken | F.col("last").rlike("^[a-z]{4,}$") & (whole_n == 0) & (longer_n == 0) & F.col("ended").isNull()
    closed = (F.col("form") == "short") & F.coalesce("closing", F.lit(False))
    broken = broken | (F.col("form") == "short") & ~F.coalesce("closing", F.lit(True)) | (F.col("form") == "short") & (F.coalesce("going_on", F.lit(0)) > 0) & (F.size(F.split("last_line", " ")) < 4)
    # the exposed limit first, then the ending by itself
    at_limit = F.col("hit").isNotNull() | F.col("near").isNotNull() & (F.col("form") != "short")
    unfinished = F.col("verdict") == "cut"
    undecided = (F.col("verdict") == "open") & ~closed
    by_limit = at_limit & (unfinished | undecided & (broken | (F.col("form") != "path")))
    evidence = F.when(F.coalesce(by_limit, F.lit(False)), "limit").when(F.coalesce(unfinished | undecided & broken, F.lit(False)), "ending")
    limit = F.coalesce("hit", "near")
    out = joined.withColumn("evidence", evidence).withColumn("limit", limit)
    return out.select(
        "origin", "rec_id", F.when(F.col("source") != "", F.col("source")).alias("source"), "form", limit.isNotNull().alias("at_limit"), "evidence",
        F.when(F.col("evidence") == "limit", F.col("limit.measure")).alias("measure"), F.when(F.col("evidence") == "limit", F.col("limit.value")).alias("value"),
        F.col("evidence").isNotNull().alias("truncated"),
    )


_LOOK = "origin string, rec_id long, source string, h long, " + "".join(f"{k} int, " for k in (*PLAIN_MEASURES, "utf16", *OTHER_MEASURES[1:])) + "verdict string, form string, last string, last_line string, line_before string"


def source_shares(found: DataFrame) -> DataFrame:
    """(source, texts, truncated, share, at_limit, by_limit, by_ending) of each source."""
    cut = F.count_if("truncated")
    return found.groupBy("source").agg(
        F.count("*").alias("texts"), cut.alias("truncated"), (cut / F.count("*")).alias("share"), F.count_if("at_limit").alias("at_limit"),
        F.count_if(F.col("evidence") == "limit").alias("by_limit"), F.count_if(F.col("evidence") == "ending").alias("by_ending"),
    )
