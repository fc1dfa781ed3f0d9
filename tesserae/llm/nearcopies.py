"""Near copies: exact set-similarity self-join of documents on runs of consecutive terms.

Method: set-relation skipping. A prefix index (rarest runs first) lists documents by run. Each list is ordered by set
size, and the position of the run in a document's order gives the largest partner its remaining runs can still
reach; the block of the list beyond that is jumped over (`_list_pairs`). A document's answers are then derived from
those of a highly similar one, its leader: overlaps with the leader are computed once, and the overlap of two
documents of one leader follows from their differences to it alone (`_overlap_by_differences`). Documents whose sets
are equal form one class, computed once and represented by its lowest id.

Frequencies: documents are held in slices of some megabytes of text. Only the distinct runs of a slice are shuffled, once
to be counted over all slices (`_shared`) and, if another document has them, once back to their slice, where the order of
every document's runs is made (`_postings`). A run of a third of all documents costs one row per slice.

Defined results: null, empty and short texts (fewer than min_terms terms, or fewer than `width`) have no row in any
result; repeated rows count once (rows of one id but different texts are not expected); an empty table gives empty
results; extra columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import mixed, run_hashes, slices
from ..session import spread, staged
from .codes import Terms

SET_COLUMNS = "part long, id long, n int, set_a long, set_b long, bits array<long>, items array<long>"
BIT_WORDS = 8  # of 64 bits; with sets of some hundred runs, as good as all pairs below the similarity are excluded
SLICE_BYTES = 4 << 20


def _sets(width: int, min_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, b in enumerate(slices(batches, "text", SLICE_BYTES)):
            t = Terms(b.column("text"))
            size = np.bincount(t.row, minlength=b.num_rows)
            keep = np.flatnonzero(size >= max(min_terms, width))
            if not len(keep):
                continue
            runs = run_hashes(t.hash, width)
            row = t.row[: len(runs)]
            whole = (row == t.row[width - 1 :]) & (size >= max(min_terms, width))[row]
            runs, row = runs[whole], row[whole]
            order = np.lexsort((runs, row))
            runs, row = runs[order], row[order]
            once = np.ones(len(runs), bool)
            once[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
            runs, row = runs[once], row[once]
            start = np.searchsorted(row, keep)
            n = np.diff(np.append(start, len(row)))
            again = mixed(runs)
            number = np.repeat(np.arange(len(keep)), n)
            places = number * (64 * BIT_WORDS) + (again & np.uint64(64 * BIT_WORDS - 1)).astype(np.int64)
            parity = np.bincount(places, minlength=len(keep) * 64 * BIT_WORDS).astype(np.uint8) & 1
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(again, start).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keep), part + k)),
                    b.column("id").take(pa.array(keep)),
                    pa.array(n.astype(np.int32)),
                    pa.array(np.bitwise_xor.reduceat(again, start).view(np.int64)),
                    pa.array(sums),
                    _lists(np.packbits(parity).view(np.int64), np.arange(len(keep) + 1) * BIT_WORDS),
                    _lists(runs.view(np.int64), np.append(start, len(runs))),
                ],
                names=["part", "id", "n", "set_a", "set_b", "bits", "items"],
            )

    return run


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int64()))


def run_sets(docs: DataFrame, id_col: str, text_col: str, width: int = 3, min_terms: int = 20) -> DataFrame:
    """One row per document long enough: its slice, its set of runs (hashes, sorted), two sums identifying the set, and a
    parity bitmap."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    return spread(src).mapInArrow(_sets(width, min_terms), SET_COLUMNS)


def _runs_of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, item, n): distinct runs of each slice and in how many of its documents (equal sets count once)."""
    for b in batches:
        part = b.column("part").to_numpy()
        for p in np.unique(part):
            rows = b.filter(pa.array(part == p))
            key = np.stack([rows.column(c).to_numpy() for c in ("set_a", "set_b")])
            first = np.unique(key, axis=1, return_index=True)[1]
            items = rows.column("items").take(pa.array(first)).flatten().to_numpy()
            runs, n = np.unique(items, return_counts=True)
            for at in range(0, len(runs), 100_000):
                z = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs[z]), p)), pa.array(runs[z]), pa.array(n[z].astype(np.int32))], names=["part", "item", "n"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, item, df) of runs that more than one document has. Rows come sorted by item; one of many slices may go on
    in the next batches, so the rows of the last item are held back: a row for each slice at most."""
    held = None

    def counted(t: pa.Table) -> Iterator[pa.RecordBatch]:
        item = t["item"].to_numpy()
        start = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        df = np.add.reduceat(t["n"].to_numpy().astype(np.int64), start)
        df = np.repeat(df, np.diff(np.append(start, len(item))))
        more = df > 1
        yield pa.RecordBatch.from_arrays([pa.array(t["part"].to_numpy()[more]), pa.array(item[more]), pa.array(df[more])], names=["part", "item", "df"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.table(b) if held is None else pa.concat_tables([held, pa.table(b)])
        item = t["item"].to_numpy()
        end = int(np.searchsorted(item, item[-1]))
        if end:
            yield from counted(t.slice(0, end))
        held = t.slice(end)
    if held is not None and held.num_rows:
        yield from counted(held)


def _postings(num: int, den: int, block: int):
    """Of one slice: its documents in order of their runs, and the prefix of each as postings. Runs that no other
    document has come first and have no posting."""

    def run(sets: pa.Table, shared: pa.Table) -> pa.Table:
        is_rep = pa.compute.is_null(shared["df"])
        reps = np.unique(shared.filter(is_rep)["item"].to_numpy())
        known = shared.filter(pa.compute.invert(is_rep))
        names, at = np.unique(known["item"].to_numpy(), return_index=True)
        freq = known["df"].to_numpy()[at]
        ids, at = np.unique(sets["id"].to_numpy(), return_index=True)
        at = at[np.isin(ids, reps)]
        sets = sets.take(pa.array(at)).combine_chunks()
        if not sets.num_rows or not len(names):
            return pa.table({"item": [], "blocks": [], "id": [], "n": [], "reach": []}, _POSTING)
        lists = sets["items"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        items = lists.flatten().to_numpy()
        n = sets["n"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        hit = np.minimum(np.searchsorted(names, items), len(names) - 1)
        common = names[hit] == items
        row, item, df = row[common], items[common], freq[hit[common]]
        order = np.lexsort((item, df, row))
        row, item, df = row[order], item[order], df[order]
        size = np.bincount(row, minlength=len(n))
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + (n - size)[row]
        prefix = n + (-n * num // den) + 1
        reach = np.minimum(1 << 30, (n[row] - place) * (num + den) // num - n[row])
        keep = (place < prefix[row]) & (reach > 0)
        row, item, df = row[keep], item[keep], df[keep]
        return pa.table({"item": item, "blocks": (-(-df // block)).astype(np.int32), "id": sets["id"].to_numpy()[row], "n": n[row].astype(np.int32), "reach": reach[keep].astype(np.int32)}, _POSTING)

    return run


_POSTING = pa.schema([("item", pa.int64()), ("blocks", pa.int32()), ("id", pa.int64()), ("n", pa.int32()), ("reach", pa.int32())])


def _least(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Fewest shared items for a Jaccard similarity of num/den: ceil(num (n+m) / (num+den))."""
    return -((-num * (n + m)) // (num + den))


def _list_pairs(num: int, den: int):
    """Candidate pairs of each list. Rows come sorted by (item, block_a, block_b, n, id).

    A posting at position p of a set of n items has rest = n - p items from p on, so a partner of m items must have
    least(n, m) <= rest, that is m <= (num+den)/num * rest - n: its reach. In order of size everything past the reach is
    skipped as one block."""
    names = ("item", "block_a", "block_b", "block", "id", "n", "reach")

    def pairs(t: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(t["id"]), bool)
        new[1:] = (t["item"][1:] != t["item"][:-1]) | (t["block_a"][1:] != t["block_a"][:-1]) | (t["block_b"][1:] != t["block_b"][:-1])
        group = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(new))
        n, reach = t["n"].astype(np.int64), t["reach"].astype(np.int64)
        big = int(max(n.max(), reach.max())) + 1
        place = group * (big + 1) + n  # ascending: lists in order, sizes within
        stop = np.minimum(np.searchsorted(place, group * (big + 1) + np.clip(reach, 0, big), "right"), ends[group])
        limit = np.minimum(stop, np.searchsorted(place, group * (big + 1) + np.minimum(n * den // num, big), "right"))
        live = np.arange(len(n))
        found, held, step = [], 0, 1
        while len(live := live[live + step < limit[live]]):
            for i in np.array_split(live, max(1, len(live) // 2_000_000)):
                j = i + step
                ok = reach[j] >= n[i]
                cross = t["block_a"][i] != t["block_b"][i]
                ok &= ~cross | (t["block"][i] != t["block"][j])
                a, b = t["id"][i[ok]], t["id"][j[ok]]
                ok = a != b
                found.append(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]]))
                held += found[-1].shape[1]
                if held > 4_000_000:
                    yield _distinct(found)
                    found, held = [], 0
            step += 1
        if held:
            yield _distinct(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            tb = pa.Table.from_batches(held).combine_chunks()
            t = {k: tb[k].to_numpy() for k in names}
            end = len(t["id"])
            if not last:  # the last list may go on in the next batch
                same = (t["item"] == t["item"][-1]) & (t["block_a"] == t["block_a"][-1]) & (t["block_b"] == t["block_b"][-1])
                end -= int(same[::-1].argmin()) if not same.all() else end
            if end:
                yield from pairs({k: v[:end] for k, v in t.items()})
            held = tb.slice(end).to_batches()
            rows = len(t["id"]) - end

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
                if rows >= 200_000:
                    yield from flush(False)
        if rows:
            yield from flush(True)

    return run


def _distinct(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["id_a", "id_b"])


def candidates(sets: DataFrame, reps: DataFrame, num: int = 1, den: int = 2, block: int = 4096) -> DataFrame:
    """(id_a < id_b, n_a, n_b) of sets sharing a run of both prefixes that no bound excludes. No pair with similarity >=
    num/den is lost. Lists longer than `block` are cut into blocks, each pair of blocks its own group, so that a run held
    by a third of all documents spreads over many tasks.

    sets as run_sets gives them; reps: part, id of those to compare."""
    counts = sets.select("part", "set_a", "set_b", "items").mapInArrow(_runs_of_slices, "part long, item long, n int")
    shared = counts.repartition("item").sortWithinPartitions("item").mapInArrow(_shared, "part long, item long, df long")
    named = shared.unionByName(reps.select("part", F.col("id").alias("item"), F.lit(None).cast("long").alias("df")))
    postings = (
        sets.select("part", "id", "n", "items").groupBy("part").cogroup(named.groupBy("part")).applyInArrow(_postings(num, den, block), "item long, blocks int, id long, n int, reach int")
        .withColumn("block", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).otherwise(0))
        .withColumn("other", F.explode(F.when(F.col("blocks") > 1, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
        .select("item", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "id", "n", "reach")
    )
    lists = postings.repartition("item", "block_a", "block_b").sortWithinPartitions("item", "block_a", "block_b", "n", "id")
    found = lists.mapInArrow(_list_pairs(num, den), "id_a long, id_b long").distinct()
    # pairs whose parity bitmaps differ too much for the overlap are dropped
    maps = sets.select("id", "n", "bits").join(reps.select("id"), "id", "left_semi").dropDuplicates(["id"])
    for s in ("a", "b"):
        found = found.join(maps.select(F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")), f"id_{s}")
    apart = sum((F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(BIT_WORDS)), F.lit(0))
    size = F.col("n_a") + F.col("n_b")
    return found.filter(F.floor((size - apart) / 2) * (num + den) >= num * size).select("id_a", "id_b", "n_a", "n_b")


def _overlap(a: str, b: str):
    return F.size(F.array_intersect(a, b))


def _overlap_by_differences(pairs: DataFrame) -> DataFrame:
    """|x ∩ y| of two sets from their differences to a common leader L:
    |L| - |L\\x| - |L\\y| + |(L\\x) ∩ (L\\y)| + |(x\\L) ∩ (y\\L)|."""
    return pairs.withColumn(
        "common",
        F.col("n_lead") - F.size("less_a") - F.size("less_b") + _overlap("less_a", "less_b") + _overlap("more_a", "more_b"),
    )


def similar_sets(sets: DataFrame, reps: DataFrame, num: int = 1, den: int = 2, block: int = 4096) -> DataFrame:
    """Pairs (id_a < id_b, n_a, n_b, common) of sets with Jaccard similarity >= num/den; exact."""
    cand = staged(candidates(sets, reps, num, den, block))
    ids = cand.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    of_cand = staged(sets.select("id", "n", "items").join(ids, "id", "left_semi").dropDuplicates(["id"]))
    lead = cand.groupBy("id_b").agg(F.min("id_a").alias("lead")).withColumnRenamed("id_b", "id")
    as_lead = of_cand.select(F.col("id").alias("lead"), F.col("n").alias("n_lead"), F.col("items").alias("lead_items"))
    led = (
        lead.join(of_cand, "id")
        .join(as_lead, "lead")
        .select(
            "id", "n", "lead", "n_lead",
            F.array_except("lead_items", "items").alias("less"),
            F.array_except("items", "lead_items").alias("more"),
        )
    )
    led = staged(led)
    direct = led.select(F.col("lead").alias("id_a"), F.col("id").alias("id_b"), F.col("n_lead").alias("n_a"), F.col("n").alias("n_b"), (F.col("n_lead") - F.size("less")).alias("common"))

    def side(s: str) -> DataFrame:
        return led.select(F.col("id").alias(f"id_{s}"), F.col("lead").alias(f"lead_{s}"), F.col("n_lead").alias(f"nl_{s}"), F.col("less").alias(f"less_{s}"), F.col("more").alias(f"more_{s}"))

    slim = led.select("id", "lead")
    rest = (
        cand.join(slim.select(F.col("id").alias("id_b"), F.col("lead").alias("lead_b")), "id_b")
        .filter("id_a <> lead_b")
        .join(slim.select(F.col("id").alias("id_a"), F.col("lead").alias("lead_a")), "id_a", "left")
    )
    same = rest.filter("lead_a = lead_b").drop("lead_a", "lead_b").join(side("a"), "id_a").join(side("b").drop("lead_b", "nl_b"), "id_b").withColumnRenamed("nl_a", "n_lead")
    derived = _overlap_by_differences(same).select("id_a", "id_b", "n_a", "n_b", "common")
    other = rest.filter("lead_a is null or lead_a <> lead_b").drop("lead_a", "lead_b")
    fetched = (
        other.join(of_cand.select(F.col("id").alias("id_a"), F.col("items").alias("items_a")), "id_a")
        .join(of_cand.select(F.col("id").alias("id_b"), F.col("items").alias("items_b")), "id_b")
        .select("id_a", "id_b", "n_a", "n_b", _overlap("items_a", "items_b").alias("common"))
    )
    found = direct.unionByName(derived).unionByName(fetched)
    return found.filter(F.col("common") * (num + den) >= num * (F.col("n_a") + F.col("n_b")))


def classes(sets: DataFrame) -> DataFrame:
    """(id, rep, part): documents with equal sets share rep, their lowest id; part is a slice the document is in."""
    key = ["set_a", "set_b", "n"]
    once = sets.groupBy("id", *key).agg(F.min("part").alias("part"))
    return once.join(once.groupBy(*key).agg(F.min("id").alias("rep")), key).select("id", "rep", "part")


def near_copies(docs: DataFrame, id_col: str = "id", text_col: str = "body_z", num: int = 1, den: int = 2, width: int = 3, min_terms: int = 20, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep; links: id_a, id_b, n_a, n_b, common between representatives)."""
    sets = staged(run_sets(docs, id_col, text_col, width, min_terms))
    members = staged(classes(sets))
    reps = members.filter("id = rep").select("part", "id")
    return members.select("id", "rep"), similar_sets(sets, reps, num, den, block)


def near_copy_pairs(docs: DataFrame, id_col: str = "id", text_col: str = "body_z", block: int = 4096, **options) -> DataFrame:
    """All pairs (id_a < id_b) of documents, exact copies included. Its size is that of the answer: a class of k equal
    documents has k(k-1)/2 pairs, made in groups of at most two blocks; near_copies gives the same answer unexpanded."""
    members, links = near_copies(docs, id_col, text_col, block=block, **options)
    many = members.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select("rep", F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    m = members.join(many, "rep", "left").select("rep", "id", "blocks", F.pmod(F.xxhash64("id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("cell"))
    cells = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    # a link meets the members of its classes cell by cell: no key holds more than a block of a class
    between = links.select("id_a", "id_b")
    for s in ("a", "b"):
        between = between.join(many.withColumnRenamed("rep", f"id_{s}"), f"id_{s}", "left").withColumn("cell", cells).drop("blocks")
        between = between.join(m.select(F.col("rep").alias(f"id_{s}"), "cell", F.col("id").alias(f"x_{s}")), [f"id_{s}", "cell"]).drop("cell")
    between = between.select(F.least("x_a", "x_b").alias("id_a"), F.greatest("x_a", "x_b").alias("id_b"))
    # every copy once by its own cell, and once for each cell to meet those of it
    copies = m.filter("blocks is not null")
    spread_out = copies.select("rep", F.col("id").alias("id_b"), cells.alias("cell"))
    within = copies.select("rep", F.col("id").alias("id_a"), "cell").join(spread_out, ["rep", "cell"]).filter("id_a < id_b").select("id_a", "id_b")
    return between.unionByName(within)


def near_copy_groups(docs: DataFrame, id_col: str = "id", text_col: str = "body_z", max_rounds: int = 30, **options) -> DataFrame:
    """One row per document long enough: id, group_id (lowest id reachable over links), rep, links (of its representative).

    Groups are connected components by repeated lowest-label exchange with pointer jumping; each round is a join on the
    links of representatives, staged in the shared folder, until nothing changes."""
    members, links = near_copies(docs, id_col, text_col, **options)
    links = staged(links.select("id_a", "id_b"))
    both = links.unionByName(links.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")))
    label = staged(both.groupBy(F.col("id_a").alias("id")).agg(F.min("id_b").alias("m"), F.count("*").alias("links")).select("id", F.least("id", "m").alias("label"), "links"))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("id").alias("id_b"), "label"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.min("label").alias("m"))
        step = label.join(near, "id").select("id", F.least("label", "m").alias("label"), "links", F.col("label").alias("old"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = staged(step.join(jump, "label", "left").select("id", F.least("label", "far").alias("label"), "links", "old"))
        changed = new.filter("label <> old").limit(1).count()
        label = new.drop("old")
        if not changed:
            break
    else:
        raise RuntimeError(f"groups not settled after {max_rounds} rounds")
    return members.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("label", "rep").alias("group_id"), "rep", F.coalesce("links", F.lit(0)).alias("links"))
