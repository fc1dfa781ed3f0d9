"""The change stream: events to actions, pairing of moves, last action per path, applying batches.

Events: op (index, remove, remove_tree, moved_from, moved_to, overflow, watch_limit), path, is_dir, cookie, ts, arrived_at. A move is
a removal of its old path and an indexing of its new one; a lone moved_from is a removal, a lone moved_to an indexing.
An overflow asks for a full reconciliation; a watch_limit says that some folders will have no events.

Defined results: events of null path other than overflow, and of unknown op, are dropped; events delivered twice count
once; of several actions on a path the one of the latest ts counts (then of the highest change_id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintain import live_docs, tombstone

SCHEMA = "change_id long, op string, path string, is_dir boolean, cookie long, ts timestamp, arrived_at timestamp"


def action() -> Column:
    """Of an event by itself: index, scan (a folder to list), remove, remove_tree, reconcile."""
    is_dir = F.coalesce("is_dir", F.lit(False))
    return (
        F.when(F.col("op") == "overflow", "reconcile")
        .when(F.col("path").isNull(), None)
        .when(F.col("op").isin("index", "moved_to"), F.when(is_dir, "scan").otherwise("index"))
        .when(F.col("op") == "remove_tree", "remove_tree")
        .when(F.col("op").isin("remove", "moved_from"), F.when(is_dir, "remove_tree").otherwise("remove"))
    )


def actions(changes: DataFrame) -> DataFrame:
    """(change_id, action, path, ts) of every event that has one, deliveries of one event counted once."""
    once = changes.groupBy("change_id", "op", "path", "is_dir", "cookie", "ts").agg(F.min("arrived_at").alias("arrived_at"))
    return once.select("change_id", action().alias("action"), "path", "ts").filter("action is not null")


def moves(changes: DataFrame) -> DataFrame:
    """(cookie, old_path, new_path, is_dir) of all moves; a missing half is null. Events of null cookie pair with none."""
    halves = changes.filter(F.col("op").isin("moved_from", "moved_to") & F.col("cookie").isNotNull() & F.col("path").isNotNull())
    side = halves.groupBy("cookie", "op").agg(F.min(F.struct("ts", "change_id", "path", "is_dir")).alias("e"))
    old = side.filter("op = 'moved_from'").select("cookie", F.col("e.path").alias("old_path"), F.col("e.is_dir").alias("old_dir"))
    new = side.filter("op = 'moved_to'").select("cookie", F.col("e.path").alias("new_path"), F.col("e.is_dir").alias("new_dir"))
    return old.join(new, "cookie", "full").select("cookie", "old_path", "new_path", F.coalesce("old_dir", "new_dir", F.lit(False)).alias("is_dir"))


def last_actions(changes: DataFrame) -> DataFrame:
    """(path, action, ts) the last action of every path: an aggregate, so that a path of a tenth of all events is
    reduced before the shuffle."""
    a = actions(changes).filter("path is not null")
    return a.groupBy("path").agg(F.max(F.struct("ts", "change_id", "action")).alias("e")).select("path", F.col("e.action").alias("action"), F.col("e.ts").alias("ts"))


def late_deliveries(changes: DataFrame, allowed_s: int = 3600) -> DataFrame:
    """(op, events, late, twice) by op: deliveries, those later than allowed, and repeated ones."""
    each = changes.groupBy("change_id", "op").agg(F.count("*").alias("n"), F.count_if(F.unix_micros("arrived_at") - F.unix_micros("ts") > allowed_s * 1_000_000).alias("late"))
    return each.groupBy("op").agg(F.sum("n").alias("events"), F.sum("late").alias("late"), F.sum(F.col("n") - 1).alias("twice"))


def ancestors() -> Column:
    """Every folder above a path, and itself: joined with folders, there is no comparison of all with all."""
    return F.expr("transform(sequence(2, greatest(size(split(path, '/')), 2)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")


def scanned(listing: DataFrame, changes: DataFrame) -> DataFrame:
    """(path) of listed files under folders that were created or moved in."""
    folders = actions(changes).filter("action = 'scan'").select(F.col("path").alias("folder")).distinct()
    return listing.select("path", F.explode(ancestors()).alias("folder")).join(folders, "folder", "left_semi").select("path").distinct()


def apply_batch(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files after a batch: removed paths and everything under removed folders are tombstones, paths to be indexed that
    are known become pending. A path under a removed folder is revived by a later event of its own."""
    last = last_actions(changes)
    gone = last.filter("action = 'remove'").select("path")
    # also of folders that came again later
    trees = actions(changes).filter("action = 'remove_tree'").groupBy(F.col("path").alias("tree")).agg(F.max("ts").alias("tree_ts"))
    if trees.isEmpty():  # no folder has gone: the files needn't be held against their folders
        under = last.select("path", F.col("ts").alias("tree_ts")).limit(0)
    else:
        # merged: by its estimate, which doesn't see what explode adds, the planner would broadcast every folder of every file
        every = files.select("path", F.explode(ancestors()).alias("tree")).hint("merge")
        under = every.join(trees, "tree").groupBy("path").agg(F.max("tree_ts").alias("tree_ts"))
    own = last.select("path", F.col("ts").alias("own_ts"), "action")
    dead = under.join(own, "path", "left").filter("own_ts is null or own_ts <= tree_ts or action like 'remove%'").select("path").unionByName(gone).distinct()
    again = last.filter("action = 'index'").select("path").join(dead, "path", "left_anti").withColumn("_again", F.lit(True))
    out = tombstone(files, dead).join(again, "path", "left")
    return out.withColumn("state", F.when(F.col("_again"), 1).otherwise(F.col("state"))).select(files.columns)


def start(spark: SparkSession, source: str, checkpoint: str, apply: Callable[[DataFrame, int], None], files_per_batch: int = 512, housekeeping: Callable[[], None] | None = None, every: int = 20, reconcile: Callable[[], None] | None = None, available_now: bool = True, changes_per_call: int = 0) -> StreamingQuery:
    """Read a folder of Parquet change files as a stream and apply it: calls of apply of at most about changes_per_call
    changes each, in order of arrival (0: one call a batch), a call of reconcile after a batch with an overflow, of
    housekeeping after every `every` batches. A call that fails ends the stream before its batch counts as done."""

    def one(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for part in in_order(batch, changes_per_call):
                apply(part, number)
            if reconcile and not batch.filter("op = 'overflow'").isEmpty():
                reconcile()
            if housekeeping and number % every == every - 1:
                housekeeping()
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()


def due_times(ticks: DataFrame, interval_s: int, degraded_s: int) -> DataFrame:
    """(t, degraded) of the ticks (t in seconds, degraded) at which a full reconciliation falls due: the first, and then the
    first at least an interval after the last one. From a tick that says so on the interval is the degraded one, for good.
    Ticks are as many as there are turns of a clock, and go through one row."""
    each = ticks.filter("t is not null").groupBy("t").agg(F.bool_or(F.coalesce("degraded", F.lit(False))).alias("degraded"))
    turns = each.agg(F.sort_array(F.collect_list(F.struct("t", "degraded"))).alias("turns"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("short"), F.expr("cast(array() as array<struct<t:bigint,degraded:boolean>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        short = acc["short"] | x["degraded"]
        due = acc["last"].isNull() | (x["t"] - acc["last"] >= F.when(short, degraded_s).otherwise(interval_s))
        out = F.when(due, F.concat(acc["out"], F.array(F.struct(x["t"].alias("t"), short.alias("degraded"))))).otherwise(acc["out"])
        return F.struct(F.when(due, x["t"]).otherwise(acc["last"]).alias("last"), short.alias("short"), out.alias("out"))

    return turns.select(F.explode(F.aggregate("turns", start, step)["out"]).alias("d")).select("d.t", "d.degraded")


def in_order(batch: DataFrame, most: int) -> list[DataFrame]:
    """The batch in parts of about `most` changes by order of arrival; those that arrived together stay together."""
    n = batch.count() if most else 0
    if n <= most:
        return [batch]
    at = F.unix_micros("arrived_at")
    cuts = batch.select(at.alias("t")).approxQuantile("t", [k * most / n for k in range(1, -(-n // most))], 0.0)
    edges = sorted(set(cuts))
    known = [batch.filter(at.isNull() | (at <= edges[0]))]
    known += [batch.filter((at > a) & (at <= b)) for a, b in zip(edges, edges[1:])]
    return [*known, batch.filter(at > edges[-1])]


def pair_moves_stream(changes: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """(cookie, old_path, new_path) of a stream, halves of a move up to `wait` of event time apart, across batches.
    Halves that stay alone come out with the other path null once the watermark has passed."""
    base = changes.filter(F.col("op").isin("moved_from", "moved_to") & F.col("cookie").isNotNull())
    old = base.filter("op = 'moved_from'").select(F.col("cookie").alias("c1"), F.col("path").alias("old_path"), F.col("ts").alias("t1")).withWatermark("t1", wait)
    new = base.filter("op = 'moved_to'").select(F.col("cookie").alias("c2"), F.col("path").alias("new_path"), F.col("ts").alias("t2")).withWatermark("t2", wait)
    near = F.expr(f"c1 = c2 and t2 >= t1 - interval {wait} and t2 <= t1 + interval {wait}")
    return old.join(new, near, "fullOuter").select(F.coalesce("c1", "c2").alias("cookie"), "old_path", "new_path")


__all__ = ["SCHEMA", "action", "actions", "ancestors", "apply_batch", "due_times", "in_order", "last_actions", "late_deliveries", "live_docs", "moves", "pair_moves_stream", "scanned", "start"]
