"""One ranked list from several providers, and grouping of windows.

Providers give (kind, name, path, score, seq). The best score of all but content becomes the Top Hit (the first of
equals), the others keep their provider's order; content hits come last, in their own order.

Defined results: no items give no lines; a null score ranks last; equal scores keep the provider's order; items of a kind
without section, or null, keep their place with a null section. Windows of a null app form one group; null flags count
as not set. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .maintain import numbered

#: Section of each kind.
SECTIONS = {"calculator": "APPLICATIONS", "command": "APPLICATIONS", "application": "APPLICATIONS", "file": "FILES & FOLDERS", "folder": "FILES & FOLDERS", "content": "CONTENTS"}
ORDER = ("calculator", "command", "application", "file", "folder", "content")


MOST_LINES = 10_000  # rows of a list that is numbered in one task


def percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles of value by group, and its maximum as `worst`; null values don't count."""
    ranks = [F.expr(f"percentile_disc({p}) within group (order by {value})").alias(k) for k, p in shares.items()]
    return rows.filter(F.col(value).isNotNull()).groupBy(group).agg(*ranks, F.max(value).alias("worst"))


def name_scan(files: DataFrame, text: str, limit: int = 200) -> DataFrame:
    """(path, name, size) of files with text in their name, in any case, first by path."""
    return files.filter(F.instr(F.lower("name"), text.lower()) > 0).orderBy("path").limit(limit).select("path", "name", "size")


def best_files(scored: DataFrame, limit: int = 8) -> DataFrame:
    """The best rows by score, then seq."""
    return scored.orderBy(F.desc("score"), "seq").limit(limit)


def best_per_group(items: DataFrame, group: str, k: int) -> DataFrame:
    """The k best rows of each group by score, then seq."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), "seq")
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(items: DataFrame) -> DataFrame:
    """(position, section, kind, name, path, score): items are the few rows that providers return; the first MOST_LINES of
    each kind by score, then seq, are taken."""
    items = best_per_group(items, "kind", MOST_LINES).drop("rank")
    place = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("kind")).cast("int")
    items = items.withColumn("provider", F.when(F.col("kind").isin("file", "folder"), 4).otherwise(F.when(place > 0, place).otherwise(5)))
    content = F.coalesce(F.col("kind") == "content", F.lit(False))
    ranked = items.withColumn("best", F.row_number().over(Window.orderBy(content.cast("int"), F.when(~content, -F.col("score")).asc_nulls_last(), "provider", "seq")))
    line = ranked.withColumn("position", F.row_number().over(Window.orderBy((F.col("best") != 1).cast("int"), "provider", "seq")))
    section = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return line.select("position", F.when(F.col("position") == 1, "TOP HIT").otherwise(section[F.col("kind")]).alias("section"), "kind", "name", "path", "score")


def section_runs(lines: DataFrame) -> DataFrame:
    """(run, section, first, items) of consecutive rows of one section."""
    w = Window.orderBy("position")
    flagged = lines.withColumn("new", (F.coalesce(F.lag("section").over(w) != F.col("section"), F.lit(True))).cast("int"))
    return flagged.withColumn("run", F.sum("new").over(w)).groupBy("run", "section").agg(F.min("position").alias("first"), F.count("*").alias("items"))


def groups(windows: DataFrame) -> DataFrame:
    """Windows (handle, app, active, minimized, seq, used) by app, most recently used first: rank, windows, any_active,
    all_minimized, primary (active, then not minimized, then first)."""
    priority = F.when(F.col("active"), 0).when(~F.col("minimized"), 1).otherwise(2)
    windows = windows.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("active", "minimized")})
    g = windows.groupBy("app").agg(
        F.max("used").alias("used"), F.count("*").alias("windows"), F.bool_or("active").alias("any_active"), F.bool_and("minimized").alias("all_minimized"),
        F.min_by("handle", F.struct(priority, "seq", "handle")).alias("primary"),
    )
    return numbered(g, F.desc("used"), "app").withColumn("rank", F.col("number").cast("int")).drop("number")


def carried(windows: DataFrame, before: DataFrame, clock: int) -> DataFrame:
    """groups of windows (handle, app, active, minimized, seq) with the use stamps of the state before (app, used): an app
    known there keeps its stamp, new ones get the next ones after `clock` in order of their first window, and the app of
    the active window (the first such app) gets the latest of all."""
    first = windows.groupBy("app").agg(F.min(F.struct("seq", "handle")).alias("first"), F.bool_or(F.coalesce("active", F.lit(False))).alias("on"))
    old = before.groupBy("app").agg(F.max("used").alias("old"))
    j = first.join(old, first["app"].eqNullSafe(old["app"]), "left").select(first["app"], "first", "on", "old")
    fresh = numbered(j.filter("old is null"), "first").withColumn("used", F.lit(clock) + F.col("number")).select("app", "first", "on", "used")
    every = fresh.unionByName(j.filter("old is not null").withColumnRenamed("old", "used"))
    head = every.filter("on").agg(F.min("first").alias("head"), F.lit(True).alias("one"))
    top = every.agg(F.greatest(F.max("used"), F.lit(clock)).alias("top"), F.lit(True).alias("one"))
    marks = F.broadcast(head.join(top, "one"))  # a row
    stamped = every.withColumn("one", F.lit(True)).join(marks, "one", "left").select("app", F.when(F.col("first") == F.col("head"), F.col("top") + 1).otherwise(F.col("used")).alias("used"))
    return groups(windows.drop("used").join(stamped.withColumnRenamed("app", "_app"), F.col("app").eqNullSafe(F.col("_app"))).drop("_app"))


def cycle(ranked: DataFrame) -> DataFrame:
    """ranked (rank, app) with the next and previous app, around the ends, and whether it is preselected (the second)."""
    total = ranked.agg(F.count("*").cast("int").alias("n")).withColumn("one", F.lit(1))
    r = ranked.select("rank", "app", F.lit(1).alias("one")).join(F.broadcast(total), "one").drop("one")
    after = r.select(((F.col("rank") + F.col("n") - 2) % F.col("n") + 1).alias("rank"), F.col("app").alias("next_app"))
    before = r.select((F.col("rank") % F.col("n") + 1).alias("rank"), F.col("app").alias("previous_app"))
    return r.join(after, "rank").join(before, "rank").select("rank", "app", "next_app", "previous_app", (F.col("rank") == F.least(F.lit(2), F.col("n"))).alias("preselected"))
