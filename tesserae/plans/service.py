"""A file index as a whole: crawling, extracting, updating, reconciling and searching.

The state is a SnapshotStore of files, docs, postings and lengths. Every change appends segments as large as itself, in a
new version, so searches go on meanwhile; `maintain` merges them. Names and contents of files stay with the tasks that
read them.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, dirname, excluded
from ..operators import maintain as m
from ..operators.fusion import name_scan
from ..operators.index import BUCKETS, Index
from ..session import staged, staging
from ..sources.files import ContentConfig, ingest, listing
from ..streaming import changes as stream
from ..streaming.changes import SCHEMA, actions, apply_batch, last_actions, scanned

BATCH = 512  # changes applied at a time
MERGE_AFTER = 8  # segments of a table
_FILES = "id long, path string, name string, parent string, size long, mtime_ns long, mime string, content_hash binary, indexed_at long, state int"
_HITS = "id long, path string, name string, mime string, score double"


class Paused(RuntimeError):
    """A batch came while paused: it isn't applied and has to come again."""


class ContentService:
    """reindex, clear, reconcile, apply (a batch of changes), tick, watch, exclude, pause, resume, status, find, search."""

    def __init__(self, spark: SparkSession, path: str, config: ContentConfig, now: int = 0, buckets: int = BUCKETS) -> None:
        self.spark, self.config, self.now, self.buckets = spark, config, now, buckets
        self.store = m.SnapshotStore(spark, path, writer=True, match_mode=config.match)
        self.paused, self.degraded = False, False
        self.last_reconcile: float | None = None
        self.counters = dict.fromkeys(("batches", "indexed", "errors", "touched", "removed", "reconciled"), 0)
        self._one = threading.RLock()  # the stream and the clock take turns

    def _files(self) -> DataFrame:
        t = self.store.table("files")
        return self.spark.createDataFrame([], _FILES) if t is None else t

    def _index(self) -> Index:
        s = self.store.manifest.stats
        n, total = int(s.get("documents", 0)), int(s.get("length", 0))
        return Index(self.store.table("postings"), self.store.table("lengths"), self.store.table("docs"), self._files(), True, stats=(n, total / n if n else 0.0, total), buckets=int(s.get("buckets", BUCKETS)))

    # ---- updates

    def clear(self) -> None:
        """An empty index."""
        empty = {"files": _FILES, "docs": "id long, name string, body string"}
        tables = {k: self.spark.createDataFrame([], v) for k, v in empty.items()}
        ix = Index.of(tables["docs"])
        ix.buckets = self.buckets
        with self._one:
            self.store.commit(stats={"documents": 0, "length": 0, "buckets": self.buckets}, lengths=ix.lengths, postings=ix.bucketed_postings(), **tables)

    def reindex(self) -> None:
        """Forget everything and read all files."""
        self.clear()
        self.reconcile()

    def reconcile(self) -> None:
        """Compare the folders with the index: read what is new or changed, drop what has vanished or is excluded."""
        if self.paused:
            return
        with self._one, staging(self.spark):
            seen = staged(listing(self.spark, self.config))
            files = self._files()
            todo = staged(m.decide(seen, files).filter("action <> 'unchanged'"))
            touched = seen.join(todo.filter("action = 'touch'").select("path"), "path", "left_semi")
            new = todo.filter("action in ('new', 'index')").select("path")
            cap = self.config.max_index_mb << 20
            if not cap:
                self._update(new, m.vanished(files, seen), touched)
            else:
                self._update(new.limit(0), m.vanished(files, seen), touched)
                self._crawl(new, seen, cap)
            self.counters["reconciled"] += 1
            self.last_reconcile = self._clock()

    def _crawl(self, new: DataFrame, seen: DataFrame, cap: int) -> None:
        """Read new files in rounds as large as what is left under the cap, until it is reached; the others stay unknown."""
        size = seen.join(new, "path", "left_semi").agg(F.sum("size")).first()[0] or 0
        rounds = -(-size // max(1, cap - self.store.bytes())) if self.store.bytes() < cap else 0
        for k in range(rounds):
            if self.store.bytes() >= cap:
                return
            self._update(new.filter(F.pmod(F.xxhash64("path"), F.lit(rounds)) == k), self._files().select("path").limit(0))

    def apply(self, changes: DataFrame, number: int = 0) -> None:
        """A batch of change events; an overflow reconciles instead. While paused the batch is refused, so that a stream
        stops before it and delivers it again."""
        if self.paused:
            raise Paused("paused")
        with self._one, staging(self.spark):
            if not changes.filter("op = 'watch_limit'").isEmpty():
                self.degraded = True  # for good: some folders have no events
            self.counters["batches"] += 1
            if not changes.filter("op = 'overflow'").isEmpty():
                self.reconcile()
                return
            files = self._files()
            gone = apply_batch(files, changes).filter(F.col("state") == m.TOMBSTONE).join(files.filter(F.col("state") == m.TOMBSTONE).select("id"), "id", "left_anti").select("path")
            paths = last_actions(changes).filter("action = 'index'").select("path")
            paths = paths.filter(~excluded(F.col("path"), self.config.exclude_paths, self.config.excludes))
            if not actions(changes).filter("action = 'scan'").isEmpty():  # new folders: no events of their files follow
                paths = paths.unionByName(scanned(listing(self.spark, self.config), changes)).distinct()
            self._update(paths, gone)

    def exclude(self, folder: str) -> None:
        """Never read a folder again, and drop what is known of it."""
        self.config.exclude_paths.append(folder)
        with self._one, staging(self.spark):
            files = self._files()
            self._update(files.select("path").limit(0), m.live_paths(files).filter(excluded(F.col("path"), [folder])))

    def _update(self, paths: DataFrame, gone: DataFrame, touched: DataFrame | None = None) -> None:
        """Read the files named in paths, drop those of gone, take over size and time of touched ones."""
        if not self.store.manifest.segments:
            self.clear()
        files = self._files()
        read = staged(ingest(paths.distinct(), self.config))
        p = F.col("path")
        changed = read.select(
            p, basename(p).alias("name"), dirname(p).alias("parent"), "size", "mtime_ns", F.when(F.col("mime") != "", F.col("mime")).alias("mime"),
            F.when(F.col("text") != "", m.content_hash("text")).alias("content_hash"), F.lit(self.now).cast("long").alias("indexed_at"),
            F.when(F.col("status").isin("error", "timeout"), m.ERROR).otherwise(m.INDEXED).alias("state"),
        )
        rows = staged(m.upserted(files, changed))
        seen = files.limit(0) if touched is None else m.touch(files.join(touched.select("path"), "path", "left_semi"), touched)
        dead = files.join(gone.select("path").distinct(), "path", "left_semi").join(rows.select("path"), "path", "left_anti")
        more = staged(seen.unionByName(m.tombstone(dead, dead.select("path")).select(seen.columns)).join(rows.select("path"), "path", "left_anti"))
        docs = staged(read.select("path", F.col("text").alias("body")).join(rows.select("path", "id", "name"), "path").select("id", "name", "body"))
        counts = {(r.state, r.kind): r.n for r in rows.select("state", F.lit("read").alias("kind")).unionByName(more.select("state", F.lit("kept").alias("kind"))).groupBy("state", "kind").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return
        ids = rows.select("id").unionByName(more.select("id"))
        old = rows.select("id").unionByName(more.filter(F.col("state") == m.TOMBSTONE).select("id"))
        ix = Index.of(docs)
        ix.buckets = int(self.store.manifest.stats["buckets"])
        out = self.store.table("lengths").join(old, "id", "left_semi").agg(F.count("*"), F.sum("len")).first()
        new = ix.lengths.agg(F.count("*"), F.sum("len")).first()
        s = self.store.manifest.stats
        stats = {"documents": s.get("documents", 0) - out[0] + new[0], "length": s.get("length", 0) - (out[1] or 0) + (new[1] or 0)}
        self.store.append({"files": ids, **dict.fromkeys(("docs", "lengths", "postings"), old)}, {"postings": "bucket"}, stats, files=rows.unionByName(more), docs=ix.docs, lengths=ix.lengths, postings=ix.bucketed_postings())
        self.counters["indexed"] += counts.get((m.INDEXED, "read"), 0)
        self.counters["errors"] += counts.get((m.ERROR, "read"), 0)
        self.counters["removed"] += counts.get((m.TOMBSTONE, "kept"), 0)
        self.counters["touched"] += sum(n for (state, kind), n in counts.items() if kind == "kept" and state != m.TOMBSTONE)

    def maintain(self) -> None:
        """Housekeeping: purge tombstones, merge tables of many segments, remove old versions."""
        with self._one, staging(self.spark):
            if not self.store.manifest.segments:
                return
            many = set(self.store.scattered(MERGE_AFTER))
            tables = {k: self.store.table(k) for k in many - {"files"}}
            if "postings" in tables:
                tables["postings"] = tables["postings"].repartitionByRange("bucket", "term", F.desc("id")).sortWithinPartitions("bucket", "term", F.desc("id"), "col", "pos")
            dead = self._files().filter(F.col("state") == m.TOMBSTONE)
            if many or not dead.isEmpty():
                self.store.commit({"postings": "bucket"}, files=m.purged(self._files()), **tables)
            self.store.vacuum()

    # ---- control

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def reconcile_interval(self) -> int:
        """Seconds between full reconciliations; shorter once watches are known to be missing."""
        return self.config.reconcile_interval_degraded_s if self.degraded else self.config.reconcile_interval_s

    def _clock(self) -> float:
        return time.time()

    def tick(self, now: float | None = None) -> bool:
        """Reconcile if the last one is an interval ago; the next is due an interval after this one."""
        now = self._clock() if now is None else now
        if self.paused or self.last_reconcile is not None and now - self.last_reconcile < self.reconcile_interval():
            return False
        self.reconcile()
        self.last_reconcile = now
        return True

    def watch(self, source: str, checkpoint: str, until: Callable[[], bool], step_s: float = 1.0) -> None:
        """Apply the changes that arrive in a folder, reconcile and maintain at their times, until told to stop. While
        paused there is no stream; its changes are read after `resume`."""
        query = None
        try:
            while not until():
                if query is not None and not query.isActive:
                    failed, query = query.exception(), None
                    if failed and not self.paused:
                        raise failed
                if query is None and not self.paused:
                    query = stream.start(self.spark, source, checkpoint, self.apply, housekeeping=self.maintain, available_now=False, changes_per_call=BATCH)
                self.tick()
                time.sleep(step_s)
        finally:
            if query is not None:
                query.stop()

    def status(self) -> dict:
        ago = None if self.last_reconcile is None else int(self._clock() - self.last_reconcile)
        return m.state_counts(self._files()).first().asDict() | self.counters | {
            "bytes": self.store.bytes(), "paused": self.paused, "degraded": self.degraded, "interval": self.reconcile_interval(), "last_reconcile_ago": ago,
        }

    # ---- queries

    def find(self, text: str, limit: int = 200, least: int = 2) -> DataFrame:
        """Files by name; texts of fewer than `least` bytes find nothing."""
        files = self._files().filter(F.col("state") != m.TOMBSTONE)
        return name_scan(files if len(text.encode()) >= least else files.limit(0), text, limit)

    def search(self, query: str, limit: int | None = None, **options) -> DataFrame:
        if len(query.encode()) < self.config.min_query or not self.store.manifest.segments:
            return self.spark.createDataFrame([], _HITS)
        return self._index().search(query, self.config.max_results if limit is None else limit, mode=self.store.manifest.match_mode, **options)


__all__ = ["SCHEMA", "ContentService", "Paused"]
