"""Keeping the index tables up to date: change decisions, upserts, deletes, snapshots.

All operations take and give whole DataFrames; SnapshotStore writes their results, or only what changed, as new versions,
so that readers see one version or the other. States: 0 indexed, 1 pending, 2 tombstone, 3 error.

Defined results: paths are keys - of several updates of one path the last by `seq` (else the greatest row) counts; null
paths are ignored; empty updates change nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import within
from ..session import staged

INDEXED, PENDING, TOMBSTONE, ERROR = 0, 1, 2, 3
FILE_COLUMNS = ("id", "path", "name", "parent", "size", "mtime_ns", "mime", "content_hash", "indexed_at", "state")


def content_hash(text: str) -> object:
    """8 bytes that are equal for equal contents (null for null)."""
    return F.when(F.col(text).isNotNull(), F.unhex(F.lpad(F.hex(F.xxhash64(text)), 16, "0")))


def decide(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action) of every listed file: new, unchanged (indexed, same size and time), touch (same content, only
    metadata differs) or index. listing may have content_hash, computed for candidates only."""
    known = files.filter("path is not null").select("path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("content_hash").alias("old_hash"), F.col("state").alias("old_state"))
    given = [c for c in ("path", "size", "mtime_ns", "content_hash") if c in listing.columns]
    joined = listing.select(given).filter("path is not null").join(known, "path", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime"))
    action = F.when(F.col("old_state").isNull(), "new").when((F.col("old_state") == INDEXED) & same, "unchanged")
    if "content_hash" in listing.columns:
        action = action.when(F.col("content_hash") == F.col("old_hash"), "touch")
    return joined.select("path", action.otherwise("index").alias("action"))


def vanished(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Live paths that are no longer listed."""
    return files.filter((F.col("state") != TOMBSTONE) & F.col("path").isNotNull()).select("path").join(listing.select("path"), "path", "left_anti")


def _latest(updates: DataFrame) -> DataFrame:
    order = [F.desc(c) for c in (("seq",) if "seq" in updates.columns else ("indexed_at", "mtime_ns", "size"))]
    w = Window.partitionBy("path").orderBy(*order)
    return updates.filter("path is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "seq")


def upsert(files: DataFrame, updates: DataFrame) -> DataFrame:
    """files with the rows of updates (all columns but id) in place of those of equal path, which keep their id; new
    paths get ids after the largest, in order of path."""
    rows = upserted(files, updates)
    return files.join(rows.select("path"), "path", "left_anti").select(rows.columns).unionByName(rows)


def upserted(files: DataFrame, updates: DataFrame) -> DataFrame:
    """The rows of updates with their ids."""
    given = [c for c in (*FILE_COLUMNS, "seq") if c in updates.columns]
    new = _latest(updates.select(given))
    ids = files.groupBy("path").agg(F.min("id").alias("id"))
    known = new.drop("id").join(ids, "path")
    fresh = new.drop("id").join(ids, "path", "left_anti")
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).withColumn("one", F.lit(1))
    fresh = numbered(fresh, "path").withColumn("one", F.lit(1)).join(F.broadcast(top), "one").withColumn("id", F.col("top") + F.col("number")).drop("top", "one", "number")
    cols = [c for c in FILE_COLUMNS if c in files.columns]
    return known.select(cols).unionByName(fresh.select(cols))


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with `number`, 1.. in an order without ties, without gathering it in one task: counts per range come first.

    The ranges are written to the shared folder, as rows must not move between counting and numbering."""
    parts = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy(*order)
    local = parts.withColumn("_n", F.row_number().over(w))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return local.join(F.broadcast(before), "_part").withColumn("number", F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def touch(files: DataFrame, seen: DataFrame) -> DataFrame:
    """New size and time of seen paths (path, size, mtime_ns); they become indexed, errors too."""
    s = seen.filter("path is not null").groupBy("path").agg(F.max(F.struct("mtime_ns", "size")).alias("_seen"))
    j = files.join(s, "path", "left")
    hit = F.col("_seen").isNotNull()
    return j.withColumn("size", F.when(hit, F.col("_seen.size")).otherwise(F.col("size"))).withColumn("mtime_ns", F.when(hit, F.col("_seen.mtime_ns")).otherwise(F.col("mtime_ns"))).withColumn("state", F.when(hit, INDEXED).otherwise(F.col("state"))).select(files.columns)


def remove(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path"), "path", "left_anti").select(files.columns)


def remove_subtree(files: DataFrame, folder: str) -> DataFrame:
    """Without the folder and all under it; an empty folder or '/' is refused."""
    if not folder.strip("/"):
        raise ValueError("refusing to remove everything")
    return files.filter(F.col("path").isNull() | ~within(F.col("path"), folder))


def tombstone(files: DataFrame, paths: DataFrame) -> DataFrame:
    """State 2 for the paths; their documents go with live_docs."""
    hit = paths.select("path").distinct().withColumn("_hit", F.lit(True))
    return files.join(hit, "path", "left").withColumn("state", F.when(F.col("_hit"), TOMBSTONE).otherwise(F.col("state"))).select(files.columns)


def live_docs(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents (or postings) of files that exist and are no tombstones."""
    return docs.join(files.filter(F.col("state") != TOMBSTONE).select("id"), "id", "left_semi")


def lookup(files: DataFrame, path: str) -> DataFrame:
    """The row of a path, or none."""
    return files.filter(F.col("path") == path)


def live_paths(files: DataFrame) -> DataFrame:
    """(path) of all files but tombstones."""
    return files.filter(F.col("state") != TOMBSTONE).select("path")


def purged(files: DataFrame) -> DataFrame:
    return files.filter(F.col("state") != TOMBSTONE)


def state_counts(files: DataFrame) -> DataFrame:
    named = ((INDEXED, "indexed"), (PENDING, "pending"), (TOMBSTONE, "tombstones"), (ERROR, "errors"))
    return files.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == k).alias(n) for k, n in named])


class IndexUnavailable(RuntimeError):
    """reason: no_index, version_mismatch."""

    def __init__(self, reason: str) -> None:
        super().__init__(reason)
        self.reason = reason


@dataclass
class Manifest:
    """What a version consists of. segments: of each table (folder, number), number being the version that wrote it; gone:
    of each table folders of ids whose rows in segments of lower number no longer count."""

    schema_version: int = 3
    version: int = 0
    match_mode: str = "prefix"
    tokenizer: str = "segments"
    segments: dict[str, list[list]] = field(default_factory=dict)
    gone: dict[str, list[list]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    stats: dict[str, float] = field(default_factory=dict)


class SnapshotStore:
    """Tables as Parquet segments under one folder. A version is a file manifest-<number>.json, made by one rename to a
    name that isn't taken; readers take the highest number, so that they see one version or the other, whenever a
    writer stops. Of two writers of one version the second fails."""

    def __init__(self, spark: SparkSession, path: str, writer: bool = False, match_mode: str = "prefix") -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self._read()
        if writer:
            if found is None or found.schema_version != Manifest.schema_version or found.match_mode != match_mode:
                found = Manifest(match_mode=match_mode, version=max(self._versions(), default=0))  # rebuilt from nothing
        elif found is None:
            raise IndexUnavailable("no_index")
        elif found.schema_version != Manifest.schema_version:
            raise IndexUnavailable("version_mismatch")
        self.manifest, self.writer = found, writer

    def _versions(self) -> list[int]:
        folder = self._hadoop.Path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n))]

    def _read(self) -> Manifest | None:
        versions = self._versions()
        if not versions:
            return None
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{max(versions):012d}.json").collect())
        known = json.loads(text)
        return Manifest(**{k: v for k, v in known.items() if k in Manifest.__dataclass_fields__})

    def table(self, name: str) -> DataFrame | None:
        """The live rows of a table, or None."""
        if name not in self.manifest.segments:
            return None
        schema = StructType.fromJson(json.loads(self.manifest.schemas[name]))
        out = None
        for folder, number in self.manifest.segments[name]:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").withColumn("_number", F.lit(number))
            out = part if out is None else out.unionByName(part)
        least = min(n for _, n in self.manifest.segments[name])
        lists = [(f, n) for f, n in self.manifest.gone.get(name, []) if n > least]
        if lists:
            gone = None
            for folder, number in lists:
                part = self.spark.read.schema("id long").parquet(f"{self.path}/{folder}").withColumn("_gone", F.lit(number))
                gone = part if gone is None else gone.unionByName(part)
            out = out.join(gone.groupBy("id").agg(F.max("_gone").alias("_gone")), "id", "left").filter("_gone is null or _number >= _gone").drop("_gone")
        return out.drop("_number").select(schema.names)

    def commit(self, partition: dict[str, str] | None = None, stats: dict[str, float] | None = None, **tables: DataFrame) -> None:
        """A new version in which each table given is one segment; the others stay as they are."""
        new = self._next()
        for name, df in tables.items():
            new.segments[name] = [self._save(new, name, df, partition)]
            new.gone.pop(name, None)
        self._publish(new, stats)

    def append(self, gone: dict[str, DataFrame], partition: dict[str, str] | None = None, stats: dict[str, float] | None = None, **tables: DataFrame) -> None:
        """A new version with further segments: rows of the ids gone (of each table) stop counting, those of tables are
        added. What is written is as large as the change."""
        new = self._next()
        for name, ids in gone.items():
            folder, _ = self._save(new, f"{name}-gone", ids.select("id").distinct(), None, keep=False)
            new.gone.setdefault(name, []).append([folder, new.version])
        for name, df in tables.items():
            new.segments.setdefault(name, []).append(self._save(new, name, df, partition))
        self._publish(new, stats)

    def _next(self) -> Manifest:
        if not self.writer:
            raise PermissionError("opened for reading")
        new = Manifest(**json.loads(json.dumps(asdict(self.manifest))))
        new.version += 1
        return new

    def _save(self, new: Manifest, name: str, df: DataFrame, partition: dict[str, str] | None, keep: bool = True) -> list:
        folder = f"{name}-{new.version:012d}-{uuid.uuid4().hex[:8]}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition[name]) if partition and name in partition else w).parquet(f"{self.path}/{folder}")
        if keep:
            new.schemas[name] = df.schema.json()
        return [folder, new.version]

    def _publish(self, new: Manifest, stats: dict[str, float] | None) -> None:
        new.stats = new.stats | (stats or {})
        tmp = self._hadoop.Path(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(asdict(new)), "utf-8"))
        out.close()
        self._swap(tmp, self._hadoop.Path(f"{self.path}/manifest-{new.version:012d}.json"))
        self.manifest = new

    def _swap(self, tmp, final) -> None:
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            self._fs.delete(tmp, False)
            raise RuntimeError("another writer has made this version")

    def scattered(self, most: int) -> list[str]:
        """Tables of more than `most` segments."""
        return [name for name, parts in self.manifest.segments.items() if len(parts) > most]

    def vacuum(self) -> None:
        """Remove manifests and folders other than the current ones."""
        used = {f for parts in (*self.manifest.segments.values(), *self.manifest.gone.values()) for f, _ in parts} | {f"manifest-{self.manifest.version:012d}.json"}
        for status in self._fs.listStatus(self._hadoop.Path(self.path)):
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)

    def bytes(self) -> int:
        """Size of the current version."""
        return sum(self._fs.getContentSummary(self._hadoop.Path(f"{self.path}/{f}")).getLength() for parts in self.manifest.segments.values() for f, _ in parts)
