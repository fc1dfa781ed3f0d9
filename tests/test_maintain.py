import pytest
from pyspark.sql import functions as F

from tesserae.operators import maintain as m

SCHEMA = "id long, path string, name string, parent string, size long, mtime_ns long, mime string, content_hash binary, indexed_at long, state int"


def files(spark, rows):
    return spark.createDataFrame([(i, p, (p or "").rsplit("/", 1)[-1], "/d", s, t, "text/plain", h, 1, st) for i, p, s, t, h, st in rows], SCHEMA)


def state(df):
    return {r.path: (r.id, r.size, r.state) for r in df.collect()}


def test_upsert_keeps_ids(spark):
    old = files(spark, [(1, "/d/a", 1, 1, None, 0), (7, "/d/b", 1, 1, None, 3)])
    new = files(spark, [(0, "/d/b", 5, 2, None, 0), (0, "/d/z", 9, 2, None, 0), (0, "/d/c", 8, 2, None, 0), (0, "/d/c", 9, 3, None, 0), (0, None, 1, 1, None, 0)])
    assert state(m.upsert(old, new)) == {"/d/a": (1, 1, 0), "/d/b": (7, 5, 0), "/d/c": (8, 9, 0), "/d/z": (9, 9, 0)}
    none = files(spark, [])
    assert state(m.upsert(old, none)) == state(old)
    assert state(m.upsert(none, old)) == {"/d/a": (1, 1, 0), "/d/b": (2, 1, 3)}


def test_numbering_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = m.numbered(df, "k").collect()
    assert sorted((r.k, r.number) for r in got) == [(k, k + 1) for k in range(1000)]


def test_decisions(spark):
    known = files(spark, [(1, "/d/same", 1, 1, b"h", 0), (2, "/d/moved", 1, 1, b"h", 0), (3, "/d/err", 1, 1, b"h", 3), (4, "/d/new text", 1, 1, b"h", 0)])
    seen = spark.createDataFrame([("/d/same", 1, 1, b"h"), ("/d/moved", 1, 2, b"h"), ("/d/err", 1, 1, b"h"), ("/d/new text", 2, 2, b"i"), ("/d/x", 1, 1, None), (None, 1, 1, None)], "path string, size long, mtime_ns long, content_hash binary")
    assert {r.path: r.action for r in m.decide(seen, known).collect()} == {"/d/same": "unchanged", "/d/moved": "touch", "/d/err": "touch", "/d/new text": "index", "/d/x": "new"}


def test_removal(spark):
    f = files(spark, [(1, "/proj", 1, 1, None, 0), (2, "/proj/sub/x", 1, 1, None, 0), (3, "/proj2/y", 1, 1, None, 0)])
    assert set(state(m.remove_subtree(f, "/proj"))) == {"/proj2/y"}
    for bad in ("", "/"):
        with pytest.raises(ValueError):
            m.remove_subtree(f, bad)
    paths = spark.createDataFrame([("/proj2/y",), ("/proj2/y",), ("/none",)], "path string")
    dead = m.tombstone(f, paths)
    assert state(dead)["/proj2/y"] == (3, 1, 2) and dead.count() == 3
    assert set(state(m.purged(dead))) == {"/proj", "/proj/sub/x"}
    docs = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "id long, body string")
    assert [r.id for r in m.live_docs(docs, dead).collect()] == [1]
    assert m.state_counts(dead).first().asDict() == {"total": 3, "indexed": 2, "pending": 0, "tombstones": 1, "errors": 0}
    assert [r.path for r in m.vanished(dead, spark.createDataFrame([("/proj",)], "path string")).collect()] == ["/proj/sub/x"]


def test_touch_revives_errors(spark):
    f = files(spark, [(1, "/a", 1, 1, None, 3)])
    seen = spark.createDataFrame([("/a", 4, 9)], "path string, size long, mtime_ns long")
    assert state(m.touch(f, seen)) == {"/a": (1, 4, 0)}


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(m.IndexUnavailable, match="no_index"):
        m.SnapshotStore(spark, path)
    w = m.SnapshotStore(spark, path, writer=True)
    w.commit(files=files(spark, [(1, "/a", 1, 1, None, 0)]), docs=spark.createDataFrame([(1, "x")], "id long, body string"))
    reader = m.SnapshotStore(spark, path)
    seen = reader.table("files")
    w.commit(files=m.remove(w.table("files"), spark.createDataFrame([("/a",)], "path string")))
    assert seen.count() == 1  # the old version stays readable
    again = m.SnapshotStore(spark, path)
    assert again.table("files").count() == 0 and again.table("docs").count() == 1 and again.bytes() > 0
    with pytest.raises(PermissionError):
        again.commit(files=seen)
    w.vacuum()
    w.manifest.schema_version = 1
    w.commit()
    with pytest.raises(m.IndexUnavailable, match="version_mismatch"):
        m.SnapshotStore(spark, path)
    assert m.SnapshotStore(spark, path, writer=True).table("files") is None


def test_crash_between_write_and_swap(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    w = m.SnapshotStore(spark, path, writer=True)
    w.commit(files=files(spark, [(1, "/a", 1, 1, None, 0)]))

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as mp:
        mp.setattr(m.SnapshotStore, "_swap", crash)
        with pytest.raises(OSError):
            w.append({"files": spark.createDataFrame([(1,)], "id long")}, files=files(spark, [(2, "/b", 1, 1, None, 0)]))
    for store in (w, m.SnapshotStore(spark, path), m.SnapshotStore(spark, path, writer=True)):
        assert [r.path for r in store.table("files").collect()] == ["/a"]
    other = m.SnapshotStore(spark, path, writer=True)
    w.append({"files": spark.createDataFrame([(1,)], "id long")}, files=files(spark, [(2, "/b", 1, 1, None, 0)]))
    with pytest.raises(RuntimeError, match="another writer"):
        other.commit(files=files(spark, []))
    assert [r.path for r in m.SnapshotStore(spark, path).table("files").collect()] == ["/b"]
    w.vacuum()
    assert [r.path for r in m.SnapshotStore(spark, path).table("files").collect()] == ["/b"] and len(list((tmp_path / "store").glob("manifest-*.json"))) == 1


def test_segments(spark, tmp_path):
    """Rows gone in one version can come again in a later one."""
    w = m.SnapshotStore(spark, f"file://{tmp_path}/store", writer=True)
    w.commit(files=files(spark, [(k, f"/{k}", 1, 1, None, 0) for k in range(4)]))

    def ids(*k):
        return spark.createDataFrame([(x,) for x in k], "id long")

    w.append({"files": ids(1, 2)}, files=files(spark, [(2, "/2", 7, 1, None, 0)]))
    w.append({"files": ids(2, 3)}, files=files(spark, [(3, "/3", 8, 1, None, 0), (1, "/1", 9, 1, None, 0)]))
    w.append({"files": ids()}, files=files(spark, []))
    assert {r.id: r.size for r in w.table("files").collect()} == {0: 1, 1: 9, 3: 8} and w.scattered(3) == ["files"]
    w.commit(files=w.table("files"))
    assert {r.id: r.size for r in w.table("files").collect()} == {0: 1, 1: 9, 3: 8} and w.scattered(1) == []


def test_clashing_columns(spark):
    f = files(spark, [(1, "/a", 1, 1, None, 0)])
    more = f.withColumns({c: F.lit(5) for c in ("old_size", "old_state", "top", "one", "number", "_part", "s", "action")})
    assert [r.action for r in m.decide(more, f).collect()] == ["unchanged"]
    assert state(m.upsert(f, more.withColumn("path", F.lit("/b")))) == {"/a": (1, 1, 0), "/b": (2, 1, 0)}
    assert state(m.touch(more, f)) == {"/a": (1, 1, 0)}
