import datetime as dt
import os
import time

import pytest

from tesserae.plans import service
from tesserae.plans.service import SCHEMA, ContentService, Paused
from tesserae.sources.files import ContentConfig

T0 = dt.datetime(2025, 1, 1)


def names(df):
    return sorted(r.name for r in df.collect())


def test_life_of_an_index(spark, tmp_path, monkeypatch):
    root = tmp_path / "home"
    for p, t in {"a.txt": "alpha archive", "sub/b.html": "<p>beta archive</p>", "sub/c.bin": "x\x00y", "skip/d.txt": "alpha", "sub2/e.txt": "alpha"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    s = ContentService(spark, f"file://{tmp_path}/store", ContentConfig(roots=[str(root)], excludes=["skip"]), buckets=3)
    assert names(s.search("archive")) == []
    s.reindex()
    assert names(s.search("archive")) == ["a.txt", "b.html"] and names(s.search("alp")) == ["a.txt", "e.txt"]
    assert names(s.search("bin")) == ["c.bin"]  # unsupported, found by name
    assert s.status()["total"] == 4 and s.search("al").count() == 0
    ids = {r.path: r.id for r in s._files().collect()}

    (root / "a.txt").write_text("gamma entirely new")
    os.remove(root / "sub" / "b.html")
    (root / "f.txt").write_text("alpha again")
    s.pause()
    s.reconcile()
    assert names(s.search("archive")) == ["a.txt", "b.html"]
    s.resume()
    s.reconcile()
    assert names(s.search("archive")) == [] and names(s.search("gamma")) == ["a.txt"] and names(s.search("alpha")) == ["e.txt", "f.txt"]
    after = {r.path: r.id for r in s._files().collect()}
    assert after[str(root / "a.txt")] == ids[str(root / "a.txt")]

    (root / "g.txt").write_text("delta text")
    os.rename(root / "sub2", tmp_path / "away")
    events = [(1, "index", str(root / "g.txt"), False, None, T0, T0), (2, "moved_from", str(root / "sub2"), True, 5, T0, T0), (3, "index", str(root / "skip/d.txt"), False, None, T0, T0), (4, "index", str(root / "none.txt"), False, None, T0, T0)]
    s.apply(spark.createDataFrame(events, SCHEMA))
    assert names(s.search("delta")) == ["g.txt"] and names(s.search("alpha")) == ["f.txt"]
    assert names(s.find("g.t")) == ["g.txt"] and s.find("g").count() == 0
    s.exclude(str(root / "f.txt"))
    assert names(s.search("alpha")) == [] and s.status()["tombstones"] == 3 and len(s.store.manifest.segments["postings"]) > 3
    before = [(r.name, round(r.score, 9)) for r in s.search("delta").collect()]
    monkeypatch.setattr(service, "MERGE_AFTER", 2)
    s.maintain()
    assert s.status()["tombstones"] == 0 and len(s.store.manifest.segments["postings"]) == 1
    assert [(r.name, round(r.score, 9)) for r in s.search("delta").collect()] == before
    assert s.store.manifest.stats["documents"] == s.store.table("lengths").count() == s.store.table("docs").count()
    got = s.status()
    assert got["indexed"] >= 1 and got["removed"] == 3 and got["reconciled"] == 2 and got["batches"] == 1 and got["errors"] == 0


def test_paused_batches_come_again(spark, tmp_path):
    """A stream ends at a batch that comes while paused, and delivers it after a restart."""
    from tesserae.streaming import changes

    root = tmp_path / "home"
    root.mkdir()
    (root / "a.txt").write_text("alpha")
    s = ContentService(spark, f"file://{tmp_path}/store", ContentConfig(roots=[str(root)]), buckets=3)
    rows = spark.createDataFrame([(1, "index", str(root / "a.txt"), False, None, T0, T0)], SCHEMA)
    s.pause()
    with pytest.raises(Paused):
        s.apply(rows)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        changes.start(spark, str(tmp_path / "in"), str(tmp_path / "cp"), s.apply).awaitTermination()

    with pytest.raises(Exception, match="paused"):
        run()
    s.resume()
    run()
    assert names(s.search("alpha")) == ["a.txt"]


def test_reconciliations_fall_due(spark, tmp_path):
    root = tmp_path / "home"
    root.mkdir()
    s = ContentService(spark, f"file://{tmp_path}/store", ContentConfig(roots=[str(root)]), buckets=3)
    assert [t for t in range(0, 2000, 100) if s.tick(1000.0 + t)] == [0, 900, 1800]
    (root / "late.txt").write_text("no event tells of this")
    s.apply(spark.createDataFrame([(1, "watch_limit", None, False, None, T0, T0)], SCHEMA))
    assert s.degraded and s.reconcile_interval() == 180 and not s.tick(2950.0) and names(s.search("event")) == []
    assert s.tick(3000.0) and names(s.search("event")) == ["late.txt"]


def test_watch(spark, tmp_path):
    """Changes and the clock side by side, until told to stop."""
    root = tmp_path / "home"
    root.mkdir()
    (root / "a.txt").write_text("alpha")
    s = ContentService(spark, f"file://{tmp_path}/store", ContentConfig(roots=[str(root)]), buckets=3)
    spark.createDataFrame([(1, "index", str(root / "b.txt"), False, None, T0, T0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    (root / "b.txt").write_text("beta")
    began = time.time()
    s.watch(str(tmp_path / "in"), str(tmp_path / "cp"), lambda: s.counters["batches"] > 0 and s.counters["reconciled"] > 0 or time.time() - began > 60, 0.2)
    assert names(s.search("alpha")) == ["a.txt"] and names(s.search("beta")) == ["b.txt"]


def test_renamed_folder(spark, tmp_path):
    root = tmp_path / "home"
    (root / "old/deep").mkdir(parents=True)
    (root / "old/a.txt").write_text("alpha one")
    (root / "old/deep/b.txt").write_text("alpha two")
    s = ContentService(spark, f"file://{tmp_path}/store", ContentConfig(roots=[str(root)]), buckets=3)
    s.reindex()
    os.rename(root / "old", root / "new")
    s.apply(spark.createDataFrame([(1, "moved_from", str(root / "old"), True, 5, T0, T0), (2, "moved_to", str(root / "new"), True, 5, T0, T0)], SCHEMA))
    assert sorted(r.path for r in s.search("alpha").collect()) == [str(root / "new/a.txt"), str(root / "new/deep/b.txt")]


def test_crawl_stops_at_the_cap(spark, tmp_path, monkeypatch):
    root = tmp_path / "home"
    root.mkdir()
    for k in range(9):
        (root / f"{k}.txt").write_text(f"alpha {k} " * 50)
    s = ContentService(spark, f"file://{tmp_path}/store", ContentConfig(roots=[str(root)], max_index_mb=1), buckets=3)
    rounds = []
    update, size = s._update, {"now": (1 << 20) - 1500}
    monkeypatch.setattr(s, "_update", lambda *a: (rounds.append(1), size.update(now=size["now"] + 1000), update(*a)))
    monkeypatch.setattr(s.store, "bytes", lambda: size["now"])
    s.reconcile()
    assert len(rounds) == 2 and 0 < s.status()["total"] < 9
