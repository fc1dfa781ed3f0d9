import datetime as dt

from tesserae.streaming import changes as c

T0 = dt.datetime(2025, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, op, p, d, k, T0 + dt.timedelta(seconds=s), T0 + dt.timedelta(seconds=s + 1)) for i, op, p, d, k, s in rows], c.SCHEMA)


ROWS = [
    (1, "index", "/d/a", False, None, 0), (1, "index", "/d/a", False, None, 0), (2, "remove", "/d/a", False, None, 5),
    (3, "moved_from", "/d/b", False, 7, 1), (4, "moved_to", "/d/c", False, 7, 2), (5, "moved_from", "/d/e", True, 8, 3),
    (6, "overflow", None, None, None, 4), (7, "moved_to", "/new", True, 9, 4), (8, "bogus", "/q", False, None, 1), (9, "index", None, False, None, 1),
]


def test_actions(spark):
    got = sorted((r.change_id, r.action) for r in c.actions(events(spark, ROWS)).collect())
    assert got == [(1, "index"), (2, "remove"), (3, "remove"), (4, "index"), (5, "remove_tree"), (6, "reconcile"), (7, "scan")]
    assert {r.path: r.action for r in c.last_actions(events(spark, ROWS)).collect()}["/d/a"] == "remove"
    assert c.actions(events(spark, [])).count() == 0


def test_moves(spark):
    got = {r.cookie: (r.old_path, r.new_path, r.is_dir) for r in c.moves(events(spark, ROWS)).collect()}
    assert got == {7: ("/d/b", "/d/c", False), 8: ("/d/e", None, True), 9: (None, "/new", True)}


def test_apply(spark):
    files = spark.createDataFrame([(1, "/d/a", 0), (2, "/d/c", 0), (3, "/d/e/x", 0), (4, "/d/e2", 0), (5, "/d/e/back", 0)], "id long, path string, state int")
    rows = [*ROWS, (20, "index", "/d/e/back", False, None, 50)]
    assert {r.id: r.state for r in c.apply_batch(files, events(spark, rows)).collect()} == {1: 2, 2: 1, 3: 2, 4: 0, 5: 1}


def test_folder_removed_and_made_again(spark):
    files = spark.createDataFrame([(1, "/d/x", 0), (2, "/d/y", 0), (3, "/e/z", 0)], "id long, path string, state int")
    rows = [(1, "remove_tree", "/d", True, None, 1), (2, "index", "/d", True, None, 5), (3, "index", "/d/y", False, None, 6)]
    assert {r.id: r.state for r in c.apply_batch(files, events(spark, rows)).collect()} == {1: 2, 2: 1, 3: 0}
    assert [r.path for r in c.scanned(files, events(spark, rows[1:])).orderBy("path").collect()] == ["/d/x", "/d/y"]


def test_folders_of_all_files_are_no_broadcast(spark, tmp_path):
    """A small file of long paths: its estimate is below the threshold, the exploded folders are not."""
    spark.createDataFrame([(k, f"/a/b/c/d/e/f/{k}", 0) for k in range(50)], "id long, path string, state int").write.parquet(str(tmp_path / "files"))
    events(spark, [(1, "remove_tree", "/a/b", True, None, 1), (2, "index", "/a/b/c/d/e/f/7", False, None, 2)]).write.parquet(str(tmp_path / "changes"))
    out = c.apply_batch(spark.read.parquet(str(tmp_path / "files")), spark.read.parquet(str(tmp_path / "changes")))
    assert {r.id: r.state for r in out.collect()} == {k: 1 if k == 7 else 2 for k in range(50)}
    joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join [tree#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)


def test_stream(spark, tmp_path):
    for k in range(0, len(ROWS), 4):
        events(spark, ROWS[k : k + 4]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, calls = [], []
    q = c.start(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.append((n, df.count())), files_per_batch=1, housekeeping=lambda: calls.append("house"), every=2, reconcile=lambda: calls.append("reconcile"))
    q.awaitTermination()
    assert sum(n for _, n in seen) == len(ROWS) and len(seen) == 3
    assert sorted(calls) == ["house", "reconcile"]


def test_moves_across_batches(spark, tmp_path):
    events(spark, [(1, "moved_from", "/a", False, 1, 0), (2, "moved_from", "/lost", False, 2, 0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events(spark, [(3, "moved_to", "/b", False, 1, 30)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = c.pair_moves_stream(stream).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from moves where new_path is not null and old_path is not null").collect()] == [(1, "/a", "/b")]
