from tesserae.operators import fusion as f

S = "kind string, name string, path string, score double, seq int"


def test_order(spark):
    rows = [("application", "app", "", 900.0, 1), ("file", "best", "", 950.0, 1), ("file", "same", "", 950.0, 2), ("content", "c1", "", 5000.0, 1), ("content", "c0", "", 1.0, 2), ("calculator", "= 2", "", 10.0, 1)]
    lines = f.fuse(spark.createDataFrame(rows, S)).orderBy("position").collect()
    assert [r.name for r in lines] == ["best", "= 2", "app", "same", "c1", "c0"]
    assert [r.section for r in lines] == ["TOP HIT", "APPLICATIONS", "APPLICATIONS", "FILES & FOLDERS", "CONTENTS", "CONTENTS"]
    runs = f.section_runs(f.fuse(spark.createDataFrame(rows, S))).orderBy("run").collect()
    assert [(r.section, r["items"]) for r in runs] == [("TOP HIT", 1), ("APPLICATIONS", 2), ("FILES & FOLDERS", 1), ("CONTENTS", 2)]


def test_content_alone(spark):
    lines = f.fuse(spark.createDataFrame([("content", "b", "", 1.0, 1), ("content", "a", "", 9.0, 2)], S)).orderBy("position").collect()
    assert [(r.name, r.section) for r in lines] == [("b", "TOP HIT"), ("a", "CONTENTS")]
    assert f.fuse(spark.createDataFrame([], S)).count() == 0
    odd = [("file", "a", None, None, 1), ("file", "b", "", 3.0, 2), (None, "c", "", 1.0, 1), ("content", None, "", 9.0, 1)]
    lines = f.fuse(spark.createDataFrame(odd, S)).orderBy("position").collect()
    assert [(r.name, r.section) for r in lines] == [("b", "TOP HIT"), ("a", "FILES & FOLDERS"), ("c", None), (None, "CONTENTS")]


def test_groups(spark):
    w = [(1, "a", False, True, 1, 10), (2, "a", False, False, 2, 20), (3, "b", True, False, 3, 15), (4, "c", False, True, 4, 30)]
    g = f.groups(spark.createDataFrame(w, "handle long, app string, active boolean, minimized boolean, seq int, used long"))
    got = {r.app: (r["rank"], r.windows, r.any_active, r.all_minimized, r.primary) for r in g.collect()}
    assert got == {"c": (1, 1, False, True, 4), "a": (2, 2, False, False, 2), "b": (3, 1, True, False, 3)}
    c = {r.app: (r.next_app, r.previous_app, r.preselected) for r in f.cycle(g.select("rank", "app")).collect()}
    assert c == {"c": ("a", "b", False), "a": ("b", "c", True), "b": ("c", "a", False)}


def test_caps(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("x", 2.0, 2), ("x", 2.0, 3), ("y", 0.0, 1)], "g string, score double, seq int")
    assert sorted((r.g, r.seq) for r in f.best_per_group(df, "g", 2).collect()) == [("x", 2), ("x", 3), ("y", 1)]


def test_stamps_are_carried_over(spark):
    w = spark.createDataFrame([(1, "a", False, False, 1), (2, "b", False, False, 2), (3, "c", True, False, 3), (4, "a", None, True, 4), (5, None, False, False, 5)], "handle long, app string, active boolean, minimized boolean, seq long")
    before = spark.createDataFrame([("a", 7), ("gone", 9), ("c", 3)], "app string, used long")
    got = [(r.app, r.used, r["rank"]) for r in f.carried(w, before, 10).orderBy("rank").collect()]
    assert got == [("c", 13, 1), (None, 12, 2), ("b", 11, 3), ("a", 7, 4)]
    assert [r.used for r in f.carried(w.filter("not active"), before.limit(0), 0).orderBy("rank").collect()] == [3, 2, 1]
