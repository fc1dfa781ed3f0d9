import random
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.functions.snippet import excerpt
from tesserae.operators import batch, index
from tesserae.operators.index import Index, browse
from tesserae.plans.query import Phrase, phrases

NOW = 1_700_000_000
DAY = 86400


def make(spark, rows):
    return Index.of(spark.createDataFrame(rows, "id long, name string, body string"))


def ids(df):
    return [r.id for r in df.collect()]


def test_forms_of_one_identifier(spark):
    ix = make(spark, [(1, "a", "getTargetFile here"), (2, "b", "the get_target_file call"), (3, "c", "get-target-file"), (4, "d", "gettargetfile")])
    assert sorted(ids(ix.search("target"))) == [1, 2, 3]
    for form in ("getTargetFile", "get_target_file", "get-target-file"):
        assert sorted(ids(ix.search(form))) == [1, 2, 3]
    assert sorted(ids(ix.search("gettargetfile"))) == [1, 4]


def test_neighbours_only(spark):
    ix = make(spark, [(1, "a", "target then file"), (2, "b", "targetFile")])
    assert ids(ix.search("targetFile")) == [2]


def test_prefix_depends_on_plan(spark):
    ix = make(spark, [(1, "a", "quarterly"), (2, "b", "quart")])
    assert sorted(ids(ix.search("quart", plan="full"))) == [1, 2]
    assert ids(ix.search("quart", plan="bounded")) == [2]


def test_bounded_takes_the_newest(spark):
    ix = make(spark, [(k, f"n{k}", "same words") for k in range(1, 13)])
    assert ix.is_common("same", 1) and not ix.is_common("same", 12) and not ix.is_common("same", 0)
    hits = ids(ix.search("same", limit=3, common_df=1, budget=4))
    assert hits == [9, 10, 11]  # the four newest, equal scores by id


def test_empty_cases(spark):
    ix = make(spark, [(1, None, None), (2, "", "word"), (3, "x", "")])
    assert ids(ix.search("word")) == [2]
    assert ids(ix.search("")) == [] and ids(ix.search("word", limit=0)) == [] and ids(ix.search("---")) == []
    assert {r.id: r.len for r in ix.lengths.collect()} == {1: 0, 2: 1, 3: 1}
    none = make(spark, [])
    assert ids(none.search("word")) == [] and none.vocab().count() == 0


def test_scores_match_an_independent_engine(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(k, " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, k=rng.randint(1, 30)))) for k in range(1, 60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(name, body)")
    db.executemany("insert into t(rowid, name, body) values (?, ?, ?)", rows)
    ix = make(spark, rows)
    for text, match in (("alpha", '"alpha"'), ("alpha beta", '"alpha" "beta"'), ("gam", '"gam" *')):
        want = {i: round(-s, 6) for i, s in db.execute("select rowid, bm25(t, 10.0, 1.0) from t where t match ?", (match,))}
        got = {r.id: round(r.score, 6) for r in ix.scores(phrases(text, "*" in match)).collect()}
        assert got == want


def test_written_index(spark, tmp_path, monkeypatch):
    """All answers of the written index, scores included, are those of the scan; floors after four documents make all words common."""
    monkeypatch.setattr(index, "SPAN", 4)
    monkeypatch.setattr(index, "FIRST_FLOOR", 4)
    rng = random.Random(3)
    rows = [(k, f"doc {k}", f"common word{k % 5} targetFile" + " rare" * (k % 17 == 0) + " filler" * rng.randint(0, 9)) for k in range(1, 90)]
    ix = make(spark, rows)
    ix.write(str(tmp_path / "ix"), buckets=5, substrings=True)
    back = Index.read(spark, str(tmp_path / "ix"))
    assert back.buckets == 5 and {r.term: (r.doc, r.cnt) for r in back.vocab().collect()} == {r.term: (r.doc, r.cnt) for r in ix.vocab().collect()}

    def scored(df):
        return sorted((r.id, round(r.score, 9)) for r in df.collect())

    for text, prefix in (("word3 common", False), ("com", True), ("targetFile common", False), ("common rare", False), ("absent", False)):
        wanted = phrases(text, prefix)
        assert scored(back.scores(wanted)) == scored(ix.scores(wanted))
        for budget in (3,):
            assert scored(back.bounded(wanted, budget)) == scored(ix.scores(wanted, ix.newest(wanted, budget)))
    keep = ix.docs.filter("id % 7 = 0").select("id")
    assert scored(back.bounded(phrases("common", False), 3, keep)) == scored(ix.scores(phrases("common", False), ix.newest(phrases("common", False), 3, keep)))
    assert back._floor(["common"], 10) == 72 and back._floor(["common"], 8) == 80 and back._floor(["absent"], 1) is None and back._floor(["common"], 1000) is None
    for q in ("common", "com"):
        assert [(r.id, r.name) for r in back.search(q, 20).collect()] == [(r.id, r.name) for r in ix.search(q, 20).collect()]
    assert sorted(ids(back.contains("getFil ord3"))) == sorted(ids(ix.contains("getFil ord3"))) != []
    assert ids(back.contains("or")) == [] and back.is_common("common", 80) and not back.is_common("common absent", 1)
    empty = make(spark, [])
    empty.write(str(tmp_path / "none"))
    assert Index.read(spark, str(tmp_path / "none")).search("common").count() == 0
    assert index.bucket_of("é", 7) == spark.range(1).select(F.pmod(F.xxhash64(F.lit("é")), F.lit(7))).first()[0]


def test_batch(spark):
    rows = [(k, f"doc {k}", f"common word{k % 5} targetFile" + " filler" * (k % 7)) for k in range(50)]
    ix = make(spark, rows)
    texts = {7: "common", 8: "word3 common", 9: "targetFile", 10: "absent", 11: "", 12: "doc 3"}
    got: dict = {}
    for r in ix.search_batch(texts, 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r.id, round(r.score, 9)))
    for q, text in texts.items():
        want = [(r.id, round(r.score, 9)) for r in ix.search(text, 5, plan="bounded", budget=100).collect()] if text else []
        assert got.get(q, []) == want
    assert ix.search_batch({}).count() == 0


def test_batch_of_a_table(spark, tmp_path):
    """Many queries, equal ones among them, give the results of the few, and no row per query and document is shuffled."""
    rows = [(k, f"part {k % 9}_file.txt", f"common word{k % 5} targetFile target fileTxt" + " filler" * (k % 7)) for k in range(60)] + [(97, None, None), (98, "", ""), (99, "common", None)]
    ix = make(spark, rows)
    texts = dict(enumerate(["common", "word3 common", "targetFile", "absent", "", "part 3_file.txt", "common common", "targetfile", "target file", "file.txt common", "absent common", "part", "targetfile.file", "---", "common"], 5))
    want = sorted((r["query"], r["rank"], r.id, round(r.score, 8)) for r in ix.search_batch(texts, 5).collect())
    table = spark.createDataFrame(list(texts.items()), "query long, text string")
    got = ix.search_batch(table, 5)
    assert sorted((r["query"], r["rank"], r.id, round(r.score, 8)) for r in got.collect()) == want and len(want) > 40
    assert got.schema.simpleString() == ix.search_batch(texts, 5).schema.simpleString()
    assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 1  # of queries and their best, none of words and postings
    ix.write(str(tmp_path / "ix"))
    assert sorted((r["query"], r["rank"], r.id, round(r.score, 8)) for r in Index.read(spark, str(tmp_path / "ix")).search_batch(table, 5).collect()) == want
    assert ix.search_batch(table.limit(0)).count() == 0 and make(spark, []).search_batch(table).count() == 0
    assert ix.search_batch(table.filter("text in ('absent', '')")).count() == 0


def test_batch_in_parts(monkeypatch):
    """Candidates looked at in many parts give the same best."""
    rng, df = np.random.default_rng(5), np.array([3, 9, 5, 7])
    has = [sorted(set(rng.integers(0, 4, 3).tolist())) for _ in range(40)]
    docs = pa.RecordBatch.from_pydict({"id": pa.array(range(40), pa.int64()), "len": pa.array(rng.integers(1, 9, 40), pa.int64()), "phrases": pa.array(has, pa.list_(pa.int32())), "tf": pa.array([[1.0 + k for k in x] for x in has])})
    run = batch.best_of(batch.Asked.of({7: [0], 8: [1, 3], 9: [2, 2, 0], 10: [0]}, df), np.array([1.0, 2.0, 3.0, 4.0]), 4.0, 3, 1.2, 0.75)
    whole = [b.to_pylist() for b in run(iter([docs]))]
    monkeypatch.setattr(batch, "CANDIDATES", 2)
    assert [b.to_pylist() for b in run(iter([docs]))] == whole and {r["asked"] for r in whole[0]} == {7, 8, 9, 10}


def test_predicates(spark):
    """Kinds, sizes with their bounds, ages with their bounds, names and extensions, alone and with text."""
    kb = 1024
    rows = [
        (11, "plan.odp", "application/vnd.oasis.opendocument.presentation", 3 * kb, 0, 0), (12, "song.flac", "audio/flac", 3 * kb - 1, 1, 0),
        (13, "main.rs", "text/x-rust", 3 * kb + 1, 6, 0), (14, "Songs of May.TXT", "text/plain", 40, 7, 0), (15, "lost.flac", "audio/flac", 3 * kb, 400, 2), (16, "odd", None, 0, 8, 0),
    ]
    files = spark.createDataFrame([(i, f"/home/u/{n}", n, m, s, (NOW - d * DAY) * 10**9, st) for i, n, m, s, d, st in rows], "id long, path string, name string, mime string, size long, mtime_ns long, state int")

    def found(q):
        return ids(browse(files, q, 10, NOW))

    assert found("size:>3k") == [13] and found("size:>=3k") == [11, 13] and found("size:<3k") == [12, 14, 16] and found("size:<=3k") == [11, 12, 14, 16]
    assert found("kind:audio") == [12] and found("kind:presentation kind:code") == [11, 13] and found("kind:text") == [13, 14]
    assert found("modified:6d") == [11, 12, 13] and found("date:>7d") == [14, 16] and found("mtime:1w size:<1k") == [14]
    assert found("name:SONG") == [12, 14] and found("ext:txt") == [14] and found("ext:flac name:lost") == []
    ix = Index.of(files.select("id", "name", F.lit("chorus and verse").alias("body")), files)
    assert ids(ix.search("kind:text chorus", now=NOW)) == [13, 14] and ids(ix.search("kind:audio missing", now=NOW)) == []
    assert ids(ix.search("size:>3k verse", now=NOW, plan="bounded")) == [13]


def test_substring(spark):
    ix = make(spark, [(1, "a", "myTargetFile"), (2, "b", "nothing")])
    assert ids(ix.search("getfil", mode="substring")) == [1]
    assert ids(ix.search("ge", mode="substring")) == []


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (None, ""),
        ("plain words", "plain words"),
        ("The Target word", "The [Target] word"),
        (" ".join(f"w{k}" for k in range(30)) + " hit " + " ".join(f"v{k}" for k in range(30)), "…w25 w26 w27 w28 w29 [hit] v0 v1 v2 v3 v4 v5…"),
    ],
)
def test_excerpt(body, want):
    assert excerpt(body, [Phrase(("target",)), Phrase(("hit",))]) == want
