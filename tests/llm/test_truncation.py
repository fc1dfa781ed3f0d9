import random

import pytest

from tesserae.llm import truncation
from tesserae.llm.truncation import ending, measures, source_shares, truncated

CUT = [
    "A whole sentence. Another one that sto", "Text with a broken character �", "First. Then it goes on ", "- alpha beta Name\n- gamma delta Other\n- pa",
    "a,b,c,d\nx y,Name,2,2020-01-02\nz w,Na", "a,b,c,d\nx,N,2,2020-01-02\nz,N,4,2020-0", 'k=1\nname = "a"\nother = "un', "k=1\nname=b\nother=c\nlast=", "k=1\nm=2\nn=3\nhalf_",
    "One.\nTwo.\nAnd the long third line never", "Done.\n\nSee the list:",
]
WHOLE = [
    "A sentence.", "Ends with a line\n", "- alpha beta\n- gamma delta\n", "Really?", "x,N,2,2020-01-02\nz,N,4,2020-01-05", 'k=1\nname = "a"\nother = "b"', "int f() {\n\treturn 1;\n}", "He said “yes.”",
]


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert ending(text)[0] == "cut"


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert ending(text)[0] == "whole"


def test_measures(spark):
    t = 'a<b>&"c"\né😀\\'
    df = spark.createDataFrame([(t,)], "t string")
    from pyspark.sql import functions as F

    got = df.select(*[c.alias(k) for k, c in measures(F.col("t")).items()]).first().asDict()
    import html
    import json

    e = t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    want = {
        "chars": len(t), "bytes": len(t.encode()), "utf16": len(t.encode("utf-16-le")) // 2, "crlf_chars": len(t) + 1, "crlf_bytes": len(t.encode()) + 1,
        "entity_chars": len(e), "entity_bytes": len(e.encode()), "entity_quote_chars": len(html.escape(t, quote=True)), "entity_quote_bytes": len(html.escape(t, quote=True).encode()),
        "json_chars": len(json.dumps(t, ensure_ascii=False)) - 2, "json_bytes": len(json.dumps(t, ensure_ascii=False).encode()) - 2, "json_ascii": len(json.dumps(t)) - 2,
    }
    assert got == want


def test_hidden_limit(spark):
    """Texts of one source are cut at 300 characters, of another at 400 bytes with CR LF; both numbers are undeclared."""
    rng = random.Random(4)
    words = [w + s for w in ("archive", "folder", "letter", "prefix", "window", "counter", "segment") for s in ("", "s", "ed", "ing")]
    rows, true = [], set()
    for i in range(600):
        source = ("a", "b", None)[i % 3]
        t = "".join(" ".join(rng.choices(words, k=9)).capitalize() + (".\n" if rng.random() < 0.4 else ". ") for _ in range(rng.randint(1, 8))).strip()
        cut = {"a": t[:300], "b": t.replace("\n", "\r\n")[:400].replace("\r\n", "\n").replace("\r", "")}.get(source, t)
        if cut != t and not cut.endswith((".", "\n")):
            true.add(i)
        rows.append(("x", i, source, cut))
    rows += [("x", 900, "a", None), ("x", 901, "a", "")]
    df = spark.createDataFrame(rows, "origin string, rec_id long, source string, text string")
    none = spark.createDataFrame([], "source string, value long")
    found = truncated(df, none)
    got = found.collect()
    assert len(got) == 600 and {r.rec_id for r in got if r.truncated} == true
    assert sum(r.at_limit for r in got) > 0.5 * len(true)
    shares = {r.source: r for r in source_shares(found).collect()}
    assert shares[None].truncated == 0 and shares["a"].texts == 200
    assert truncated(df.limit(0), none).count() == 0


def test_closings_cut_short_stay_cases(spark):
    rows = [("extract_results", i, "a", f"Note number {i} is kept in the archive.\nViele Grüße") for i in range(300)]
    rows += [("extract_results", 1000 + i, "a", f"Letter number {i} is kept in the archive.\nViele") for i in range(8)]
    rows += [("extract_results", 2000 + i, "a", f"Memo number {i} is kept in the archive.\nDanke") for i in range(40)]
    rows += [("extract_results", 3000 + i, "a", f"Copy number {i} is kept in the archive.\nDanke schön") for i in range(40)]
    declared = spark.createDataFrame([("a", 10_000)], "source string, value long")
    texts = spark.createDataFrame(rows, "origin string, rec_id long, source string, text string")
    assert sorted(r.rec_id for r in truncated(texts, declared).filter("truncated").collect()) == list(range(1000, 1008))
    # one cut text extracted many times is no closing formula
    again = spark.createDataFrame([rows[0], *[("extract_results", 1000 + i, "a", rows[300][3]) for i in range(8)]], texts.schema)
    more = again.unionByName(texts.filter("rec_id < 10 or rec_id > 1999"))
    assert sorted({r.rec_id for r in truncated(more, declared).filter("truncated").collect()}) == list(range(1000, 1008))


def test_limits_decide_where_endings_say_nothing(spark, monkeypatch):
    """Lists cut between two words at 300 characters, a number that is declared nowhere: only the limit tells."""
    rng = random.Random(8)

    def word(n):
        return "".join(rng.choice("aeiou" if k % 2 else "bdfglmnprst") for k in range(n - 1)) + "k"  # none begins another

    words = {n: [word(n) for _ in range(40)] for n in range(3, 10)}
    rows, true = [], set()
    for i in range(900):
        t = ""
        while len(t) < (286 if i % 2 else rng.randint(30, 4000)):
            line = "- " + " ".join(rng.choice(words[rng.randint(3, 9)]) for _ in range(rng.randint(2, 4)))
            t += ("\n" if t else "") + line
        if i % 2 and 289 < len(t) < 297:  # would go on
            t += " " + rng.choice(words[299 - len(t)])
            true.add(i)
        if i in true or not i % 2 and not 295 < len(t) < 304:
            rows.append(("x", i, "a", t))
    assert len(true) > 50
    df = spark.createDataFrame(rows, "origin string, rec_id long, source string, text string")
    none = spark.createDataFrame([], "source string, value long")
    assert all(ending(r[3])[0] == "open" for r in rows)
    got = truncated(df, none).filter("truncated").collect()
    assert not [r for r in got if r.rec_id not in true] and len(got) == len(true) and {(r.evidence, r.measure, r.value) for r in got} == {("limit", "bytes", 300)}
    shares = source_shares(truncated(df, none)).first()
    assert shares.by_limit == len(true) and shares.by_ending == 0
    monkeypatch.setattr(truncation, "storage_limits", lambda *a: spark.createDataFrame([], "source string, measure string, value int, n long, declared boolean"))
    assert truncated(df, none).filter("truncated").count() == 0


def test_unspaced_text_costs_its_length(spark):
    """Beginnings of long runs without blanks: one row for each length that last words have, not one for each sign."""
    import pyarrow as pa

    long = "".join(chr(0x4E00 + k % 5000) for k in range(40_000))
    parts = pa.RecordBatch.from_pydict({"part": [long, "wordy", "wo"], "n": pa.array([2, 3, 4], pa.int64())})
    out = list(truncation._beginnings([2, 3, 10_000])([parts]))[0].to_pydict()
    assert out["n"] == [2, 2, 2, 3, 3]
    from pyspark.sql import functions as F

    same = spark.createDataFrame([(long[:2],), (long[:3],), (long[:10_000],), ("wo",), ("wor",)], "t string").select(F.xxhash64("t").alias("h")).collect()
    assert [r.h for r in same] == out["h"]
    rows = [("x", k, "a", long[k : k + 20_000 + k]) for k in range(8)]
    df = spark.createDataFrame(rows, "origin string, rec_id long, source string, text string")
    assert truncated(df, spark.createDataFrame([], "source string, value long")).count() == 8
