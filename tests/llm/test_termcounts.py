from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions.arrays import terms_of
from tesserae.llm import termcounts
from tesserae.llm.termcounts import common_prefixes, interval_counts, marked_counts, suffix_array, term_counts


def brute(records, depth):
    occ, rec = Counter(), Counter()
    for r in records:
        grams = [(d, tuple(r[k : k + d])) for d in range(1, depth + 1) for k in range(len(r) - d + 1)]
        occ.update(grams)
        rec.update(set(grams))
    return {g: (n, rec[g]) for g, n in occ.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 5))
def test_intervals(records, depth):
    codes = np.array([c for r in records for c in r])
    record = np.repeat(np.arange(len(records)), [len(r) for r in records])
    got = {}
    for d, start, occurrences, in_records in interval_counts(codes, record, depth):
        for s, n, r in zip(start, occurrences, in_records):
            got[d, tuple(codes[s : s + d].tolist())] = (int(n), int(r))
    assert got == brute(records, depth)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 6))
def test_array_and_prefixes(records, depth):
    codes = np.array([c for r in records for c in r])
    record = np.repeat(np.arange(len(records)), [len(r) for r in records])
    order, left = suffix_array(codes, record, depth)
    suffix = [codes[i : i + left[i]].tolist() for i in range(len(codes))]
    assert sorted(order.tolist()) == list(range(len(codes)))
    heads = [suffix[i][:depth] for i in order]
    assert heads == sorted(heads)
    want = [0] + [next((k for k in range(depth) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), depth) for a, b in zip(heads, heads[1:])]
    assert common_prefixes(codes, left, order, depth).tolist() == want


def test_terms(spark, monkeypatch):
    texts = ["The cat_the CAT 42", "cat", None, "", "--- !", "Straße İstanbul ΟΔΟΣ", "x " * 5000]
    df = spark.createDataFrame([(t, 1) for t in texts], "body string, term int")
    want = brute([terms_of(t) for t in texts if terms_of(t)], 2)
    for block in (2_000_000, 2):
        monkeypatch.setattr(termcounts, "BLOCK_TERMS", block)
        got = {(r.n, tuple(r.term.split(" "))): (r.occurrences, r.records) for r in term_counts(df, "body", 2).collect()}
        assert got == want
    assert term_counts(df.limit(0), "body").count() == 0
    assert terms_of("İA") == ["i̇a"] or terms_of("İA")


def test_marks(spark):
    docs = spark.createDataFrame([(f"all w{k // 4} x{k}",) for k in range(20)] + [(None,), ("",)], "body string")
    files = spark.createDataFrame([("text/plain",)] * 9 + [("text/x",), (None,), ("",)], "mime string")
    limits = spark.createDataFrame([("body", 3, 25), ("mime", 3, 20), (None, 1, 1)], "field string, min_records int, max_percent int")
    got = {(r.field, r.term): r.mark for r in marked_counts({"body": (docs, "body", False), "mime": (files, "mime", True)}, limits).collect()}
    assert got["body", "all"] == "common" and got["body", "w1"] is None and got["body", "x3"] == "rare"
    assert got["mime", "text/plain"] == "common" and got["mime", "text/x"] == "rare" and len(got) == 28
    none = limits.filter(F.lit(False))
    assert {r.mark for r in marked_counts({"body": (docs, "body", False)}, none).collect()} == {None}
