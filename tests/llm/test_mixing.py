import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import mixing
from tesserae.llm.mixing import bounds, mix, pivotal, pooled, shares


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 500)), min_size=1, max_size=30), st.integers(0, 9))
def test_mass_is_kept(items, seed):
    p, w = np.array([i[0] for i in items]), np.array([i[1] for i in items], float)
    q = pivotal(p, w, np.random.default_rng(seed))
    inside = (q > 0) & (q < 1)
    assert inside.sum() <= 1 and ((q >= 0) & (q <= 1)).all()
    assert abs((q * w).sum() - (p * w).sum()) < 1e-6 * max(1, (p * w).sum()) + 1e-9 * w.sum()


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1), st.lists(st.integers(1, 500), min_size=1, max_size=30), st.integers(0, 9))
def test_mass_is_kept_in_pools(p, w, seed):
    w = np.sort(np.array(w, float))[::-1]
    q = pooled(p, w, np.random.default_rng(seed))
    assert ((q > 0) & (q < 1)).sum() <= 1 and ((q >= 0) & (q <= 1)).all()
    assert abs((q * w).sum() - p * w.sum()) < 1e-6 * max(1, w.sum())


def test_expectations():
    p, w = np.array([0.2, 0.5, 0.7, 0.6]), np.array([3.0, 1.0, 2.0, 5.0])
    mean = np.mean([pivotal(p, w, np.random.default_rng(s)) for s in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def tables(spark, n=400):
    docs = [(i, " word" * (1 + i * 7 % 40), ("big", "small", "tiny")[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(n)]
    docs += [(n, None, "big"), (n + 1, "", "big"), (n + 2, "x", None), (n + 3, "x", "unlisted"), (5, "again again", "big")]
    t = [("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.2, 4), ("gone", 0.4, 2), (None, 0.1, 1), ("big", 0.1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(t, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark, monkeypatch):
    docs, targets = tables(spark)
    for block in (20_000, 7):  # with blocks of seven documents the reduction tree has two levels
        monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
        monkeypatch.setattr(mixing, "FAN_IN", 4)
        m = mix(docs, targets)
        rows = m.collect()
        assert len(rows) == 403 and all(r.source in ("big", "small", "tiny") for r in rows)
        got = {r.source: r for r in shares(m, targets).collect()}
        assert abs(got["big"].share - 0.5) < 0.02 and abs(got["small"].share - 0.3) < 0.02 and abs(got["tiny"].share - 0.2) < 0.02
        assert got["gone"].share == 0 and got["gone"].tokens == 0
        cap = {"big": 1, "small": 2, "tiny": 4}
        assert all(0 <= r.copies <= cap[r.source] for r in rows) and all(r.copies == 0 for r in rows if not r.tokens)
        assert {(r.doc_id, r.copies) for r in mix(docs, targets).collect()} == {(r.doc_id, r.copies) for r in rows}


def test_every_document_keeps_its_expectation(spark):
    """A giant is rounded like the others: over many seeds it is taken as often as they are, and the small ones make up."""
    docs = [(i, " a" * 20, "s") for i in range(100)] + [(999, " a" * 1000, "s")] + [(1000 + i, " a" * 20, "t") for i in range(75)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 0.5, 1), ("t", 0.5, 1)], "source string, target_share double, max_repeats int")
    taken = []
    for seed in range(8):
        m = mix(df, targets, seed=seed)
        taken.append(m.filter("doc_id = 999").first().copies)
        assert abs({r.source: r.share for r in shares(m, targets).collect()}["s"] - 0.5) < 0.01
    assert 0 < sum(taken) < 8  # its rate is one half
    for w in ([900.0] + [10.0] * 39, [90.0, 30.0] + [10.0] * 38):
        mean = np.mean([pooled(0.4, np.array(w), np.random.default_rng(s)) for s in range(4000)], axis=0)
        assert np.abs(mean - 0.4).max() < 0.05


def test_bounds(spark):
    docs, targets = tables(spark)
    got = {r.source: (r.capped, r.rounded, r.on_goal) for r in bounds(mix(docs, targets), targets).collect()}
    assert got == dict.fromkeys(("big", "small", "tiny"), (True, True, True))


def test_empty(spark):
    docs, targets = tables(spark, 20)
    assert mix(docs.limit(0), targets).count() == 0
    assert mix(docs, targets.limit(0)).count() == 0
    assert {r.share for r in shares(mix(docs.limit(0), targets), targets).collect()} == {0.0}
