import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions.arrays import terms_of
from tesserae.llm.nearcopies import near_copies, near_copy_groups, near_copy_pairs


def runs(text, width=3):
    t = terms_of(text)
    return frozenset(zip(*(t[k:] for k in range(width)))) if len(t) >= 20 else None


def brute(rows):
    sets = [(i, s) for i, x in rows if (s := runs(x))]
    return {(min(a, b), max(a, b)) for k, (a, s) in enumerate(sets) for b, u in sets[k + 1 :] if 2 * len(s & u) >= len(s | u)}


def corpus(seed, n=120):
    """Copies with edits, insertions and reordering of a few dozen texts, over a small vocabulary with common runs."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.7:
            t = list(rng.choice(base))
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(t))
                kind = rng.random()
                if kind < 0.4:
                    t[at] = rng.choice(words)
                elif kind < 0.7:
                    t.insert(at, rng.choice(words))
                elif kind < 0.9:
                    del t[at]
                else:
                    t = t[at:] + t[:at]
        else:
            t = ["the", "same", "opening", "words", "again"] + rng.choices(words, k=rng.randint(5, 80))
        base.append(t)
        rows.append((i * 3 + 1, " ".join(t)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 3), (3, 7)])
def test_against_all_pairs(spark, seed, block):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "id long, body_z string")
    got = near_copy_pairs(df, block=block).collect()
    pairs = {(r.id_a, r.id_b) for r in got}
    assert pairs == brute(rows) and len(got) == len(pairs)


def test_defined_cases(spark):
    long = " ".join(f"t{k}" for k in range(25))
    rows = [(1, None, "x"), (2, "", "x"), (3, "short text", "x"), (4, long, "x"), (5, long.upper(), "x"), (6, long.replace(" ", " - "), "x"), (7, long + " more words", None)]
    df = spark.createDataFrame(rows, "id long, body_z string, n string").withColumn("rep", F.lit(1)).withColumn("items", F.lit("clash"))
    assert {(r.id_a, r.id_b) for r in near_copy_pairs(df).collect()} == {(4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)}
    members, links = near_copies(df)
    assert {r.id: r.rep for r in members.collect()} == {4: 4, 5: 4, 6: 4, 7: 7}
    assert [(r.id_a, r.id_b, r.n_a, r.n_b, r.common) for r in links.collect()] == [(4, 7, 23, 25, 23)]
    groups = {r.id: (r.group_id, r.links) for r in near_copy_groups(df).collect()}
    assert groups == {4: (4, 1), 5: (4, 1), 6: (4, 1), 7: (4, 1)}
    assert near_copy_pairs(df.limit(0)).count() == 0
    twice = near_copy_pairs(df.unionByName(df)).collect()
    assert len(twice) == 6 and {(r.id_a, r.id_b) for r in twice} == {(4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)}


def test_very_long_texts(spark):
    rng = random.Random(1)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:45_000])), (3, " ".join(long[:20_000])), (4, " ".join(reversed(long)))]
    df = spark.createDataFrame(rows, "id long, body_z string")
    assert {(r.id_a, r.id_b) for r in near_copy_pairs(df).collect()} == brute(rows) == {(1, 2)}


def test_groups_are_components(spark):
    rows = corpus(5, 60)
    groups = {r.id: r.group_id for r in near_copy_groups(spark.createDataFrame(rows, "id long, body_z string")).collect()}
    parent = {i: i for i, x in rows if runs(x)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows):
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert groups == {i: find(i) for i in parent}


def test_third_of_all_rows_alike(spark):
    """A hot family: its runs are in every third document, its lists are cut into blocks."""
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(40)]
    rows = [(i, " ".join(shared + [f"own{i}"] if i % 3 == 0 else rng.choices([f"v{k}" for k in range(500)], k=40))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, body_z string")
    assert {(r.id_a, r.id_b) for r in near_copy_pairs(df, block=8).collect()} == brute(rows)
