import random

import pytest

from tesserae.llm.bpe import encoder
from tesserae.llm.splitting import split, split_report, split_text


def texts():
    rng = random.Random(3)
    words = ["the", "archive", "folder", "don't", "2024-01-02", "camelCaseName99", "été", "файлы", "写真", "😀", "a_b_c", " ", "\t"]
    out = []
    for _ in range(25):
        out.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ", ", "\n", "\n\n", " \n \n", "   ", ""]) for _ in range(rng.randint(50, 900))))
    return [*out, "a" * 3000, "的" * 2000, "".join(rng.choices("abcdefghij0123456789", k=6000)), " " * 4000, "\n" * 900 + "x" * 900, "😀" * 700, ("word " * 300 + "\n\n") * 3, "''s" * 900]


@pytest.mark.parametrize(("most", "overlap"), [(128, 16), (40, 20), (64, 0), (8, 2)])
def test_pieces(most, overlap):
    e = encoder()
    for t in texts():
        w = e.split(t)
        ids = e.encode_words(w)
        if sum(map(len, ids)) <= most:
            continue
        pieces = split_text(t, w, ids, most, overlap, e, {})
        end = 0
        for k, (a, b, n, over, _) in enumerate(pieces):
            assert n == e.count([t[a:b]])[0] <= most
            assert a <= end < b and over <= overlap
            if k and not overlap:
                assert a == end
            end = b
        assert end == len(t) and pieces[0][0] == 0


def test_natural_places():
    e = encoder()
    t = ("One sentence here. " * 6 + "\n\n") * 8
    w = e.split(t)
    pieces = split_text(t, w, e.encode_words(w), 60, 0, e, {})
    assert all(t[b - 2 : b] == "\n\n" or b == len(t) for _, b, *_ in pieces)


def test_table(spark):
    docs = spark.createDataFrame([(1, "word " * 500, 9), (2, None, 9), (3, "", 9), (4, "short", 9), (1, "word " * 500, 9)], "doc_id long, text string, piece int")
    limits = spark.createDataFrame([("s", 100, 10), ("off", None, 1), ("zero", 0, 0), ("n", 50, None)], "limit_name string, max_tokens int, overlap_tokens int")
    got = split(docs, limits).collect()
    assert {r.doc_id for r in got} == {1} and {r.limit_name for r in got} == {"s", "n"}
    assert all(r.text == ("word " * 500)[r.start_char : r.end_char] for r in got)
    report = {r.limit_name: r for r in split_report(split(docs, limits)).collect()}
    assert report["s"].documents == 2 and report["s"].largest <= 100
    kept = split(docs, limits, keep_small=True).collect()
    assert {r.doc_id for r in kept} == {1, 4}
    assert split(docs.limit(0), limits).count() == 0 and split(docs, limits.limit(0)).count() == 0
