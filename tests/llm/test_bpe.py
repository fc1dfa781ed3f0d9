import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.bpe import TOKENIZER_DIR, RankBitmap, encoder
from tesserae.llm.encode import token_ids

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


PARTS = ["a", "aa", "b", " ", "  ", "\n", "\n\n", "é", "é", "😀", "ab", "'s", "'ll", "ß", "1", "²", "\x1c", "‍", "　", "\xa0", "ﬁ", "\x85", "<|endoftext|>", "的", "hello", "World", "_", "--", "\t"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_same_ids(reference, parts):
    text = "".join(parts)
    assert encoder().ids([text])[0] == reference.encode(text, add_special_tokens=False).ids


def test_very_long_words(reference):
    rng = random.Random(1)
    texts = ["a" * 100_000, "ab" * 60_000, "的" * 30_000, "".join(rng.choices("abcdefgh", k=150_000)), "=" * 50_000, " " * 20_000]
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert encoder().ids(texts) == want


def test_both_ways_of_merging_agree(monkeypatch):
    from tesserae.llm import bpe

    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 60))) for _ in range(200)] + ["a" * 999, "ab" * 500, "的" * 300]
    got = []
    for many in (0, 1 << 60):
        monkeypatch.setattr(bpe, "MANY", many)
        got.append(bpe.BytePairEncoder().ids(texts))
    assert got[0] == got[1]


def test_bitmap():
    rng = random.Random(2)
    q, model = RankBitmap(), set()
    for _ in range(3000):
        if rng.random() < 0.6:
            r = rng.randrange(64**3)
            q.add(r)
            model.add(r)
        else:
            assert q.pop() == (min(model) if model else -1)
            model -= {min(model)} if model else set()


def test_tokens_encode_to_themselves():
    with open(f"{TOKENIZER_DIR}/byte_bpe_50k.json", encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    e = encoder()
    words = {i: e.id_bytes[i].decode() for i in list(vocab.values())[256:5000] if e.id_bytes[i].isascii()}
    got = dict(zip(words, e.encode_words(list(words.values()))))
    assert all(got[i] == (i,) for i in words)


def test_known_words_are_bounded():
    from tesserae.llm.bpe import BytePairEncoder

    e = BytePairEncoder(max_known=50)
    texts = [f"word{k} other{k}" for k in range(200)]
    assert [e.ids([t])[0] for t in texts] == encoder().ids(texts)
    assert len(e.known) <= 50


def test_column(spark):
    rows = [(1, "Hello world", "x"), (2, None, None), (3, "", "y"), (3, "twice", "z"), (None, "no id", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.ids) for r in token_ids(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(1, [15496, 995]), (2, []), (3, []), (3, encoder().ids(["twice"])[0]), (None, encoder().ids(["no id"])[0])], key=str)
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
