import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm.catalog import p3_found
from tesserae.llm.lookalike import plain_forms, same_look

CASES = {
    "checkѕum": "checksum", "Сｏｌｏｕｒ log": "Colour log", "été": "été", "ﬁn": "fin", "a‍b": "ab", "und x": "und x",
    "Кelvin 5 K": "Kelvin 5 K", "REАDME": "README", "файлa": "файла", "ｶﾞ": "ガ", "한": "한", "soft­hyphen": "softhyphen", "﻿x": "x", "a　b": "a b",
}
KEPT = ["plain", "Κατάλογος-font", "файлы", "été", "“quoted” – dash…", "5 € · 3 × 4 ≤ 12", "┌─┐", "x²", "½", "�", "写真", "👨‍👩‍👧", "❤️", "naïve", "हिन्दी", "می‌خواهم", "a\tb\nc", "Παράdειγμα"]


def test_forms():
    got, changed = same_look(list(CASES))
    assert got == list(CASES.values()) and changed.all()
    got, changed = same_look(KEPT)
    assert got == KEPT and not changed.any()


def test_other_scripts():
    cases = {"d\u0585cument": "document", "\u13aarchive": "Archive", "f\u2c9flder": "folder", "\ua4e2ystem": "System", "\u0561\u0580o": "\u0561\u0580\u0585"}
    got, changed = same_look(list(cases))
    assert got == list(cases.values()) and changed.all()
    kept = ["\u13a0\u13e3\u13c4", "\u0578\u0582\u0580\u056b\u0577", "\ua4e2\ua4f2 text"]
    assert same_look(kept)[0] == kept


def test_nothing():
    got, changed = same_look([None, "", "abc"])
    assert got == [None, "", "abc"] and not changed.any()
    assert same_look([])[0] == []


ALPHABET = st.sampled_from(list("abeocиаоеνο \n") + ["́", "̣", "̈", "̧", "é", "ệ", "​", "ａ", "각", "ᄀ", "ᅡ", "ᆨ", "ﬁ", "\U0001f600", "‍"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=12), max_size=6))
def test_properties(texts):
    once, changed = same_look(texts)
    again, moved = same_look(once)
    assert again == once and not moved.any()
    assert all(c == (a != b) for a, b, c in zip(texts, once, changed))
    assert all(unicodedata.normalize("NFC", x) == x for x in once)
    assert [same_look([t])[0][0] for t in texts] == once  # rows don't touch one another


def test_column(spark):
    df = spark.createDataFrame([(1, "é", "f"), (2, None, "f"), (3, "", "f"), (4, "x" * 100_000 + " ", "f")], "id long, name string, form string")
    got = {r.rec_id: (r.form, r.changed) for r in plain_forms(df, "id", "name").collect()}
    assert got == {1: ("é", True), 2: (None, False), 3: ("", False), 4: ("x" * 100_000 + " ", True)}
    assert plain_forms(df.limit(0), "id", "name").count() == 0


def test_garbled_by_all_documents(spark, tmp_path):
    """The test of problem 5 knows the words of all documents, also of long ones: a garbled text is no case here."""
    long = "Der Prüfbericht liegt vor. " + "Zeile ohne Besonderes. " * 500
    tables = {
        "documents": spark.createDataFrame([(1, long, "de"), (2, long + "Ende.", "de")], "doc_id long, text string, lang string"),
        "extract_results": spark.createDataFrame([(1, "Der PrÃ¼fbericht fehlt, er\u00a0fehlt"), (2, "Der Prüfbericht fehlt, er\u00a0fehlt"), (3, "Der Prüfbericht fehlt")], "result_id long, text string"),
        "files": spark.createDataFrame([(7, "plain.txt"), (8, "ｗide.txt")], "id long, name string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert sorted(map(tuple, p3_found(spark, str(tmp_path)).collect())) == [("name", 8), ("text", 2)]
