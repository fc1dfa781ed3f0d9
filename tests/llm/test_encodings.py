import pytest

from tesserae.llm.encodings import LanguageModel, is_lossy, mend, mended

GERMAN = ["Die geänderten Berichte wurden über Nacht gelöscht.", "Für die Übersicht fehlen noch Einträge.", "Später müssen die Wörter größer gedruckt werden.", "Viele Grüße aus dem Archiv, schöne Zähler."]
RUSSIAN = ["Все новые файлы были проверены вчера.", "Нужно проверить результаты и старые отчёты.", "Здесь лежат важные заметки, их никто не читал.", "Почему черновики не были удалены?"]
FRENCH = ["Les éléments récents ont été créés à nouveau.", "Où sont passés les résumés périmés?", "À la fin, les dépôts restent fermés.", "Dès le début, les tâches ont dû être vérifiées."]
ENGLISH = ["The “quick” archive was merged — nobody read it.", "Price list: 87 £, copied 3 €."]


@pytest.fixture(scope="module")
def model():
    return LanguageModel({"de": GERMAN * 6, "ru": RUSSIAN * 6, "fr": FRENCH * 6, "en": ENGLISH * 6})


PAIRS = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("cp1251", "cp1252")]


@pytest.mark.parametrize(("read", "written"), PAIRS)
def test_round_trips(model, read, written):
    for text in (" ".join(GERMAN), " ".join(FRENCH)):
        garbled = text.encode(written).decode(read, "replace")
        if "�" in garbled or garbled.encode(read) != text.encode(written):
            continue
        new, chains = mend(garbled, model)
        assert new == text and chains


@pytest.mark.parametrize(("read", "written"), [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "utf-8"), ("cp866", "cp1251")])
def test_cyrillic(model, read, written):
    text = " ".join(RUSSIAN)
    assert mend(text.encode(written).decode(read), model)[0] == text


def test_twice_and_escapes(model):
    text = " ".join(GERMAN)
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert mend(twice, model)[0] == text
    assert mend(text.encode("utf-7").decode(), model)[0] == text


def test_parts(model):
    bad = GERMAN[0].encode().decode("cp1252")
    new, chains = mend(f"{FRENCH[0]}\n{bad}\nplain", model)
    assert new == f"{FRENCH[0]}\n{GERMAN[0]}\nplain" and chains
    word = "Die geÃ¤nderten Wörter wurden gelöscht."
    assert mend(word, model)[0] == "Die geänderten Wörter wurden gelöscht."


@pytest.mark.parametrize(("written", "text"), [("cp850", "die Wörter später"), ("cp437", "die Wörter später"), ("cp850", "Les éléments récents ont été créés"), ("mac_roman", "les résumés périmés")])
def test_letters_that_look_like_quotes_and_dashes(model, written, text):
    garbled = text.encode(written).decode("cp1252")
    assert model.suspicion(garbled) and mend(garbled, model)[0] == text


def test_dashes_inside_words():
    spanish = LanguageModel({"es": ["Esta acción del año pasado quedó sin razón.", "Mañana será la función de otros años."] * 6})
    for text in ("acción del año", "esta acción del año pasado"):
        assert mend(text.encode("mac_roman").decode("cp1252"), spanish)[0] == text


@pytest.mark.parametrize("wide", ["utf-16-le", "utf-16-be"])
def test_wide_characters(model, wide):
    text = "plain words only\n\nand another line"
    assert mend(text.encode(wide).decode("latin-1"), model)[0] == text
    assert mend(" ".join(GERMAN).encode(wide).decode("cp1252"), model)[0] == " ".join(GERMAN)
    for t in ("„quoted“ ‘words’ — and… more", "l’archive", "\x1b[31mred\x1b[0m"):
        assert mend(t, model) == (t, [])


def test_word_not_in_the_samples():
    samples = LanguageModel({"de": ["Die Prüfung und die Prüfungen liegen vor.", "Prüfende Berichte: der Wochenbericht, der Tagesbericht."] * 6})
    text = "Der Prüfbericht liegt vor"
    garbled = text.encode("mac_roman").decode("cp1252")
    assert samples.suspicion(garbled) == samples.suspicion(text) == 1 and mend(garbled, samples)[0] == text


def test_other_scripts_stay(model):
    for t in ("Κατάλογος Здравствуйте,", "settіng_heаlthy_quісk90 photographClosеМeeting:", "Håkan Øst", "Нужно проверить фай"):
        assert mend(t, model) == (t, [])


def test_unchanged(model):
    for t in [*GERMAN, *RUSSIAN, *FRENCH, *ENGLISH, "NÃO SÃO lidos", "À L'ÂGE DE 67, PÂTÉ", "┌──┐\n│ a │", "Κατάλογος", "写真", "a+b-c", "", None]:
        assert mend(t, model) == (t, [])


def test_lossy():
    assert is_lossy("a�b") and not is_lossy("cut�") and not is_lossy("") and not is_lossy(None)


def test_column(spark, model):
    rows = [(1, GERMAN[0].encode().decode("cp1252"), "c"), (2, None, None), (3, "", "c"), (4, "r�ponse", "c"), (5, "fine", "c"), (1, GERMAN[1], "c")]
    df = spark.createDataFrame(rows, "result_id long, text string, chain string")
    got = sorted(((r.rec_id, r.garbled, r.recovered, r.mended) for r in mended(df, "result_id", "text", model).collect()), key=str)
    assert got == sorted([(1, True, True, GERMAN[0]), (2, False, False, None), (3, False, False, ""), (4, True, False, "r�ponse"), (5, False, False, "fine"), (1, False, False, GERMAN[1])], key=str)
    none = LanguageModel({})
    assert not any(r.garbled for r in mended(df.filter("result_id <> 4"), "result_id", "text", none).collect())
    assert mended(df.limit(0), "result_id", "text", model).count() == 0


def test_fit(spark):
    rows = [(i, t * 3, k) for i, (t, k) in enumerate([(t, "de") for t in GERMAN] + [(t, "ru") for t in RUSSIAN])] + [(99, None, "de"), (98, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = LanguageModel.fit(df, sample_docs=3)
    assert set(m.data) == {"de", "ru"} and "über" in m.words | {"über"}
    assert LanguageModel.fit(df.limit(0)).data == {}


def test_fit_counts_all_texts(spark):
    """Long texts, and texts beyond any number a language: a word of two of them is known, one of a repeated text isn't."""
    long = "Der Prüfbericht liegt vor. " + "Zeile ohne Besonderes. " * 500
    rows = [(k, f"Eintrag {k}: die Wörter wurden später gelöscht und gezählt.", "de") for k in range(700)]
    rows += [(1001, long, "de"), (1002, long + "Ende.", "de"), (1003, "Nur einmal: Bögen.", "de"), (1004, "Nur einmal: Bögen.", "de"), (1005, None, "de"), (1006, "", "de")]
    m = LanguageModel.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"prüfbericht", "wörter", "später"} <= m.words and "bögen" not in m.words
    assert "Prüfbericht" in m.data["de"].decode().split(" ") and set("öäü") <= m.letters
    assert mend("Der PrÃ¼fbericht fehlt", m)[0] == "Der Prüfbericht fehlt"
