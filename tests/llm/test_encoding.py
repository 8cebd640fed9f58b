import pytest

from tidemark.llm.encoding import repair, repaired

FRENCH = "L’enquête sur la société « Varnoële » s’établissait à 37,23 € le 5 été."
RUSSIAN = "Совет директоров рекомендовал акционерам принять предложение до конца месяца. Объём опционов вырос."
JAPANESE = "取締役会は一株当たりの価格を公正と判断した。通常の水準を大きく上回った。"
GERMAN = "Gemäß § 5 der Satzung müssen die Aktionäre über die Übernahme abstimmen."


def sloppy(text, encoding):
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250"])
@pytest.mark.parametrize("text", [FRENCH, GERMAN])
def test_utf8_read_as_another(text, encoding):
    assert repair(sloppy(text, encoding)) == (True, text, True)


@pytest.mark.parametrize("text", [FRENCH, GERMAN, RUSSIAN, JAPANESE])
def test_only_spans_and_twice(text):
    bad = sloppy(text, "cp1252")
    assert repair(f"Fine before – {bad} and fine, naïve, after.") == (True, f"Fine before – {text} and fine, naïve, after.", True)
    assert repair(sloppy(bad, "cp1252")) == (True, text, True)


@pytest.mark.parametrize("was, read", [("cp1251", "latin-1"), ("koi8-r", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("utf-8", "cp1251")])
def test_russian(was, read):
    bad = RUSSIAN.encode(was).decode(read, "ignore") if was != "utf-8" else sloppy(RUSSIAN, read)
    found, new, _ = repair(bad)
    assert found and new == RUSSIAN


def test_japanese():
    assert repair(JAPANESE.encode("euc_jp").decode("latin-1")) == (True, JAPANESE, True)
    assert repair(JAPANESE.encode().decode("cp932", "replace"))[0]


@pytest.mark.parametrize(
    "text",
    [None, "", " \n", "plain", FRENCH, GERMAN, RUSSIAN, JAPANESE, RUSSIAN.upper(), "VOLTAM À NEGOCIAÇÃO AMANHÃ. AÇÕES", "y²+x² = 2½ «À la» 📈🚀 ﬁnal café ‚so‘", "Ürün İstanbul’da", "x" * 200_000 + "é"],
)
def test_sound_texts_stay(text):
    assert repair(text) == (False, text, True)


@pytest.mark.parametrize("text", ["Âge légal de la retraite", "Âmbito do acordo de fusão", "Ângela Merkel spoke", "L'Âme du vin", "Às vezes, Ásia e Ílhavo", "SÃO PAULO e São João; Ãh"])
def test_words_that_begin_with_a_lead_letter_are_sound(text):
    assert repair(text) == (False, text, True)


def test_any_number_of_times():
    bad = "Gemäß § 5"
    for _ in range(6):
        bad = sloppy(bad, "cp1252")
    assert repair(bad) == (True, "Gemäß § 5", True)


def test_lost():
    assert repair("complaint�a point") == (True, "complaint�a point", False)


@pytest.mark.parametrize("encoding", ["gbk", "cp932", "big5"])
@pytest.mark.parametrize("text", ["It’s a move", "priced at 5 – 6", "“Yes”, he said"])
def test_single_marks_read_as_east_asian(text, encoding):
    try:
        bad = text.encode().decode(encoding)
    except UnicodeDecodeError:
        pytest.skip("not readable that way")
    assert repair(bad) == (True, text, True)


def test_rows(spark):
    df = spark.createDataFrame([(1, sloppy(FRENCH, "cp1252"), 0), (2, FRENCH, 0), (3, None, 0), (4, "", 0), (5, sloppy(FRENCH, "cp1252"), 0)], "doc_id bigint, text string, restored int")
    assert sorted(tuple(r) for r in repaired(df).collect()) == [(1, FRENCH, True), (5, FRENCH, True)]
    assert repaired(df.limit(0)).count() == 0
