import numpy as np
import pytest

from folioflow.llm.encoding import WIDTH, Model, repair_encoding, symbols, undo_bytes

FRENCH = "Cette hypothèse reste à vérifier. L’annexe détaille la méthode déjà évaluée près du réseau. "
GERMAN = "Die Prüfung der Geräte wäre für größere Änderungen möglich. Das Gerät ist schwächer. "
RUSSIAN = "Система проверяет журнал событий перед каждым шагом. Всего пять устройств. "
ENGLISH = "The naïve baseline fails — it doesn’t last. The error was ±3 points. "
CORPUS = [FRENCH] * 20 + [GERMAN] * 20 + [RUSSIAN] * 20 + [ENGLISH] * 20


@pytest.fixture(scope="module")
def model():
    s = symbols("\n".join(CORPUS))
    n = np.bincount(s[:-1] * WIDTH + s[1:], minlength=WIDTH * WIDTH)
    at = np.flatnonzero(n)
    return Model(at, n[at].astype(float))


@pytest.mark.parametrize("text", [FRENCH, GERMAN, RUSSIAN, ENGLISH])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_utf8_read_otherwise_is_restored(model, text, wrong):
    garbled = "".join(bytes([b]).decode(wrong, "replace") for b in text.encode("utf-8"))
    if "�" in garbled:
        garbled = "".join(c if c != "�" else chr(b) for c, b in zip(garbled, text.encode("utf-8")))
    assert model.inspect(garbled) == (True, False, text)


@pytest.mark.parametrize("text, right, wrong", [(RUSSIAN, "cp1251", "cp1252"), (RUSSIAN, "koi8_r", "cp1251"), (GERMAN, "cp1252", "cp1251"), (FRENCH.replace("’", "'"), "latin-1", "mac_roman")])
def test_single_bytes_are_restored(model, text, right, wrong):
    damaged, lost, new = model.inspect(text.encode(right).decode(wrong))
    assert (damaged, lost) == (True, False)
    assert sum(a == b for a, b in zip(new, text)) > 0.95 * len(text)


def test_twice_garbled(model):
    twice = FRENCH.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1")
    assert model.inspect(twice) == (True, False, FRENCH)


def test_partly_garbled(model):
    text = GERMAN + FRENCH.encode("utf-8").decode("latin-1")
    assert model.inspect(text) == (True, False, GERMAN + FRENCH)


@pytest.mark.parametrize("text", [*set(CORPUS), "", "plain", "Old crawlers printed “Ã©” where the page says “é”.", "it reads 'Ã¼' and warns", "Cost is 212 € a year ¬ §", "SÃO ÂNGULO", "中文"])
def test_sound_texts_are_left_alone(model, text):
    assert model.inspect(text) == (False, False, text)


def test_lost_characters(model):
    assert model.inspect("Die Pr�fung der Geräte")[:2] == (True, True)
    assert model.inspect("the sign “�” stands for it")[:2] == (False, False)


def test_undo_bytes():
    assert undo_bytes("Ã©", "cp1252") == "é" and undo_bytes("é", "cp1252") is None and undo_bytes("中", "cp1252") is None


def test_operator(spark):
    rows = [(k, t) for k, t in enumerate(CORPUS)] + [(900, FRENCH.encode().decode("latin-1")), (None, None), (901, ""), (901, ""), (902, ENGLISH * 3000 + " Ã©tÃ©")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as damaged", "2 as pair", "3 as n")
    got = repair_encoding(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.damaged} == {900, 902}
    assert [r.restored for r in got if r.doc_id == 900] == [FRENCH]
    assert [r.restored for r in got if r.doc_id is None] == [None]
    assert repair_encoding(df.limit(0)).count() == 0


@pytest.mark.parametrize("word, right, wrong", [("doesn’t", "cp1252", "mac_roman"), ("doesn’t", "mac_roman", "cp1252")])
def test_single_bytes_of_an_apostrophe_alone_are_restored(model, word, right, wrong):
    text = f"The error {word} last."
    assert model.inspect(text.encode(right).decode(wrong)) == (True, False, text)
