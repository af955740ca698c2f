import pytest
from pyspark.sql import functions as F

from findling.llm import mojibake as J

CLEAN = "Schöne Grüße, España y después: «où été» Straße Büro März für Überweisung más año corrigió maïs l’été – “so” 5 € für Söhne Atención déjà reçu"
MODEL = {t: n * 40 for t, n in J.count_triples([CLEAN] * 20).items()}


@pytest.mark.parametrize("codec", ["cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859_15", "cp1254"])
def test_utf8_read_in_a_legacy_page_comes_back(codec):
    for word in ("Grüße", "después", "été", "Straße"):
        raw = word.encode()
        wrong = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in raw)
        text, damaged, lost = J.Restorer(MODEL).restore(f"Beste {wrong} hier")
        assert damaged and not lost and text == f"Beste {word} hier", wrong


def test_two_layers():
    wrong = "Grüße".encode().decode("cp1252", "replace").encode().decode("cp1252", "replace")
    assert J.Restorer(MODEL).restore("GrÃƒÂ¼ÃƒÅ¸e")[0] == "Grüße" and "Ã" in wrong


@pytest.mark.parametrize("wrong, right", [("Atenci≤n", "Atención"), ("B³ro", "Büro"), ("Gr³▀e", "Grüße"), ("MŠrz", "März"), ("Reuni¾n", "Reunión"), ("вЂ“", "–"), ("Ÿber", "über"), ("imprimÚ", "imprimé")])
def test_single_bytes(wrong, right):
    assert J.Restorer(MODEL).restore(f"Die {wrong} da")[:2] == (f"Die {right} da", True)


@pytest.mark.parametrize("text", [
    CLEAN, "Смета Дорва. Λέσχη Μορα.", "µ-Filter. 42 m³ und 3½ Fenster, § 7", "├─ Ablage", "Îlena & Co.", "PÃO Tirma", "São Vellar", "Ægirholm", "n.º 12", "d’été “Übers” –", "日本語 テスト", "naïve café ÄÖÜ É", "plain ascii", "° ± ×",
])
def test_sound_texts_stay(text):
    assert J.Restorer(MODEL).restore(text) == (text, False, False)


def test_lost_characters_are_damage():
    assert J.Restorer(MODEL).restore("Schl�ssel") == ("Schl�ssel", True, True)


def test_only_the_wrong_spans_change():
    assert J.Restorer(MODEL).restore("Grüße und GrÃ¼ÃŸe, Смета")[0] == "Grüße und Grüße, Смета"


def test_operator(spark):
    rows = spark.createDataFrame(
        [(1, "GrÃ¼ÃŸe " * 3000, "ok", 1), (1, "GrÃ¼ÃŸe " * 3000, "ok", 1), (2, None, None, 1), (3, "", "Büro", 1), (None, "lâ€™Ã©tÃ©", "x", 1)], "id long, a string, b string, damaged int"
    )
    got = J.restore_fields(rows, "id", ["a", "b"]).collect()
    assert sum(r.damaged for r in got) == 3 and len(got) == 8
    assert next(r.restored for r in got if r.id is None and r.field == "a") == "l’été"
    assert J.restore_fields(rows.where(F.lit(False)), "id", ["a", "b"]).count() == 0
