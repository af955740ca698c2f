import pytest
from pyspark.sql import functions as F

from findling.llm import quality as Q

PROSE = "Der Hausmeister und unser Büro schickten den zweiten Brief Ende März, weil die Summe nicht stimmte. Niemand wusste, warum es so lange dauerte, bis die Antwort kam."


@pytest.mark.parametrize("text, form", [
    (PROSE, "prose"), (PROSE.upper(), "prose"), (PROSE.lower(), "prose"), ("1. " + PROSE + "\n\n2. " + PROSE, "prose"), ("\n".join(PROSE[i : i + 30] for i in range(0, 150, 30)), "prose"),
    ("\n".join(f"- Old letter {i}" for i in range(12)), "list"), ("\n".join(f"Kapitel {i} ........... {i}" for i in range(12)), "list"), ("\n".join(f"{i} x Neue Lampe" for i in range(1, 12)), "list"),
    ("\n".join(f"{i},50 | Name{i} | 0{i}.03.2020" for i in range(9)), "table"), ("\n".join(f"{i}.5\tBerg\t{i * 7}" for i in range(9)), "table"),
    ("=" * 400, "junk"), ("\n".join(["Home > Hilfe > Kontakt > Login"] * 9), "junk"), ("q8Xz7/aa+Zk09sdlkjQW" * 30, "junk"), ("", "junk"), (None, "junk"), (" \n ", "junk"),
])
def test_forms(text, form):
    p = Q.Profiles.fit([])
    d = Q.describe([text])
    by = p.shares(d, 1)
    total = by.sum()
    share = by[0, 0] / total if total else 0
    got = "junk" if not total else "prose" if share >= 0.5 else Q.FORMS[1 + by[0, 1:].argmax()]
    assert got == form


def test_divergence_is_a_divergence():
    d = Q.describe([PROSE, "- a\n- b\n- c", "| 1 | 2 |"])["vectors"]
    m = Q.divergence(d, d)
    assert abs(m - m.T).max() < 1e-4 and abs(m.diagonal()).max() < 1e-4 and (m > -1e-4).all()


def test_counts():
    d = Q.describe(["Das ist gut.\nzwei Worte!", "A1 b2"])
    assert d["words"].tolist() == [5, 2] and d["lines"].tolist() == [2, 1]
    assert abs(d["mean_word"][0] - 18 / 5) < 1e-9 and abs(d["common_words"][0] - 2 / 5) < 1e-9


def test_batches_don_t_matter(spark):
    rows = [(i, PROSE * (i % 5) + "\n" * (i % 2) + "- x\n" * (i % 7)) for i in range(60)] + [(100, PROSE * 4000), (101, "x\n\n" * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = {r.doc_id: tuple(r) for r in Q.text_statistics(df.repartition(1), Q.Profiles.fit([])).collect()}
    b = {r.doc_id: tuple(r) for r in Q.text_statistics(df.repartition(9), Q.Profiles.fit([])).collect()}
    assert a == b and len(a) == 62


def test_operator(spark):
    docs = spark.createDataFrame([(1, PROSE, "w"), (1, PROSE, "w"), (2, None, "w"), (3, "", "w"), (None, "- a\n- b\n- c\n- d", "w")], "doc_id long, text string, form string")
    labels = spark.createDataFrame([(1, "prose"), (1, "prose"), (3, "odd"), (9, "list"), (2, "junk")], "doc_id long, form string")
    got = Q.text_statistics(docs, Q.fit_profiles(docs, labels)).collect()
    assert len(got) == 5 and {r.doc_id: r.form for r in got} == {1: "prose", 2: "junk", 3: "junk", None: "list"}
    none = docs.where(F.lit(False))
    assert Q.text_statistics(none, Q.fit_profiles(none, labels.where(F.lit(False)))).count() == 0
