import random

import pytest
from pyspark.sql import functions as F

from findling.llm import splitting as S

PROSE = "In Tianath, the accountant forwarded the report. Nobody knew why!\nA line\n\nAnother paragraph; with more.\r\n\r\n"


def texts():
    rng = random.Random(4)
    words = ["Haus", "ein", "über", "x" * 40, "\n", "\n\n", ". ", "\f", "数", "🙂", "\u00a0"]
    yield PROSE * 60
    yield "x" * 9000
    yield "数" * 5000
    yield "a " * 4000
    yield "\n" * 10 + "y" * 1501
    for _ in range(40):
        yield " ".join(rng.choice(words) for _ in range(rng.randrange(10, 2500))).strip()


def test_pieces_are_bounded_overlap_and_lose_nothing():
    for t in texts():
        p = S.pieces(t)
        assert p[0][0] == 0 and p[-1][1] == len(t)
        assert all(0 < b - a <= 1500 for a, b in p) or not t
        for (a, b), (c, d) in zip(p, p[1:]):
            assert max(a + 1, b - 200) <= c <= b < d
        assert "".join(t[max(a, e):b] for (a, b), e in zip(p, [0, *[b for _, b in p]])) == t


def test_cuts_fall_at_natural_boundaries():
    t = PROSE * 60
    assert all(t[b - 1].isspace() for _, b in S.pieces(t)[:-1])
    assert sum(t[b - 1] == "\n" for _, b in S.pieces(t)[:-1]) > len(S.pieces(t)) / 2


def test_an_edit_changes_neighbours_only():
    rng = random.Random(1)
    t = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + "." * (rng.random() < 0.1) for _ in range(20000))
    changed = t[:30000] + " inserted words here" + t[30000:]
    a = {t[x:y] for x, y in S.pieces(t)}
    b = {changed[x:y] for x, y in S.pieces(changed)}
    assert len(a - b) <= 8 and len(a) > 80


def test_sizes_are_checked():
    with pytest.raises(ValueError):
        S.pieces("x" * 100, size=10, overlap=10)
    assert S.pieces("x" * 25, size=10, overlap=0, minimum=5)[-1][1] == 25


def test_operator(spark):
    rows = spark.createDataFrame(
        [(1, 0, 3, "\ff" + "w " * 2000, "k"), (1, 0, 3, "\ff" + "w " * 2000, "k"), (2, 1, 0, "short", "k"), (3, 0, None, None, "k"), (4, 0, 1, " \t ", "k"), (None, 0, None, "y" * 1600, "k")],
        "file_id long, chunk long, page long, text string, piece string",
    )
    got = S.split_texts(rows, ["file_id", "chunk"]).collect()
    by = lambda i: [r for r in got if r.file_id == i]
    assert len(by(1)) == 2 * by(1)[0].pieces > 4 and by(2)[0].text == "short" and by(2)[0].page == 0
    assert by(3)[0].text is None and by(4)[0].pieces == 1 and len(by(None)) == 2 and by(None)[0].page is None
    assert all(len(r.snippet or "") <= 160 and (r.text or "").startswith(r.snippet or "") for r in got)
    assert S.split_texts(rows.limit(0), ["file_id"]).count() == 0


def test_page_counts_form_feeds(spark):
    rows = spark.createDataFrame([(1, 5, "a" * 1400 + "\f" + "b" * 1400)], "id long, page long, text string")
    last = S.split_texts(rows, ["id"]).orderBy(F.desc("piece")).first()
    assert last.page == 5 + rows.first().text[: last.start_at].count("\f")


def test_valid_rows(spark):
    long_, short = "z " * 900, "z"
    rows = spark.createDataFrame(
        [(1, 0, 1.0, 1, long_), (1, 0, 2.0, 1, short), (2, 0, 1.0, 1, short), (2, 0, 2.0, 1, long_), (2, 0, 2.0, 1, long_), (3, None, None, None, long_), (4, 0, 1.0, 1, None)],
        "file_id long, chunk long, indexed_at double, page long, text string",
    )
    assert sorted(((r.file_id, r.chunk) for r in S.valid_long_passages(rows).collect()), key=str) == [(2, 0), (3, None)]
