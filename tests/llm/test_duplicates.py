import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.llm import duplicates as D


def sets(seed=0, n=220):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            s = set(rng.choice(out)[1])
            for _ in range(rng.randrange(0, 4)):
                s.add(rng.randrange(300)) if rng.random() < 0.5 else s and s.discard(rng.choice(sorted(s)))
        else:
            s = {rng.randrange(300) for _ in range(rng.randrange(1, 25))}
        out.append((i, sorted(s)))
    return out


@pytest.mark.parametrize("jaccard, overlap, block", [(0.8, None, 2048), (0.5, None, 2048), (0.5, None, 3), (None, 3, 2048), (None, 8, 5)])
def test_join_equals_brute_force(spark, jaccard, overlap, block):
    rows = sets()
    df = spark.createDataFrame(rows, "key long, tokens array<bigint>")
    got = {tuple(r) for r in D.similar_sets(df, jaccard=jaccard, overlap=overlap, list_block=block).collect()}
    want = set()
    for a, x in rows:
        for b, y in rows:
            c = len(set(x) & set(y))
            if a < b and (c >= overlap if overlap else c / max(1, len(set(x) | set(y))) >= jaccard):
                want.add((a, b))
    assert got == want and want


def test_odd_sets(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [5, 5, None, 6], 1), (4, [5, 6], 1)], "key long, tokens array<bigint>, size int")
    assert [tuple(r) for r in D.similar_sets(df, jaccard=0.8).collect()] == [(3, 4)]
    assert D.similar_sets(df.where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        D.similar_sets(df, jaccard=None)


@pytest.mark.parametrize("a, b, same", [
    ("C:\\x\\Alte Police RE0012.pdf", "D:\\Kopie von alte_police_000-0012 (2).DOCX", True), ("Plan 2019-01-22.txt", "plan_22.01.2019_v3.md", True), ("Plan 20190122.txt", "Plan 20190123.txt", False),
    ("Seminarrbeit Hafai 12.doc", "Semiararbeit_Hafai_12_old.doc", True), ("Geänderte Rechnung 7.pdf", "Geaenderte.Rechnung.7 - Copy.pdf", True), ("Vertrag Bubopujalo.doc", "Vertrag Fivijavude.doc", False),
    ("Letter 5.txt", "Invoice 5.txt", False), ("Final invoice 9.txt", "Old invoice 9.txt", False), ("scan_Letter_5.txt", "Letter Entwurf 5.txt", True), ("court letter Miab Damaged.pdf", "Damaged court letter Miab.pdf", True),
    ("Letter Nr 5.txt", "Letter 0005.txt", True), ("Letter_old.txt", "Letter FINAL.txt", True),
])
def test_titles(a, b, same):
    assert D.same_title(D.title(a), D.title(b)) is same and D.same_title(D.title(b), D.title(a)) is same


def test_edits():
    assert [D.edits_between(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abcd", "abd"), ("kitten", "sitting"), ("", "a"))] == [0, 1, 1, 3, 1]


def test_names_as_classes(spark):
    rows = [(1, "a\\Lange Quittung 12.pdf", 1.0, "x"), (2, "b/Lange_Quitung_12.doc", 1.0, "x"), (3, "Lange Quittung 13.pdf", 1.0, "x"), (4, None, 1.0, "x"), (5, "", 1.0, "x"), (None, "z", 1.0, "x"), (1, "a\\Other 1.pdf", 0.5, "x"), (6, "c\\lange quittung 12 (1).txt", 2.0, "x"), (1, "a\\Lange Quittung 12.pdf", 1.0, "x")]
    files = spark.createDataFrame(rows, "id long, path string, indexed_at double, class string")
    members, links = D.name_classes(files)
    assert {tuple(r) for r in D.expand(members, links).distinct().collect()} == {(1, 2), (1, 6), (2, 6)}
    groups = {r.id: (r.group, r.links) for r in D.grouped(members, links).collect()}
    assert groups[1][0] == groups[2][0] == groups[6][0] != groups[3][0] and groups[1][1] == groups[2][1] == 2 and groups[3][1] == 0
    assert D.expand(*D.name_classes(files.where(F.lit(False)))).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 64))
    rows = [(i, base[i % 60] + rng.normal(0, 0.1 + 0.1 * (i % 3), 64)) for i in range(240)] + [(900, base[0]), (901, base[0] * 2), (902, np.zeros(64)), (903, None)]
    df = spark.createDataFrame([(i, None if v is None else [float(np.float32(x)) for x in v]) for i, v in rows], "file_id long, vector array<float>")
    got = {tuple(r) for r in D.expand(*D.vector_classes(df, dim=64)).distinct().collect()}
    ids = [i for i, v in rows if v is not None and np.any(v)]
    u = np.array([np.float32(v) for _, v in rows if v is not None and np.any(v)], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(ids[a], ids[b]) for a, b in np.argwhere(np.triu(u @ u.T, 1) >= 0.96)}
    assert len(want) > 100 and got <= want and len(got) >= 0.98 * len(want)


@pytest.mark.parametrize("jaccard, size, seed", [(0.5, 30, 1), (0.8, 40, 2), (0.36, 20, 3)])
def test_chains_of_similar_sets_are_exact(jaccard, size, seed):
    """Every set differs from the one before in a few tokens, so answers are derived along long chains."""
    rng = random.Random(seed)
    chain = [set(range(size))]
    for _ in range(260):
        s = set(chain[-1])
        for _ in range(rng.randrange(1, 4)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(1, 90))
        s.add(0)  # all of them in the list of token 0
        chain.append(s)
    rng.shuffle(chain)
    entries = [(k, len(s), 0, sorted(s)) for k, s in enumerate(chain)]
    got = set(D.ListJoin(jaccard, None).pairs(entries))
    want = {(a, b) for a in range(len(chain)) for b in range(a + 1, len(chain)) if len(chain[a] & chain[b]) >= D.needed(len(chain[a]), len(chain[b]), jaccard, None)}
    assert got == want and want
    halves = set(D.ListJoin(jaccard, None).pairs(entries[:130], entries[130:]))
    assert halves == {(a, b) for a, b in want if a < 130 <= b}
