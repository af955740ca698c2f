import random

import numpy as np
from pyspark.sql import functions as F

from findling.llm import leakage as L


def make(seed=3, items=30, docs=300):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)).title()
    frame = "the file {} states that {} of {} paid {} euros for the {} report in {} and what did {} receive in {} after a clerk approved the old letter number {} with great care"
    one = lambda: frame.format(name(), name(), name(), rng.randrange(999), name(), rng.randrange(1900, 2000), name(), name(), rng.randrange(999))
    ev = [(i, one(), name()) for i in range(items)]
    common = [" ".join(rng.choice("the old new clerk office sent report letter of in and a with note".split()) for _ in range(60)) for _ in range(docs)]
    texts, truth = [], set()
    for d, c in enumerate(common):
        t = c + ". " + one()  # built alike, but of another case
        if d % 10 == 0:
            i = rng.randrange(items)
            w = ev[i][1].split()
            kind = d // 10 % 4
            if kind == 0:
                t, hit = c + " " + " ".join(w).upper() + ". " + c, True
            elif kind == 1:
                t, hit = " ".join(w[: len(w) * 6 // 10]) + " " + c, True
            elif kind == 2:
                t, hit = " ".join(w[len(w) // 2 :]) + " " + c + " " + "\n".join(w[: len(w) // 2]), True
            else:
                t, hit = c + " " + " ".join(w[: len(w) // 4]) + " " + c, False
            if hit:
                truth.add((d, i))
        texts.append((d, t))
    return ev, texts, truth


def test_finds_what_alignment_of_all_pairs_finds(spark):
    ev, texts, truth = make()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(ev, "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(docs, items).where("kind = 'copy'").collect()}
    terms = L.Terms(ev)
    df = np.bincount(np.concatenate([np.unique(x[x >= 0]) for x in (terms.of(t) for _, t in texts)]), minlength=len(terms))
    weight = np.log((len(texts) + 1) / (df + 1)) + 0.1
    brute = set()
    for d, t in texts:
        x = terms.of(t)
        for k, (i, _, _) in enumerate(ev):
            net, span, _, rare, _ = L.held(terms.items[k], x, weight=weight)
            if net >= L.NET and span >= L.SPAN and rare >= L.RARE_SHARE:
                brute.add((d, i))
    assert brute == truth and got == truth


def test_words_are_folded():
    t = L.Terms([(1, "Anhörung Straße Drialilburg 12", None)])
    assert t.of("ANHOERUNG strasse Drialilbug **12** An-\nhörung Anhörungen x").tolist() == [0, 1, 2, 3, 0, -1, -1]


def test_alignment_allows_gaps_and_two_pieces():
    a = np.arange(40)
    assert L.held(a, a)[0] == 1.0
    assert L.held(a, np.concatenate([np.full(50, -1), a[20:], np.full(90, -1), a[:20]]))[4] == 2
    noisy = a.copy()
    noisy[::9] = -1
    assert L.held(a, np.concatenate([noisy, np.full(5000, -1)]))[0] > 0.6
    assert L.held(a, np.full(10, -1)) == (0.0, 0.0, 0.0, 0.0, 0) and L.held(a[:0], a) == (0.0, 0.0, 0.0, 0.0, 0) and L.held(a, a[:0])[0] == 0.0


def test_operator_corner_cases(spark):
    item = "one rare Zorblax met two rare Quintolas near three rare Mervindes while four rare Hulbrans watched five rare Pandrixes"
    docs = spark.createDataFrame([(1, item, "k"), (1, item, "k"), (2, None, "k"), (3, "", "k"), (4, "word " * 50000 + item, "k"), (None, item, "k"), (5, "nothing here", "k")], "doc_id long, text string, kind string")
    items = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (2, None, None), (3, "", "y"), (4, "!!!", "z")], "item_id long, text string, answer string")
    got = L.find_leaks(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.kind) for r in got) == [("1", 1, "copy"), ("4", 1, "copy"), ("None", 1, "copy")]
    none = F.lit(False)
    assert L.find_leaks(docs.where(none), items).count() == 0 and L.find_leaks(docs, items.where(none)).count() == 0


def prose(rng, n):
    return " ".join(rng.choice("river garden window summer music kitchen morning bicycle paper yellow quiet under behind toward winter market".split()) for _ in range(n))


def test_two_far_pieces_of_a_quarter_each_are_found(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    ev = [(i, " ".join(name() if j % 3 == 0 else rng.choice("the file states that of paid for report in and".split()) for j in range(40)), "none") for i in range(40)]
    texts = []
    for d in range(200):
        w = ev[d % 40][1].split()
        texts.append((d, " ".join([prose(rng, 30), *w[:10], prose(rng, 200), *w[20:30], prose(rng, 60)]) if d < 40 else prose(rng, 120) + " the file states that of paid for report in and"))
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(ev, "item_id long, text string, answer string")).where("kind = 'copy'").collect()}
    assert got == {(d, d) for d in range(40)}


def test_candidates_miss_nothing_that_is_held():
    rng = np.random.default_rng(2)
    items = [rng.integers(0, 60, n).astype(np.int32) for n in (1, 3, 6, 9, 20, 40)]
    docs = [np.concatenate([np.full(9, -1), x[: len(x) // 2], rng.integers(-1, 60, 80), x[len(x) // 2 :]]).astype(np.int32) for x in items for _ in range(5)]
    got = {(d, k) for d, k, _ in L.Signs(items).candidates(docs, most=40)}
    held = {(d, k) for d, x in enumerate(docs) for k, i in enumerate(items) if L.held(i, x)[0] >= L.PARAPHRASE}
    assert held and held <= got


def test_an_item_in_a_third_of_the_documents_is_found(spark):
    ev, texts, _ = make()
    rng = random.Random(9)
    texts = [(d, f"{prose(rng, 50)} {ev[0][1]} {prose(rng, 50)}" if d % 3 == 0 else prose(rng, 100)) for d, _ in texts]
    got = {(r.doc_id, r.item_id, r.similarity > 0.5) for r in L.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(ev, "item_id long, text string, answer string")).where("kind = 'copy'").collect()}
    assert got == {(d, 0, True) for d, _ in texts if d % 3 == 0}


def odd_case(rng):
    """An item and a document that holds parts of it, changed a little, among words of its own and others."""
    size = int(rng.integers(3, 40))
    item, parts = rng.integers(0, size, int(rng.integers(1, 45))), []
    for _ in range(int(rng.integers(1, 5))):
        x = rng.integers(-1, size * int(rng.choice([1, 2, 6])), int(rng.integers(0, 120)))
        a, b = np.sort(rng.integers(0, len(item) + 1, 2))
        y = np.where(rng.random(b - a) < rng.choice([0, 0.1, 0.3]), -1, item[a:b])
        parts += [np.where(x >= size, -1, x), y[rng.random(len(y)) > rng.choice([0, 0.1, 0.2])]]
    return item.astype(np.int32), np.concatenate(parts).astype(np.int32), rng.random(size + 1).astype(np.float32)


def test_stretches_give_what_whole_documents_give(monkeypatch):
    rng = np.random.default_rng(4)
    cases = [(*odd_case(rng), least) for least in (0.1, L.PARAPHRASE, L.NET, 0.6) for _ in range(150)]
    got = [L.held(i, d, least, w) for i, d, w, least in cases]
    monkeypatch.setattr(L, "stretches", lambda good, inside, least: [(0, len(inside))])
    assert got == [L.held(i, d, least, w) for i, d, w, least in cases] and sum(r[0] > 0 for r in got) > 200


def test_only_stretches_that_can_score_are_aligned(monkeypatch):
    rng = np.random.default_rng(6)
    item = np.arange(40)
    near = [np.concatenate([item[k : k + 3], np.full(6, -1)]) for k in rng.integers(0, 38, 300)]  # three words on, then six others
    cells, align = [], L.align
    monkeypatch.setattr(L, "align", lambda i, d: cells.append(len(i) * len(d)) or align(i, d))
    assert L.held(item, np.concatenate(near), L.NET) == (0.0, 0.0, 0.0, 0.0, 0)
    assert L.held(item, np.concatenate([*near, item[:25], *near]), L.NET)[0] >= 0.6
    assert sum(cells) < 40 * 200  # the second document has 5,425 words


def test_words_looked_up_as_parts_are_the_same():
    t = L.Terms([(1, "Der Zeuge O'Brien nannte 12,5 Prozent in Straße 7a/b", None)], memo=3)
    texts = ["Zeuge,O'Brien nannte\x1c12,5", "der Zeug <b>Pro</b>zent--Strasse 7a/b", "x" * 90 + " Zeuge " + "x" * 90, " \n", "Pro-\nzent _in_ <", ""]
    for _ in range(2):
        assert [t.of(x).tolist() for x in texts] == [[t.term(w) for w in L.words(x)] for x in texts]
