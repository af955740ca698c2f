import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from findling.llm import packing as K


def filled(sizes, capacity):
    loads, seen = {}, {}
    for s, a, b, c in K.plan(sizes, capacity):
        for k in range(b - a):
            loads[c + k] = loads.get(c + k, 0) + s
        seen[s] = seen.get(s, 0) + b - a
    return loads, seen


def test_plans_are_whole_and_tight():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([1, 7, 50, 300])
        sizes = {}
        for _ in range(rng.randrange(0, 400)):
            s = rng.randrange(0, cap + 1)
            sizes[s] = sizes.get(s, 0) + 1
        loads, seen = filled(sizes, cap)
        assert seen == sizes and all(v <= cap for v in loads.values())
        assert sorted(loads) == list(range(len(loads)))
        all_ = np.repeat(list(sizes) or [0], list(sizes.values()) or [0])
        if len(all_):
            assert len(loads) <= 11 / 9 * max(K.bound(all_, cap), 1) + 1


def test_hot_sizes():
    loads, _ = filled({700: 300_000, 600: 5, 1: 10}, 2048)
    assert len(loads) == 150_000 + 0 and max(loads.values()) <= 2048
    with pytest.raises(ValueError):
        K.plan({11: 1}, 10)


def test_operator(spark):
    rows = [(i, "wort " * (i % 40), None if i % 3 else i % 40, "x") for i in range(500)] + [(9000, "a b " * 3000, None, "x"), (9001, None, None, "x"), (9002, None, -5, "x"), (9003, "", 0, "x"), (7, "wort " * 7, None, "x"), (None, "drei kleine Worte", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, container string")
    got = K.pack(df, capacity=100).collect()
    loads = {}
    for r in got:
        loads[r.container] = loads.get(r.container, 0) + r.n_tokens
    assert max(loads.values()) <= 100 and sorted(loads) == list(range(len(loads)))
    big = sorted((r.piece, r.from_token, r.n_tokens, r.pieces) for r in got if r.doc_id == 9000)
    assert len(big) == 60 and sum(x[2] for x in big) == 6000 and [x[1] for x in big] == [100 * i for i in range(60)]
    assert len(got) == len(rows) + 59 and all(r.pieces == 1 for r in got if r.doc_id != 9000)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, K.pack(df.repartition(7), capacity=100).collect()), key=str)
    assert K.pack(df.where(F.lit(False))).count() == 0


def test_tokens_are_counted_by_the_rule(spark):
    texts = ["a_b c-d 3,5 €", "ﬁ ½ é\u00a0x\u2003y\x1cz", "", None, "日本 😀!", "_ __"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(K.token_count(F.col("t"))).collect()] == [len(re.findall(r"\w+|[^\w\s]", t or "")) for t in texts]


def test_a_size_that_most_documents_share_is_ranked_in_parts(spark):
    df = spark.createDataFrame([(i, 700 if i % 3 else i % 2048) for i in range(3000)], "doc_id long, n long")
    parts = K.pack(df, size=F.col("n"), salt_rows=64).collect()
    used: dict[int, int] = {}
    for r in parts:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
    assert len(parts) == 3000 and len({r.doc_id for r in parts}) == 3000 and max(used.values()) <= 2048
    assert len(used) == len(set(r.container for r in K.pack(df, size=F.col("n")).collect()))
