from pyspark.sql import functions as F

from findling.llm import ranking as R

SCHEMA = "query_id long, file_id long, similarity double, score double, keyword boolean, exact boolean, combined string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def ranked(spark, rows):
    return R.full_order(R.combined(frame(spark, rows), "query_id", "file_id"), "query_id", "file_id")


def test_no_range_dominates(spark):
    rows = [(1, i, 0.4 + i / 100, 10.0 ** (i % 7), i % 2 == 0, False) for i in range(20)] + [(1, 99, 0.58, 1e6, True, True)]
    first = [r.file_id for r in ranked(spark, rows).orderBy("rank").collect()][0]
    assert first == 99
    scaled = [(q, f, s * 1000, x / 1e5, k, e) for q, f, s, x, k, e in rows]  # other units, same order
    order = lambda rr: [r.file_id for r in ranked(spark, rr).orderBy("rank").collect()]
    assert order(rows)[:5] == order(scaled)[:5]


def test_missing_values_ties_and_repeats(spark):
    rows = [(1, 1, None, None, None, None), (1, 2, 0.5, 0.0, True, False), (1, 2, 0.7, 3.0, False, True), (1, 3, float("nan"), -1.0, False, False), (1, None, 1.0, 1.0, True, True), (None, 1, 0.5, 1.0, True, True), (2, 5, 0.5, 1.0, True, True), (2, 4, 0.5, 1.0, True, True)]
    got = {(r.query_id, r.file_id): r for r in ranked(spark, rows).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (None, 1), (2, 4), (2, 5)}
    assert got[1, 2].rank == 1 and got[1, 2].similarity == 0.7 and got[2, 4].rank == 1 and got[2, 5].rank == 2
    assert all(0 < r.combined <= 1 for r in got.values())


def test_ranks_count_through(spark):
    rows = [(q, f, (f * 37 % 101) / 101, (f * 53 % 97) + 0.1, f % 3 == 0, f % 5 == 0) for q in (1, 2) for f in range(300)]
    got = ranked(spark, rows).collect()
    for q in (1, 2):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 301))
        assert [r.file_id for r in mine] == [r.file_id for r in sorted(mine, key=lambda r: (-r.combined, r.file_id))]
    top = R.first_of_groups(R.combined(frame(spark, rows), "query_id", "file_id"), "query_id", "file_id", 5)
    assert {(r.query_id, r.file_id) for r in top.collect()} == {(r.query_id, r.file_id) for r in got if r.rank <= 5}
    assert R.combined(frame(spark, []), "query_id", "file_id").where(F.lit(True)).count() == 0


def test_near_scores_are_told_apart(spark):
    rows = [(1, i, 0.3 + i / 50, 1.0 + i, True, False) for i in range(1, 20)] + [(1, 100, 0.700002, 5.0, True, False), (1, 99, 0.700001, 5.0, True, False), (1, 98, 0.7, 5.0, True, False)]
    got = {r.file_id: r.rank for r in ranked(spark, rows).collect()}
    assert got[100] < got[99] < got[98]
