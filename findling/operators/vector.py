"""Exact vector search, files' mean vectors, and what is shown of similarities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from findling.operators.state import number_rows
from findling.session import bounded

NEAR = 0.96


def scored(vectors: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """Every vector's product with one query vector (a literal: no join), computed batch by batch."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def product(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        ok = np.array([x is not None and len(x) == len(q) for x in v], bool)
        if ok.any():
            out[ok] = np.stack(v[ok].to_numpy()).astype(np.float64) @ q
        return pd.Series(out).where(ok, None)

    return vectors.withColumn("similarity", product(F.col(vector)))


def knn(vectors: DataFrame, query: list[float], k: int, key: list[str], vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The k rows of the greatest product; filters come before scoring, ties go to the smaller key."""
    rows = vectors if where is None else vectors.where(where)
    return scored(rows, query, vector).where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), *key).limit(k)


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, key: list[str], query_key: str, vector: str = "vector", query_vector: str = "query_vector", most: int = 10_000) -> DataFrame:
    """The k nearest rows of every query vector.

    The queries are a stated set (at most ``most``), multiplied in blocks with the rows where these are;
    each batch of rows passes on k of each query.
    """
    got = bounded(queries.select(query_key, query_vector), most, "query vectors")
    ids = [r[0] for r in got]
    q = np.array([r[1] for r in got], np.float64).reshape(len(got), -1)
    kinds = dict(vectors.dtypes)
    schema = f"{query_key} {dict(queries.dtypes)[query_key]}, " + ", ".join(f"{c} {kinds[c]}" for c in key) + ", similarity double"

    def run(batches):
        for b in batches:
            b = b[b[vector].map(lambda v: v is not None and len(v) == q.shape[1])] if len(got) else b[:0]
            if not len(b):
                continue
            b = b.sort_values(key)
            s = np.stack(b[vector].to_numpy()).astype(np.float64) @ q.T
            n = min(k, len(b))
            top = np.argsort(-s, axis=0, kind="stable")[:n].T  # queries x n, one frame for all of them
            part = b[key].iloc[top.ravel()].reset_index(drop=True)
            yield part.assign(**{query_key: np.repeat(np.array(ids), n), "similarity": s.T[np.repeat(np.arange(len(ids)), n), top.ravel()]})[[query_key, *key, "similarity"]]

    found = vectors.select(*key, vector).mapInPandas(run, schema)
    order = Window.partitionBy(query_key).orderBy(F.desc("similarity"), *key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_per_file(hits: DataFrame, file: str = "file_id") -> DataFrame:
    return hits.groupBy(file).agg(F.max("similarity").alias("similarity"))


def mean_vectors(vectors: DataFrame, file: str = "file_id", vector: str = "vector", hold: int = 20_000) -> DataFrame:
    """``file, vector``: the mean of a file's vectors at unit length.

    Sums are formed in the tasks, as one array per file, before these are shuffled. Null vectors and such
    with nulls don't count; of a file's vectors of several lengths those of the most frequent one do (ties:
    the longer). A sum of no length stays zero.
    """
    kind = dict(vectors.dtypes)[file]

    def summed(batches, last: bool):
        import pyarrow as pa

        def made(held: dict):
            keys = list(held)
            if last:
                best: dict = {}
                for f, size in keys:
                    if f not in best or (held[f, size][0], size) > (held[f, best[f]][0], best[f]):
                        best[f] = size
                keys = list(best.items())
            sums = [held[k][1] for k in keys]
            if last:
                sums = [s / (float(np.sqrt(s @ s)) or 1.0) for s in (x / held[k][0] for k, x in zip(keys, sums))]
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], files), pa.array([held[k][0] for k in keys], pa.int64()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], ["file", "n", "sum"])

        held: dict = {}
        files = None
        for batch in batches:
            files = batch.schema.field(0).type
            for f, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                # sorted by file when summed last: a file is complete when the next begins
                if last and held and (f,) != (next(reversed(held))[0],) and len(held) >= 1000:
                    yield made(held)
                    held = {}
                if v is None or None in v:
                    continue
                x = np.asarray(v, np.float64)
                before = held.get((f, len(x)))
                held[f, len(x)] = (n, x) if before is None else (before[0] + n, before[1] + x)
                if not last and len(held) >= hold:
                    yield made(held)
                    held = {}
        if held:
            yield made(held)

    schema = f"file {kind}, n bigint, sum array<double>"
    parts = vectors.select(F.col(file).alias("file"), F.lit(1).cast("bigint").alias("n"), F.col(vector).cast("array<double>").alias("sum")).mapInArrow(lambda b: summed(b, False), schema)
    means = parts.repartition("file").sortWithinPartitions("file").mapInArrow(lambda b: summed(b, True), schema)
    return means.select(F.col("file").alias(file), F.col("sum").alias("vector"))


def match_share(similarity: Column) -> Column:
    """A query's similarity as a share between what is unrelated and what is as good as it gets."""
    return F.least(F.greatest((similarity - 0.55) / 0.27, F.lit(0.0)), F.lit(1.0))


def neighbour_radius(similarity: Column) -> Column:
    return F.least(F.greatest((0.95 - similarity) / 0.40, F.lit(0.02)), F.lit(1.2))


def related_weights(rows: DataFrame, closest: int = 6) -> DataFrame:
    """Rows by similarity with weight 1 for the first down to 0, and the closest marked; ranked by ranges."""
    ranked = number_rows(rows.select("file_id", "similarity"), F.desc("similarity"), "file_id")
    n = ranked.count()
    i = F.col("n") - 1
    return ranked.select("file_id", "similarity", (1 - i / F.lit(max(n - 1, 1))).alias("weight"), (i < closest).alias("close"))


def nth_value(rows: DataFrame, value: str, n: int, buckets: int = 4096, few: int = 10_000) -> float | None:
    """The n-th smallest value (from 0), found by counts in ever narrower buckets; few rows reach the driver."""
    x = rows.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    while True:
        low, high, size = x.agg(F.min("x"), F.max("x"), F.count("*")).collect()[0]
        if not size or n >= size:
            return None
        if size <= few:
            return sorted(r[0] for r in bounded(x, few, "values"))[n]
        if low == high:
            return low
        step = F.least(F.floor((F.col("x") - low) / ((high - low) / buckets)), F.lit(buckets - 1))
        counts = dict(map(tuple, bounded(x.groupBy(step.alias("b")).agg(F.count("*")), buckets, "buckets")))
        for b in sorted(counts):
            if n < counts[b]:
                x = x.where(step == b)
                break
            n -= counts[b]


def dimension_scale(rows: DataFrame, component: str) -> float | None:
    """The element at floor(0.95 n) of a component's sorted absolute values."""
    x = rows.select(F.abs(F.col(component)).alias("x")).where(F.col("x").isNotNull())
    return nth_value(x, "x", int(x.count() * 0.95))


