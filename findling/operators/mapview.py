"""A map of the collection: few dimensions of files' mean vectors, kept stable between runs.

The number of points on a map is bounded (``MOST``); a sample is chosen by a hash of the id, so that it
stays the same while files come and go. Sums over all vectors are formed where these are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from findling.operators.sums import tree_sum
from findling.operators.vector import nth_value

MOST, LEAST_TSNE, EDGE, QUANTILE = 6000, 150, 1.15, 0.98
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@F.pandas_udf(T.DecimalType(20, 0))
def sample_key(ids: pd.Series) -> pd.Series:
    """An id times the golden ratio's 64 bits, wrapping around: an order that looks random and never changes."""
    from decimal import Decimal

    with np.errstate(over="ignore"):
        return pd.Series([Decimal(int(x)) for x in ids.to_numpy().astype(np.uint64) * GOLDEN])


def sample(rows: DataFrame, key: str = "file_id", most: int = MOST) -> DataFrame:
    return rows.orderBy(sample_key(F.col(key)), key).limit(most)


def moments(rows: DataFrame, vector: str, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all vectors; a task hands on (dim + 1) x dim numbers, added up as a tree."""

    def partial(batches):
        n, total = 0, np.zeros((dim + 1, dim))
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None and len(v) == dim], np.float64).reshape(-1, dim)
            n += len(x)
            total[0] += x.sum(0)
            total[1:] += x.T @ x
        return n, total

    n, total = tree_sum(rows.select(vector), partial, (dim + 1, dim))
    if not n:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    mean = total[0] / n
    return n, mean, total[1:] / n - np.outer(mean, mean)


def principal(rows: DataFrame, vector: str, dim: int, k: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components): the directions of most variance; each one's largest loading is positive."""
    _, mean, cov = moments(rows, vector, dim)
    values, vectors = np.linalg.eigh(cov)
    comps = vectors[:, np.argsort(-values)[:k]].T
    sign = np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])
    return mean, comps * np.where(sign == 0, 1, sign)[:, None]


def project(rows: DataFrame, vector: str, mean: np.ndarray, comps: np.ndarray, names: list[str]) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def apply(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or len(x) != len(mean) else list((np.asarray(x, np.float64) - mean) @ comps.T))

    out = rows.withColumn("__p", apply(F.col(vector)))
    return out.select(*rows.columns, *[F.element_at("__p", i + 1).alias(n) for i, n in enumerate(names)])


def _quantile(rows: DataFrame, value: str, share: float) -> float | None:
    """A quantile between its two neighbours in order, found by counts."""
    n = rows.where(F.col(value).isNotNull()).count()
    if not n:
        return None
    at = share * (n - 1)
    low = nth_value(rows, value, int(at))
    high = nth_value(rows, value, min(int(at) + 1, n - 1)) if at > int(at) else low
    return low + (high - low) * (at - int(at))


def fit(rows: DataFrame, coords: list[str]) -> DataFrame:
    """Centred, scaled by the 0.98 quantile of all points' distances, clamped."""
    means = rows.agg(*[F.avg(c).alias(f"__{c}") for c in coords])
    x = rows.crossJoin(F.broadcast(means))  # one row
    for c in coords:
        x = x.withColumn(c, F.col(c) - F.col(f"__{c}"))
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in coords[1:]), F.col(coords[0]) * F.col(coords[0])))
    y = x
    q = F.lit(_quantile(x.select(size.alias("size")), "size", QUANTILE) or 1.0)
    clamp = lambda c: F.greatest(F.least(F.col(c) / q, F.lit(EDGE)), F.lit(-EDGE))
    return y.select(*[clamp(c).alias(c) if c in coords else F.col(c) for c in rows.columns])


def align(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """New points turned, mirrored and scaled onto the old ones (same rows); at least four are needed."""
    return align_by(new, np.ones(len(new), bool), old)


def align_by(new: np.ndarray, same: np.ndarray, old: np.ndarray) -> np.ndarray:
    """All new points turned, mirrored and scaled by what brings the rows ``same`` onto their old places."""
    if same.sum() < 4:
        return new
    centre = new[same].mean(0)
    a, b = new[same] - centre, old - old.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    total = (a * a).sum()
    return (new - centre) @ (u @ vt) * (s.sum() / total if total > 0 else 1) + old.mean(0)


def place(vectors: np.ndarray, known: np.ndarray, coords: np.ndarray, ids: np.ndarray, nearest: int = 8, tau: float = 0.02, jitter: float = 0.015) -> np.ndarray:
    """Coordinates of new vectors: their nearest known ones' weighted mean, with a spread that hangs on the id."""
    sims = vectors @ known.T
    k = min(nearest, known.shape[0])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sims, top, 1)
    w = np.exp((s - s.max(1, keepdims=True)) / tau)
    w /= w.sum(1, keepdims=True)
    base = (coords[top] * w[:, :, None]).sum(1)
    return base + np.stack([np.random.default_rng(int(i) & 0xFFFFFFFF).normal(0, jitter, coords.shape[1]) for i in ids]) if jitter else base


def tsne(x: np.ndarray, perplexity: float = 30, epochs: int = 400, seed: int = 1, dims: int = 3) -> np.ndarray:
    """t-distributed neighbour embedding of a bounded number of points (at most ``MOST``)."""
    n = len(x)
    if n > MOST:
        raise ValueError(f"at most {MOST} points")
    perplexity = min(perplexity, max(2.0, (n - 1) / 3))
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
    p = np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        row = np.delete(d[i], i)
        row = row - row.min()
        for _ in range(40):
            e = np.exp(-row * beta)
            h = np.log(e.sum()) + beta * (row * e).sum() / e.sum()
            if abs(h - np.log(perplexity)) < 1e-4:
                break
            lo, hi = (beta, hi) if h > np.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i, np.arange(n) != i] = e / e.sum()
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, dims))
    step, gain = np.zeros_like(y), np.ones_like(y)
    for t in range(epochs):
        q = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        m = (p * (12 if t < 100 else 1) - q / q.sum()) * q
        g = 4 * (m.sum(1)[:, None] * y - m @ y)
        gain = np.maximum(np.where(np.sign(g) == np.sign(step), gain * 0.8, gain + 0.2), 0.01)
        step = (0.5 if t < 100 else 0.8) * step - max(n / 12, 50) * gain * g
        y = y + step
        y -= y.mean(0)
    return y


def stale(layout: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, state`` of a layout against the files: kept (same mtime and size), moved, gone, or new."""
    old = layout.groupBy("file_id").agg(F.max(F.struct("mtime", "size")).alias("o"))
    now = files.where(F.col("status") == "indexed").select(F.col("id").alias("file_id"), F.struct("mtime", "size").alias("n"))
    state = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "gone").when((F.col("o.mtime") == F.col("n.mtime")) & (F.col("o.size") == F.col("n.size")), "kept").otherwise("moved")
    return old.join(now, "file_id", "full_outer").select("file_id", state.alias("state"))


def redo(kept: int, placed: int, rough: int) -> bool:
    """Whether a map must be made anew: too few points, too few kept, or too many only placed."""
    n = kept + placed
    return n < LEAST_TSNE or kept < 8 or rough + placed > 0.3 * n


