"""Vectors of texts, by a model that is given or by a stand-in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

DIM = 256
QUERY_PROMPT = "task: search result | query: "


def stand_in(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Vectors without a model: each word's own pseudo-random direction, added up. The same on every machine."""
    out = np.zeros((len(texts), dim), np.float32)
    cache: dict[str, np.ndarray] = {}
    for i, t in enumerate(texts):
        for w in t.lower().split():
            if w not in cache:
                seed = int.from_bytes(hashlib.sha1(w.encode("utf-8", "surrogatepass")).digest()[:8], "big")
                cache[w] = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
            out[i] += cache[w]
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n == 0, 1, n)


def runs(lengths: list[int], budget: int) -> list[tuple[int, int]]:
    """Batches of texts sorted longest first, such that rows times the longest stay within a budget."""
    out, start = [], 0
    while start < len(lengths):
        end = start + 1
        while end < len(lengths) and (end + 1 - start) * lengths[start] <= budget:
            end += 1
        out.append((start, end))
        start = end
    return out


def robust(model: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[np.ndarray | None]:
    """The model's vectors; a batch that fails is halved until the text that makes it fail is alone (null)."""
    if not texts:
        return []
    try:
        return list(model(texts))
    except Exception:
        if len(texts) == 1:
            return [None]
        half = len(texts) // 2
        return robust(model, texts[:half]) + robust(model, texts[half:])


def embed(rows: DataFrame, text: str, model: Callable[[list[str]], np.ndarray] = stand_in, dim: int = DIM, budget: int = 65_536) -> DataFrame:
    """Rows with ``vector`` (cut to ``dim`` and brought to unit length) and ``embed_error``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t or "" for t in s]
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            got: list = [None] * len(texts)
            for a, z in runs([max(1, len(texts[i])) for i in order], budget):
                for i, v in zip(order[a:z], robust(model, [texts[i] for i in order[a:z]])):
                    if v is not None:
                        v = np.asarray(v, np.float32)[:dim]
                        n = float(np.linalg.norm(v))
                        got[i] = (v / n if n else v).tolist()
            yield pd.Series(got, index=s.index)

    out = rows.withColumn("vector", apply(F.col(text)))
    return out.withColumn("embed_error", F.when(F.col("vector").isNull(), "!embed_failed"))


def picture_size(h: Column, w: Column, step: int = 48, most: int = 1260 * 16 * 16) -> tuple[Column, Column]:
    """Height and width of a picture for a model that sees whole steps of pixels and only so many in all."""
    scale = F.sqrt(F.lit(float(most)) / (h * w))
    fit = lambda x: F.greatest(F.floor(x * scale / step) * step, F.lit(step))
    return fit(h), fit(w)
