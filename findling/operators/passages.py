"""Passages of texts: overlapping windows, with pages and titles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from findling.functions import text as X

CHARS, OVERLAP, MOST, PAGE = 1500, 200, 300, "\f"


#: Where a passage may end, best first.
BREAKS = ("\n\n", "\n", ". ", " ")


def _end(text: str, at: int, chars: int) -> int:
    """Where the passage from ``at`` on ends: behind the last break that begins past half of it."""
    limit = at + chars
    if limit >= len(text):
        return len(text)
    past = at + chars // 2 + 1
    found = ((text.rfind(b, past, limit), len(b)) for b in BREAKS)
    return next((p + n for p, n in found if p >= 0), limit)


def windows(text: str, chars: int = CHARS, overlap: int = OVERLAP, most: int | None = None) -> list[tuple[int, str]]:
    """(start, passage) of a tidied text; the next passage begins behind the first space of the overlap.

    After ``most`` passages the rest of a text is left; None takes all of it.
    """
    out: list[tuple[int, str]] = []
    at = end = 0
    while end < len(text) and (most is None or len(out) < most):
        end = _end(text, at, chars)
        if body := text[at:end].strip():
            out.append((at, body))
        back = end - overlap
        at = max(text.find(" ", back, end) + 1 or back, at + 1)
    return out


def chunk(rows: DataFrame, key: list[str], text: str = "text", chars: int = CHARS, overlap: int = OVERLAP, most: int | None = None) -> DataFrame:
    """``key…, chunk, start, text, page``: the passages of every text. Form feeds mark pages and are taken out.

    Null and blank texts have none.
    """

    @F.pandas_udf("array<struct<start: int, text: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "text": p} for a, p in windows(t, chars, overlap, most)] if t else [])

    tidied = rows.select(*key, X.tidy(F.col(text)).alias("t"))
    pieces = tidied.select(*key, "t", F.posexplode(cut("t")).alias("chunk", "p"))
    before = F.substring("t", F.lit(1), F.col("p.start"))
    marks = F.length(before) - F.length(F.replace(before, F.lit(PAGE), F.lit("")))
    return pieces.select(*key, "chunk", F.col("p.start").alias("start"), F.replace(F.col("p.text"), F.lit(PAGE), F.lit("")).alias("text"), F.greatest(marks + 1, F.lit(1)).alias("page"))


def embedded_text(title: Column, text: Column) -> Column:
    """What a model gets of a passage."""
    return F.concat(F.lit("title: "), title, F.lit(" | text: "), text)


def backfill_pages(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """Passages without a page get it by (file_id, chunk); 0 where the new reading counts other passages."""
    old = passages.groupBy("file_id").agg(F.count("*").alias("n_old"))
    new = pages.groupBy("file_id").agg(F.count("*").alias("n_new"))
    fit = old.join(new, "file_id").select("file_id", (F.col("n_old") == F.col("n_new")).alias("fits"))
    found = pages.select("file_id", "chunk", F.col("page").alias("found"))
    joined = passages.join(fit, "file_id", "left").join(found, ["file_id", "chunk"], "left")
    page = F.coalesce("page", F.when(F.col("fits"), F.coalesce("found", F.lit(0))).when(F.col("fits").isNotNull(), F.lit(0)))
    return joined.withColumn("page", page).drop("fits", "found")
