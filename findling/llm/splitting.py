"""Splitting oversized texts by content-defined chunking.

A gear hash rolls over the characters; where its low bits vanish lies a landmark, which depends on nothing
but the few characters before it. After a cut the next landmark at least ``minimum`` and at most
``size - overlap`` characters on is taken and moved to the nearest natural boundary: a page or paragraph
break, else a line end, a sentence end, a space; of these the best within ``reach`` counts. As cuts hang on
local content only, an edit changes the pieces around it and the cuts further on fall into step again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from findling.llm.arrow import map_rows

SIZE, OVERLAP, MINIMUM, REACH, SNIPPET = 1500, 200, 900, 160, 160
WINDOW = 24
#: What is taken off at both ends of a text.
OUTER = " \t\r\n\f\u00a0"
#: Kinds of boundaries from best to worst; a cut falls behind the match.
BOUNDARIES = (
    re.compile(r"\f|\r?\n[ \t]*(?:\r?\n[ \t]*)+"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…:;][\"'”“»)\]]*[ \t\u00a0]+"),
    re.compile(r"[ \t\u00a0]+"),
)


def gear(codes: np.ndarray) -> np.ndarray:
    """The rolling hash at every position: a shifted sum of mixed code points over the last WINDOW."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        h = x.copy()
        for k in range(1, min(WINDOW, len(x))):
            h[k:] += x[:-k] << np.uint64(k)
    h ^= h >> np.uint64(29)
    return h


def boundary_lists(text: str) -> list[np.ndarray]:
    return [np.fromiter((m.end() for m in b.finditer(text)), dtype=np.int64) for b in BOUNDARIES]


def _between(sorted_: np.ndarray, low: int, high: int) -> np.ndarray:
    return sorted_[np.searchsorted(sorted_, low) : np.searchsorted(sorted_, high, side="right")]


def cuts(text: str, size: int = SIZE, overlap: int = OVERLAP, minimum: int = MINIMUM, reach: int = REACH) -> list[int]:
    """Where pieces end, the text's end included."""
    step = size - overlap  # a piece begins up to ``overlap`` before the last cut
    if len(text) <= size:
        return [len(text)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = gear(codes)
    minimum = max(1, min(minimum, step))
    strong = np.flatnonzero(h & np.uint64(0x7F) == 0) + 1
    weak = np.flatnonzero(h & np.uint64(0x0F) == 0) + 1
    natural = boundary_lists(text)
    out, at = [], 0
    while len(text) - at > (step if out else size):
        # the first piece has no overlap before it, but keeps to the same steps, so that cuts don't hang on it
        low, high = at + minimum, at + step
        marks = _between(strong, low, high)
        if not len(marks):
            marks = _between(weak, low, high)
        mark = int(marks[0]) if len(marks) else low + int(np.argmin(h[low - 1 : high]))
        cut = None
        for width in (reach, step):
            for kind in natural:
                near = _between(kind, max(low, mark - width), min(high, mark + width))
                if len(near):
                    cut = int(near[np.argmin(np.abs(near - mark))])
                    break
            if cut is not None:
                break
        at = cut if cut is not None else mark
        out.append(at)
    out.append(len(text))
    return out


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP, minimum: int = MINIMUM, reach: int = REACH) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces: each at most ``size``, together the whole text.

    Each piece but the first begins ``overlap`` before the last cut, moved forward to the next word's start
    where one begins in the overlap; so no piece begins inside a word unless the text has no space there.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    out, start = [], 0
    for end in cuts(text, size, overlap, minimum, reach):
        out.append((start, end))
        start = max(0, end - overlap)
        space = re.compile(r"\s+").search(text, start, end)
        if space and space.end() < end and start and not text[start - 1].isspace():
            start = space.end()
    return out


def split_texts(
    rows: DataFrame, key: list[str], text: str = "text", page: str = "page", size: int = SIZE, overlap: int = OVERLAP,
    minimum: int = MINIMUM, reach: int = REACH, keep_small: bool = True,
) -> DataFrame:
    """``key…, piece, pieces, start_at, end_at, page, snippet, text`` of every row's text.

    Texts are taken without outer white space; ``text`` of all pieces, each from the last one's ``end_at``
    on, is that text again. A text within ``size`` is one piece (left out if ``keep_small`` is false); a
    null or blank text is one piece of length 0 with a null text. ``page`` is the row's page plus the form
    feeds before the piece's start; null and 0 (unknown) stay. The snippet is the piece's first 160
    characters. Repeated rows are split alike, each for itself; other columns aren't carried.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in key) + ", piece int, pieces int, start_at int, end_at int, page bigint, snippet string, text string"

    def fn(c: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in [*key, "piece", "pieces", "start_at", "end_at", "page", "snippet", "text"]}
        for i, raw in enumerate(c["__text"]):
            t = (raw or "").strip(OUTER)
            spans = pieces(t, size, overlap, minimum, reach)
            if len(spans) == 1 and not keep_small:
                continue
            base = c["__page"][i]
            for n, (a, b) in enumerate(spans):
                for k in key:
                    out[k].append(c[f"__key_{k}"][i])
                s = t[a:b]
                out["piece"].append(n)
                out["pieces"].append(len(spans))
                out["start_at"].append(a)
                out["end_at"].append(b)
                out["page"].append(base + t.count("\f", 0, a) if base else base)
                out["snippet"].append(s[:SNIPPET] if s else None)
                out["text"].append(s or None)
        return out

    narrow = rows.select(*[F.col(k).alias(f"__key_{k}") for k in key], F.col(text).alias("__text"), F.col(page).cast("long").alias("__page"))
    return map_rows(narrow, fn, schema, slice_rows=500)


def stripped_length(text) -> F.Column:
    """Code points of a text without outer white space."""
    return F.char_length(F.trim(text, F.lit(OUTER)))


def valid_long_passages(passages: DataFrame, size: int = SIZE) -> DataFrame:
    """The valid rows (greatest ``indexed_at`` of a (file_id, chunk)) whose text is over ``size``.

    Which row is valid is found on narrow columns, pre-aggregated; only long texts are shuffled. Equal
    ``indexed_at``: the longer text, then the one of greater hash, is valid; exact copies count once.
    """
    p = passages.select("file_id", "chunk", "indexed_at", "page", "text").withColumn("n", F.coalesce(stripped_length(F.col("text")), F.lit(0)))
    p = p.withColumn("mark", F.when(F.col("n") > size, F.xxhash64("text", "page")).otherwise(F.lit(0)))
    rank = F.struct(F.col("indexed_at").alias("a"), F.col("n").alias("b"), F.col("mark").alias("c"))
    best = p.groupBy("file_id", "chunk").agg(F.max(rank).alias("best")).where(F.col("best.b") > size)
    long_ = p.where(F.col("n") > size).alias("l")
    b = best.alias("b")
    return (
        long_.join(
            b,
            F.col("l.file_id").eqNullSafe(F.col("b.file_id")) & F.col("l.chunk").eqNullSafe(F.col("b.chunk"))
            & F.col("l.indexed_at").eqNullSafe(F.col("best.a")) & (F.col("l.n") == F.col("best.b")) & (F.col("l.mark") == F.col("best.c")),
            "left_semi",
        )
        .select("l.file_id", "l.chunk", "l.page", "l.text")
        .dropDuplicates(["file_id", "chunk"])
    )
