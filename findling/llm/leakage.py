"""Evaluation items that leaked into documents, by latent semantic retrieval and alignment.

1. Words are folded (case, marks, transliterations, markup, hyphenation) and mapped to the terms of the
   evaluation items; a longer word one edit away from a term counts as the term. Other words weigh nothing
   in the product with an item, so the term space is that of the items, whatever the corpus holds.
2. Documents are cut into overlapping passages, rows of a TF-IDF matrix whose document frequencies are
   counted over all documents. Every term keeps some weight, as an item that leaked often makes its own
   words common.
3. A randomised SVD: each task multiplies its passages with random vectors and back, the sums give a basis
   (with the items as weighted rows, so that the space keeps what tells items apart), a second pass gives
   the small matrix whose eigenvectors turn the basis into singular vectors. What leaves a task is
   terms x dimensions numbers, bounded by the items and a parameter, not by the corpus.
4. Candidates of an item are all documents that hold as many of its neighbouring words as neighbours as the
   weakest alignment that counts must have, wherever in the document they stand; no threshold of similarity
   comes before. The similarity given is the greatest cosine of a passage with the item in the latent space.
5. A candidate is checked by alignment: the longest common subsequence in up to two dense pieces, with
   substitutions, insertions and gaps costing one. Copies hold at least about half of the item's words so;
   weaker alignments count as paraphrases where the item's answer stands in the document, too, and either
   their rare words match or a passage is near to the item in the latent and the full term space.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from findling.operators.sums import tree_sum
from findling.session import bounded, stored

WINDOW, DIMENSIONS, OVERSAMPLING, COSINE, EXACT = 56, 112, 16, 0.64, 0.40
#: An item counts as held from these shares of its words on (net of what differs; spanned by the pieces).
NET, SPAN, PARAPHRASE = 0.36, 0.465, 0.25
#: Words of at least so much of an item's greatest weight count as rare, and this share of them must match.
RARE, RARE_SHARE = 0.6, 0.5
MOST_ITEMS = 100_000
WIDE = np.int64(1) << np.int64(32)
WORD = re.compile(r"\w+")  # underscores are markup and gone by then
MARKUP = re.compile(r"<[^<>\n]{1,30}>|[*_`]+|[­​‌‍﻿]")
PLAIN = "<*_`\u00ad\u200b\u200c\u200d\ufeff"
HYPHEN = re.compile(r"(\w)-[ \t]*\r?\n[ \t>|]*(\w)")


def fold(word: str) -> str:
    w = word.lower().replace("ß", "ss")
    if not w.isascii():
        w = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    return w.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def unmarked(text: str) -> str:
    if "-\n" in text or "-\r\n" in text:
        text = HYPHEN.sub(r"\1\2", text)
    if any(c in text for c in PLAIN):
        text = MARKUP.sub("", text)
    return text


def words(text: str) -> list[str]:
    return WORD.findall(unmarked(text))


class Memo(dict):
    """What a function gave; it is cleared at ``most`` entries, and keys longer than ``length`` aren't kept."""

    def __init__(self, of: Callable, most: int, length: int = 40):
        super().__init__()
        self.of, self.most, self.length = of, most, length

    def __missing__(self, key: str):
        got = self.of(key)
        if len(key) <= self.length:
            if len(self) >= self.most:
                self.clear()
            self[key] = got
        return got


class Terms:
    """The items' terms, and words as terms."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], memo: int = 200_000):
        self.ids: dict[str, int] = {}
        self.item_ids = [i for i, _, _ in items]
        self.items = [np.array([self.ids.setdefault(fold(w), len(self.ids)) for w in words(t or "")], np.int32) for _, t, _ in items]
        self.answers = [np.array([self.ids.setdefault(fold(w), len(self.ids)) for w in words(a or "")], np.int32) for _, _, a in items]
        self.near: dict[str, int] = {}
        for w, k in self.ids.items():
            if len(w) >= 5 and w.isalpha():
                self.near.setdefault(w, k)
                for p in range(len(w)):
                    self.near.setdefault(w[:p] + w[p + 1 :], k)
        self.memo, self._seen, self._parts = memo, None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": None, "_parts": None}

    def __len__(self) -> int:
        return max(1, len(self.ids))

    def term(self, word: str) -> int:
        w = fold(word)
        got = self.ids.get(w, -1)
        if got < 0 and len(w) >= 5 and w.isalpha():
            got = self.near.get(w, -1)
            for p in range(len(w) if got < 0 else 0):
                got = self.near.get(w[:p] + w[p + 1 :], -1)
                if got >= 0:
                    break
        return got

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self._parts is None:
            self._seen = seen = Memo(self.term, self.memo)
            self._parts = Memo(lambda part: tuple(map(seen.__getitem__, WORD.findall(part))), self.memo)
        # no word holds white space, so what stands between is looked up as a whole
        return np.fromiter(chain.from_iterable(map(self._parts.__getitem__, unmarked(text).split())), np.int32)


def passages(ids: list[np.ndarray], weight: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, row, term, value) of the passages' unit TF-IDF vectors; rows are sorted, ``document`` is by row.

    A passage takes ``window`` words and begins half a window after the one before.
    """
    step = max(1, window // 2)
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(ids)), lengths)
    slot = (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // step
    rows_of = np.maximum(1, -(-lengths // step))  # half windows of each document
    first = np.cumsum(rows_of) - rows_of
    keep = flat >= 0
    keep[keep] = weight[flat[keep]] > 0
    t, r, s = flat[keep].astype(np.int64), first[doc[keep]] + slot[keep], slot[keep]
    back = s > 0
    n_terms = len(weight)
    key = np.concatenate([r * n_terms + t, (r[back] - 1) * n_terms + t[back]])
    key, tf = np.unique(key, return_counts=True)
    row, term = key // n_terms, key % n_terms
    value = (np.minimum(tf, 2) * weight[term]).astype(np.float32)
    if len(row):
        used, at = np.unique(row, return_index=True)
        size = np.sqrt(np.add.reduceat(value * value, at))
        value /= np.repeat(size, np.diff(np.append(at, len(row))))
        row = np.repeat(np.arange(len(used)), np.diff(np.append(at, len(row))))
        document = np.repeat(np.arange(len(ids)), rows_of)[used]
    else:
        document = np.zeros(0, np.int64)
    return document, row, term, value


class Rows:
    """Sparse rows (sorted by row), as many as there are, over the terms."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int | None = None):
        self.n = (int(row[-1]) + 1 if len(row) else 0) if n is None else n
        self.row, self.term, self.value = row, term, value.astype(np.float32)
        self.starts = np.searchsorted(row, np.arange(self.n + 1))

    def blocks(self, rows: int = 128) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, terms that occur, dense rows over these): narrow however many terms there are."""
        for a in range(0, self.n, rows):
            lo, hi = self.starts[a], self.starts[min(a + rows, self.n)]
            terms, at = np.unique(self.term[lo:hi], return_inverse=True)
            m = np.zeros((min(rows, self.n - a), len(terms)), np.float32)
            m[self.row[lo:hi] - a, at] = self.value[lo:hi]
            yield a, terms, m

    def times(self, x: np.ndarray) -> np.ndarray:
        """The rows times a matrix of terms x columns."""
        out = np.zeros((self.n, x.shape[1]), np.float32)
        for a, terms, m in self.blocks():
            out[a : a + len(m)] = m @ x[terms]
        return out

    def turned_times(self, x: np.ndarray) -> np.ndarray:
        """The rows turned, times the rows, times a matrix of terms x columns."""
        out = np.zeros(x.shape, np.float64)
        for _, terms, m in self.blocks():
            out[terms] += m.T @ (m @ x[terms])
        return out


def align(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int, int, int, list[int]]:
    """Best local alignment: (score, from and to in the item, from and to in the document, the item's words that match)."""
    n, m = len(item), len(doc)
    # each score plus its place in the document: a gap along the row, which costs one a word, then costs nothing
    kind = np.int16 if m + n < 32_000 else np.int32
    at = np.arange(m + 1, dtype=kind)
    s = np.empty((n + 1, m + 1), kind)
    s[0] = at
    same_words = (item.astype(np.int32)[:, None] == doc.astype(np.int32)[None, :]).astype(kind) * kind(2)
    for i in range(1, n + 1):
        above, row = s[i - 1], s[i]
        row[0] = 0
        np.add(above[:-1], same_words[i - 1], out=row[1:])
        np.maximum(row[1:], above[1:] - kind(1), out=row[1:])
        np.maximum(row, at, out=row)
        np.maximum.accumulate(row, out=row)
    i, j = np.unravel_index(int((s - at).argmax()), s.shape)
    i, j = int(i), int(j)
    best, ei, ej, matches = float(s[i, j]) - j, i, j, []
    while i and j and s[i, j] > j:
        same = item[i - 1] == doc[j - 1]
        if s[i - 1, j - 1] + (2 if same else 0) == s[i, j]:
            if same:
                matches.append(i - 1)
            i, j = i - 1, j - 1
        elif s[i - 1, j] - 1 == s[i, j]:
            i -= 1
        else:
            j -= 1
    return best, i, ei, j, ej, matches


def dense_regions(doc: np.ndarray, inside: np.ndarray, width: int = 12, least: int = 5) -> np.ndarray:
    """The document's words near ``width`` words of which ``least`` are the item's; the rest is one break each.

    A piece that scores 4 with one off for every word that differs holds such a place, so none is lost.
    """
    n = len(doc)
    c = np.zeros(n + width + 1, np.int32)  # words of the item before each word, and beyond the end
    np.cumsum(inside, out=c[1 : n + 1])
    c[n + 1 :] = c[n]
    full = c[width : width + n] - c[:n] >= min(least, max(1, n // 2))
    # a word is kept where a full place begins in the 2 * width words up to it or in the width words after it
    h = np.zeros(n + 3 * width, np.int32)
    np.cumsum(full, out=h[2 * width : 2 * width + n])
    h[2 * width + n :] = h[2 * width + n - 1]
    keep = h[3 * width :] > h[:n]
    out = np.where(keep, doc, -2)
    return out[keep | np.concatenate([[False], keep[:-1]])]


def stretches(good: np.ndarray, inside: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(from, to) of the document's words that can lie in a piece that scores ``least``; no such piece is cut.

    ``good`` says of neighbours whether they are the item's, too, ``inside`` of words whether the item has them. Of the L - 1
    pairs of neighbours in a piece of L words, every one that isn't good takes a word of the item that is left out or a
    word of the document that differs, which two pairs share at most; both words of two that the item hasn't differ. With u
    that differ and v left out the score is L - 2u - v, so it is at most one more than the sum of 1 for each good pair less
    1 for each pair of words that the item hasn't.
    """
    c = np.zeros(len(inside), np.int32)
    np.cumsum(good.astype(np.int8) - ~(inside[:-1] | inside[1:]), out=c[1:])
    best = np.maximum.accumulate(c[::-1])[::-1] - np.minimum.accumulate(c) + 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], best >= least, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def align_within(item: np.ndarray, doc: np.ndarray, parts: list[tuple[int, int]]) -> tuple[float, int, int, int, int, list[int]] | None:
    """The best alignment with one of the document's parts; of equal ones that which ends first in the item, then in the document."""
    best = None
    for start, end in parts:
        score, a, b, c, d, matches = align(item, doc[start:end])
        if best is None or (score, -b) > (best[0], -best[2]):
            best = score, a, b, c + start, d + start, matches
    return best


class Signs:
    """The items' neighbouring words, and which items have them; of items too short for a bound on those, their words.

    ``held`` gives 0 below ``least * n - 2`` neighbours and below ``least * n`` words, so no pair it accepts is missed.
    """

    def __init__(self, items: list[np.ndarray], least: float = PARAPHRASE):
        pairs = [least * len(x) > 2 for x in items]
        self.words = not all(pairs)
        self.lengths, self.spare = np.array([len(x) for x in items]), 2 * np.array(pairs, int)
        self.need = least * self.lengths - self.spare
        keys = [(x[:-1] + np.int64(1)) * WIDE + x[1:] if p else x.astype(np.int64) for x, p in zip(items, pairs)]
        of = np.repeat(np.arange(len(items)), [len(k) for k in keys])
        flat = np.concatenate([*keys, np.zeros(0, np.int64)])
        order = np.lexsort((of, flat))
        self.keys, first = np.unique(flat[order], return_index=True)
        self.first, self.items = np.append(first, len(flat)), of[order]

    def candidates(self, ids: list[np.ndarray], most: int = 4_000_000) -> Iterator[tuple[int, int, int]]:
        """(document, item, signs shared) of all pairs that share enough; an item's sign counts as often as the item has it."""
        n_items, block = len(self.need), 400
        for a in range(0, len(ids) if len(self.keys) else 0, block):
            part = ids[a : a + block]
            flat = np.concatenate(part).astype(np.int64)
            doc = np.repeat(np.arange(len(part)), [len(x) for x in part])
            ok = (flat[:-1] >= 0) & (flat[1:] >= 0) & (doc[:-1] == doc[1:])
            key, doc_of = (flat[:-1][ok] + 1) * WIDE + flat[1:][ok], doc[:-1][ok]
            if self.words:
                key, doc_of = np.concatenate([key, flat[flat >= 0]]), np.concatenate([doc_of, doc[flat >= 0]])
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            both = np.unique(doc_of[hit] * len(self.keys) + at[hit])
            d, at = both // len(self.keys), both % len(self.keys)
            times = self.first[at + 1] - self.first[at]
            # entries of a sign that very many items have are taken in portions of documents
            total, low = np.cumsum(times), 0
            while low < len(d):
                high = int(np.searchsorted(total, (total[low - 1] if low else 0) + most, side="right"))
                high = len(d) if high >= len(d) else max(int(np.searchsorted(d, d[high])), int(np.searchsorted(d, d[low], side="right")))
                n = times[low:high]
                entry = np.arange(n.sum()) + np.repeat(self.first[at[low:high]] - (np.cumsum(n) - n), n)
                pair, shared = np.unique(np.repeat(d[low:high], n) * n_items + self.items[entry], return_counts=True)
                enough = shared >= self.need[pair % n_items]
                for p, count in zip(pair[enough], shared[enough]):
                    yield a + int(p // n_items), int(p % n_items), int(count)
                low = high


class Shape:
    """What is asked of an item for every document: its words with their numbers, and its neighbours by places of words."""

    def __init__(self, item: np.ndarray):
        self.item = item.astype(np.int64)
        self.distinct, self.places, self.need = np.unique(self.item, return_inverse=True, return_counts=True)
        pairs = self.places[:-1] * len(self.distinct) + self.places[1:]
        self.pairs, self.times = np.unique(pairs, return_counts=True)


def held(item: np.ndarray | Shape, doc: np.ndarray, least: float = PARAPHRASE, weight: np.ndarray | None = None) -> tuple[float, float, float, float, int]:
    """(net, span, matched, rare, pieces): shares of the item's words in up to two pieces, in any order of the two.

    ``rare`` is the share of the pieces' weighty words that match: sentences built alike share the common
    ones only. All 0 where the words in dense places, in whatever order, or neighbours among them, are too few for a
    net share of ``least``, or the first piece is less than half of it.
    """
    shape = item if isinstance(item, Shape) else Shape(item)
    item, distinct, doc = shape.item, shape.distinct, doc.astype(np.int64)
    n = len(item)
    if not n or not len(doc):
        return 0.0, 0.0, 0.0, 0.0, 0
    at = np.minimum(np.searchsorted(distinct, doc), len(distinct) - 1)
    own = np.where(distinct[at] == doc, at, -1)  # the item's words by their places in ``distinct``
    doc = dense_regions(own, own >= 0)
    inside = doc >= 0
    there = np.bincount(doc[inside], minlength=len(distinct))
    if np.minimum(shape.need, there).sum() < least * n:
        return 0.0, 0.0, 0.0, 0.0, 0
    # m matches with e words off lie in at most e + 2 runs, so m - e - 2 of the item's neighbours are neighbours there
    good = inside[:-1] & inside[1:]
    if len(shape.pairs):
        both = np.flatnonzero(good)
        have = doc[both] * len(distinct) + doc[both + 1]
        at = np.minimum(np.searchsorted(shape.pairs, have), len(shape.pairs) - 1)
        same = shape.pairs[at] == have
        seen = np.zeros(len(shape.pairs), bool)
        seen[at[same]] = True
        if shape.times[seen].sum() < least * n - 2:
            return 0.0, 0.0, 0.0, 0.0, 0
        good[both] = same
    else:
        good[:] = False
    first = align_within(shape.places, doc, stretches(good, inside, least * n / 2))
    if first is None or 2 * first[0] < least * n:  # a second piece never scores more
        return 0.0, 0.0, 0.0, 0.0, 0
    score, a, b, c, d, matches = first
    pieces = [(score, a, b, matches)]
    if score >= 0.15 * n:
        doc[c:d], inside[c:d], good[max(0, c - 1) : d] = -2, False, False
        others = []
        parts = stretches(good, inside, 4)
        for shift, x in ((0, shape.places[:a]), (b, shape.places[b:])):
            if len(x) >= 4 and (got := align_within(x, doc, parts)):
                s2, a2, b2, _, _, m2 = got
                others.append((s2, a2 + shift, b2 + shift, [i + shift for i in m2]))
        second = max(others, key=lambda p: p[0], default=None)
        if second and second[0] >= 4:
            pieces.append(second)
    net, span = sum(p[0] for p in pieces) / n, sum(p[2] - p[1] for p in pieces) / n
    hit = [i for p in pieces for i in p[3]]
    rare = 1.0
    if weight is not None:
        w = weight[item]
        heavy = w >= RARE * max(float(w.max()), 1e-9)
        inside = np.concatenate([np.arange(p[1], p[2]) for p in pieces]) if pieces else np.zeros(0, int)
        total = int(heavy[inside].sum())
        rare = float(heavy[hit].sum()) / total if total else 0.0
    return net, span, len(hit) / n, rare, len(pieces)


def find_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", answer: str | None = "answer",
    window: int = WINDOW, dimensions: int = DIMENSIONS, cosine: float = COSINE, seed: int = 17,
) -> DataFrame:
    """``key, item_key, similarity, net, span, matched, pieces, answer_found, kind`` of documents that hold items.

    ``kind`` is copy (about half of the item's words or more, in order, in one or two pieces) or paraphrase
    (less, but the answer stands in the document, and rare words match or a passage is nearer than ``cosine``). Each copy of a document counts for itself; repeated rows
    come out once. Null and empty texts hold nothing; items without words are never found; empty tables
    give an empty result. The items (at most 100,000) are gathered at the driver, documents never.
    """
    spark = documents.sparkSession
    kind, item_kind = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    chosen = items.select(F.col(item_key), F.col(item_text), F.col(answer) if answer else F.lit(None).cast("string")).distinct()
    terms = Terms(sorted((tuple(r) for r in bounded(chosen, MOST_ITEMS, "evaluation items")), key=lambda r: (r[0] is None, r[0])))
    n_terms = len(terms)
    out_schema = f"`{key}` {kind}, `{item_key}` {item_kind}, similarity double, net double, span double, matched double, pieces int, answer_found boolean, kind string"
    if not any(len(x) for x in terms.items):
        return spark.createDataFrame([], out_schema)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = [terms.of(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "ids"])

    named = documents.select(F.col(key).alias("key"), F.col(text).alias("t"))
    tokens = stored(named.mapInArrow(tokenise, f"key {kind}, ids array<int>"), "terms")

    scans = tokens.rdd.getNumPartitions()  # of a table just written: planned, not run

    def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                lists = part.column(part.schema.get_field_index("ids"))
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                yield part, np.split(flat, (ends - ends[0])[1:-1]) if part.num_rows else []

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(n_terms + 1, np.int64), 0
        for _, ids in batches_of(batches, 2000):
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])[flat >= 0]
            df[: n_terms] += np.bincount(np.unique(doc * n_terms + flat[flat >= 0]) % n_terms, minlength=n_terms)[:n_terms]
            n += len(ids)
        df[n_terms] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms + 1, dtype=np.int32)), pa.array(df)], ["term", "n"])

    counted = tokens.select("ids").mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(n_terms + 1)
    for t, n in bounded(counted, n_terms + 1, "document frequencies"):
        df[t] = n
    n_docs, df = df[n_terms], df[:n_terms]
    weight = (np.log((n_docs + 1) / (df + 1)) + 0.1).astype(np.float32)
    has = [k for k, x in enumerate(terms.items) if (weight[x] > 0).any()]
    item_parts: list[tuple[np.ndarray, np.ndarray]] = []
    for x in terms.items:
        t, tf = np.unique(x, return_counts=True)
        v = np.minimum(tf, 2) * weight[t]
        item_parts.append((t, (v / max(float(np.linalg.norm(v)), 1e-9)).astype(np.float32)))
    item_rows = Rows(
        np.repeat(np.arange(len(item_parts)), [len(t) for t, _ in item_parts]), np.concatenate([t for t, _ in item_parts]).astype(np.int64),
        np.concatenate([v for _, v in item_parts]), len(item_parts),
    )

    def summed(partial: Callable[[Rows], np.ndarray], rows: int, columns: int) -> tuple[np.ndarray, int]:
        """The sum of ``rows x columns`` arrays that the tasks make of their passages."""

        def of_task(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray]:
            total, n = np.zeros((rows, columns)), 0
            for _, ids in batches_of(batches):
                _, row, term, value = passages(ids, weight, window)
                m = Rows(row, term, value)
                total += partial(m)
                n += m.n
            return n, total

        n, total = tree_sum(tokens.select("ids"), of_task, (rows, columns), tasks=scans)
        return total, n

    wide = min(dimensions + OVERSAMPLING, n_terms)
    omega = np.random.default_rng(seed).standard_normal((n_terms, wide)).astype(np.float32)
    z, n_rows = summed(lambda m: m.turned_times(omega), n_terms, wide)
    weigh = 4.0 * max(n_rows, 1) / max(len(has), 1)  # the items' share of the matrix stays the same at every size
    q, _ = np.linalg.qr(z + weigh * item_rows.turned_times(omega))
    # with the basis of the first pass, one more power step on the items sharpens it at no cost
    q, _ = np.linalg.qr(np.concatenate([q, item_rows.turned_times(q.astype(np.float32))], axis=1)[:, : 2 * wide] if n_terms >= 2 * wide else q)
    q = q[:, :wide].astype(np.float32)
    gram, _ = summed(lambda m: (y := m.times(q)).T @ y, q.shape[1], q.shape[1])
    y = item_rows.times(q).astype(np.float64)
    values, vectors = np.linalg.eigh(gram + weigh * (y.T @ y))
    basis = (q @ vectors[:, np.argsort(-values)[:dimensions]].astype(np.float32)).astype(np.float32)
    latent = item_rows.times(basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    latent[[k for k in range(len(latent)) if k not in set(has)]] = 0

    item_terms, answer_terms, item_ids = terms.items, terms.answers, terms.item_ids  # not the words, which are large to send
    signs, shapes = Signs(item_terms), [Shape(x) for x in item_terms]
    heavy_terms = [np.unique(x[weight[x] >= RARE * max(float(weight[x].max(initial=0)), 1e-9)]) for x in item_terms]

    def similarities(ids: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[tuple[float, bool]]:
        """Each pair's greatest cosine of a passage and the item, and whether one is near in both spaces."""
        chosen = sorted({d for d, _ in pairs})
        at = {d: n for n, d in enumerate(chosen)}
        best, near = [0.0] * len(pairs), [False] * len(pairs)
        doc_of, row, term, value = passages([ids[d] for d in chosen], weight, window)
        m = Rows(row, term, value)
        x = m.times(basis)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        for n, (d, k) in enumerate(pairs):
            lo, hi = np.searchsorted(doc_of, [at[d], at[d] + 1])
            if lo < hi:
                sim = x[lo:hi] @ latent[k]
                best[n] = max(0.0, float(sim.max()))
                a, z = m.starts[lo], m.starts[hi]
                own, weights = item_parts[k]
                where = np.minimum(np.searchsorted(own, m.term[a:z]), len(own) - 1)
                full = np.bincount(m.row[a:z] - lo, np.where(own[where] == m.term[a:z], weights[where], 0) * m.value[a:z], hi - lo)
                near[n] = bool(((sim >= cosine) & (full >= EXACT)).any())
        return list(zip(best, near))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(n_terms, bool)
        for part, ids in batches_of(batches):
            good: dict[tuple[int, int], tuple] = {}
            marked = -1
            for d, k, shared in signs.candidates(ids):
                if d != marked:
                    there[:], marked = False, d
                    there[ids[d][ids[d] >= 0]] = True
                answered = bool(len(answer_terms[k])) and bool(there[answer_terms[k]].all())
                # a copy needs more neighbours than a paraphrase, and one of the weighty words
                if not answered and (shared < NET * signs.lengths[k] - signs.spare[k] or not there[heavy_terms[k]].any()):
                    continue
                net, span, matched, rare, n = held(shapes[k], ids[d], PARAPHRASE if answered else NET, weight)
                copy = net >= NET and span >= SPAN and rare >= RARE_SHARE
                if copy or (net >= PARAPHRASE and answered):
                    good[d, k] = (net, span, matched, n, answered, copy, copy or rare >= RARE_SHARE)
            out: list[list] = [[] for _ in range(9)]
            keys = part.column(0).to_pylist()
            for (d, k), (s, near) in zip(good, similarities(ids, list(good)) if good else []):
                *shares, copy, sure = good[d, k]
                if sure or near:
                    for c, v in zip(out, (keys[d], item_ids[k], s, *shares, "copy" if copy else "paraphrase")):
                        c.append(v)
            kinds = [part.schema.field(0).type, pa.int64() if item_kind == "bigint" else pa.string() if item_kind == "string" else pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["a", "b", "c", "d", "e", "f", "g", "h", "i"])

    found = tokens.select("key", "ids").mapInArrow(search, out_schema)
    return found.dropDuplicates([key, item_key])
