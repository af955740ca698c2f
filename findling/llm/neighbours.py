"""The most similar vectors for every vector, by multiprobe p-stable hashing.

Vectors are scaled to unit length; identical ones form a class that is looked up once. An index is fitted on
a bounded sample: the directions in which the collection varies more than its noise, scaled to unit length
there, and how far neighbours lie apart. Each of several tables hashes by p-stable projections (random
directions, shifted and cut into slots of one width), as many of them as a place needs: a bucket of more
than ``LEAF`` rows is divided by the next function, so buckets stay small however many vectors there are;
only a region denser than the functions tell apart is one bucket. A query visits its own bucket and the perturbed ones in the order of their
estimated success, the probability that a neighbour's projections fall into a bucket's slots, until the
buckets that remain hold less than a stated share of it. Candidates of all tables are merged and ranked by
cosine; the hash decides only what is compared.

Buckets that agree in their first functions form a cell of about ``CELL`` rows, and a query is sent once to
every cell it visits. The cells come from the slots of at most ``CODES`` sampled rows, the buckets within a
cell from all of its rows, in the task that compares them as matrix products. A cell that turns out larger
than ``BLOCK`` is split into blocks of rows times blocks of queries, which loses no candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from findling.session import bounded, stored

SAMPLE, CODES = 20_000, 1_000_000
TREES, WIDTH, DEPTH, KEPT, SLOTS = 2, 3.5, 20, 32, 8
LEAF, CELL, BLOCK, QUERIES = 512, 16_384, 32_768, 16_384
SURE, FAINT, MISSING = 0.9, 1e-5, 1 << 40
BIG_CLASS = 50_000


def unit_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of unit length as float32, and which rows have a length at all."""
    x = values.astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    ok = np.isfinite(n) & (n > 0)
    return (x / np.where(ok, n, 1)[:, None]).astype(np.float32), ok


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrow lists as a matrix, and which rows hold a vector of ``dim`` numbers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ok = np.zeros(len(lists), bool)
    lengths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok[:] = lengths == dim
    out = np.zeros((len(lists), dim), np.float32)
    if ok.any():
        flat = lists.filter(pa.array(ok)).flatten()
        out[ok] = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out, ok


def unit_vectors(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key, class, unit``: usable vectors at unit length with the digest that identical ones share.

    Null vectors, such of another length, all zeros, and with nulls, NaN or infinity have no direction
    and don't come out. A key counts once: of several rows the one with the smallest digest.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x, ok = matrix(part.column(1), dim)
                u, there = unit_rows(x)
                keep = np.flatnonzero(ok & there)
                raw = [u[i].tobytes() for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep)), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                    ["key", "class", "unit"],
                )

    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    made = named.mapInArrow(run, f"key {kind}, class binary, unit binary")
    return made.groupBy("key").agg(F.min(F.struct("class", "unit")).alias("r")).select("key", "r.class", "r.unit")


@dataclass
class Tree:
    """One table: functions in order, and the cells that their slots' prefixes name."""

    functions: np.ndarray  # kept x depth, scaled by the width
    shifts: np.ndarray
    levels: list[np.ndarray]  # node x slot -> node of the next level, or -1 - cell
    depths: np.ndarray  # of every cell


@dataclass
class Index:
    """Projections and cells of all tables; small, and sent to the tasks with their code."""

    directions: np.ndarray  # dim x kept
    mean: np.ndarray
    spread: float  # of a neighbour's projection around the query's, in slots
    trees: list[Tree]
    leaf: int
    sure: float

    @classmethod
    def fit(cls, sample: np.ndarray, k: int = 5, seed: int = 11, trees: int = TREES, width: float = WIDTH, leaf: int = LEAF, sure: float = SURE) -> Index:
        """Projections from a sample: its directions above the noise, and how far its neighbours lie apart there."""
        rng = np.random.default_rng(seed)
        mean = sample.mean(0)
        values, vectors = np.linalg.eigh(np.cov((sample - mean).T) if len(sample) > 1 else np.eye(sample.shape[1]))
        order = np.argsort(-values)
        dim = int(np.clip((values > 1.4 * np.median(values)).sum(), min(16, len(values)), min(KEPT, len(values))))
        directions = vectors[:, order[:dim]].astype(np.float32)
        y = cls._project(sample, mean, directions)
        depth = min(DEPTH, dim)
        made = []
        for _ in range(trees):
            g, _ = np.linalg.qr(rng.standard_normal((dim, depth)))
            scale = width * max(float((y @ g).std()), 1e-6)
            made.append(Tree((g / scale).astype(np.float32), rng.random(depth).astype(np.float32) + np.float32(SLOTS / 2 - 0.5), [], np.zeros(1, np.int64)))
        asked = rng.choice(len(sample), min(len(sample), 500), replace=False)
        s = sample[asked] @ sample.T
        s[np.arange(len(asked)), asked] = -2
        k = min(k, len(sample) - 1)
        spread = 1.0
        if k > 0:
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            apart = float(np.sqrt(((y[near] - y[asked][:, None]) ** 2).mean()))
            spread = max(apart / (width * max(float(y.std()), 1e-6)), 1e-3)
        return cls(directions, mean.astype(np.float32), spread, made, leaf, sure)

    @staticmethod
    def _project(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> np.ndarray:
        y = (x - mean) @ directions
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def places(self, x: np.ndarray) -> list[np.ndarray]:
        """Of every table: the rows' projections in slots."""
        y = self._project(x, self.mean, self.directions)
        return [y @ t.functions + t.shifts for t in self.trees]

    def plant(self, codes: list[np.ndarray], scale: float, cell: int) -> None:
        """Divide every table into cells of about ``cell`` rows; ``codes`` are slots of rows that stand for ``scale`` rows each."""
        for t, h in zip(self.trees, codes):
            t.levels, depths = grow(h, max(cell / scale, 1))[1:]
            for level in t.levels:  # what no sampled row has goes with the nearest slot that one has
                for node in level:
                    there = np.flatnonzero(node != MISSING)
                    node[:] = node[there[np.abs(there[None, :] - np.arange(SLOTS)[:, None]).argmin(1)]]
            t.depths = depths

    def cells(self, t: int, slots: np.ndarray) -> np.ndarray:
        out = np.zeros(len(slots), np.int64)
        rows, node = np.arange(len(slots)), np.zeros(len(slots), np.int64)
        for d, level in enumerate(self.trees[t].levels):
            child = level[node, slots[rows, d]]
            done = child < 0
            out[rows[done]] = -1 - child[done]
            rows, node = rows[~done], child[~done]
        return out

    def visits(self, t: int, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, cells to visit, and what share of a cell's estimated success may stay unvisited in it."""
        row, cell, p = descend(z, self.trees[t].levels, self.spread)
        both, back = np.unique(row * len(self.trees[t].depths) + cell, return_inverse=True)  # a cell may lie in several slots
        row, cell = np.divmod(both, len(self.trees[t].depths))
        p = np.bincount(back, p, len(both))
        left = (1 - self.sure) / 2
        keep, share = most_likely(row, p, left)
        row, cell, share = row[keep], cell[keep], share[keep]
        number = np.bincount(row, minlength=len(z))[row]
        return row, cell, (left / number / share).astype(np.float32)


def slots_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z), 0, SLOTS - 1).astype(np.int8)


def grow(slots: np.ndarray, most: float, start: int = 0) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """A prefix tree over rows of slots: nodes of more than ``most`` rows are divided by the next function.

    Gives each row's leaf, the levels (node x slot -> node of the next level, or -1 - leaf), and the leaves' depths.
    """
    n, depth = slots.shape
    leaf, levels, depths = np.zeros(n, np.int64), [], []
    rows, node, nodes = np.arange(n), np.zeros(n, np.int64), 1
    if n <= most or start >= depth:
        return leaf, [], np.array([start])
    for d in range(start, depth):
        key, back, count = np.unique(node * SLOTS + slots[rows, d], return_inverse=True, return_counts=True)
        done = (count <= most) | (d == depth - 1)
        child = np.empty(len(key), np.int64)
        child[done] = -1 - (len(depths) + np.arange(done.sum()))
        child[~done] = np.arange((~done).sum())
        depths += [d + 1] * int(done.sum())
        level = np.full(nodes * SLOTS, MISSING)
        level[key] = child
        levels.append(level.reshape(nodes, SLOTS))
        to = child[back]
        leaf[rows[to < 0]] = -1 - to[to < 0]
        rows, node, nodes = rows[to >= 0], to[to >= 0], int((~done).sum())
        if not nodes:
            break
    return leaf, levels, np.array(depths)


def normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, off by less than 0.0004."""
    return 0.5 * (1 + np.tanh(0.7978845608 * x * (1 + 0.044715 * x * x)))


def descend(z: np.ndarray, levels: list[np.ndarray], spread: float, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, leaf and probability that a neighbour of the row, whose projections lie around the row's own, is in that leaf."""
    row, node, p = np.arange(len(z)), np.zeros(len(z), np.int64), np.ones(len(z), np.float32)
    if not levels:
        return row, node, p
    found = []
    edges = np.arange(1, SLOTS, dtype=np.float32)
    for d, level in enumerate(levels, start):
        under = np.concatenate([np.zeros((len(z), 1), np.float32), normal((edges - z[:, d : d + 1]) / spread), np.ones((len(z), 1), np.float32)], axis=1)
        chance = np.diff(under, axis=1)[row] * p[:, None]
        child = level[node]
        at, slot = np.nonzero((child != MISSING) & (chance > FAINT))
        row, p, child = row[at], chance[at, slot], child[at, slot]
        done = child < 0
        found.append((row[done], -1 - child[done], p[done]))
        row, node, p = row[~done], child[~done], p[~done]
        if not len(row):
            break
    return tuple(np.concatenate(x) for x in zip(*found))


def most_likely(row: np.ndarray, p: np.ndarray, left: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries to visit, in order of success until no more than a share ``left`` of a row's sum remains; and their shares."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    total = np.bincount(row, p)
    share = p / np.maximum(total[row], 1e-30)
    order = np.lexsort((-share, row))
    r, s = row[order], share[order]
    run = np.cumsum(s, dtype=np.float64)
    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    before = run - s - np.repeat((run - s)[start], np.diff(np.append(start, len(r))))
    return order[before < 1 - (left if np.isscalar(left) else left[r])], share


def pack16(u: np.ndarray) -> list[bytes]:
    """Unit rows as 16-bit numbers scaled by their largest; off by less than 1e-5 in a cosine."""
    top = np.maximum(np.abs(u).max(1, keepdims=True), 1e-12)
    q = np.rint(u / top * 32767).astype(np.int16)
    return [t.tobytes() + r.tobytes() for t, r in zip(top.astype(np.float32), q)]


def unpack16(column: pa.Array, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 4 + 2 * dim)
    top = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    x = np.ascontiguousarray(raw[:, 4:]).view(np.int16).astype(np.float32) * (top / np.float32(32767))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def nearest(vectors: DataFrame, k: int, dim: int, kind: str, index: Index | None = None, queries=None, cell: int = CELL, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``key, other, similarity``: for every key of ``vectors`` (key, unit) its k nearest others found.

    ``queries``, a column over ``key``, restricts whose neighbours are looked for.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    if index is None:
        share = min(1.0, 1.2 * SAMPLE / max(n, 1))
        few = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        sample = bounded(few.select("key", "unit").orderBy(F.xxhash64("key"), "key").limit(SAMPLE), SAMPLE, "sample")
        if not sample:
            return spark.createDataFrame([], f"key {kind}, other {kind}, similarity double")
        index = Index.fit(np.stack([np.frombuffer(r[1], np.float32) for r in sample]), k)
    marked = vectors.select("key", "unit", (F.lit(True) if queries is None else queries).alias("ask"))

    def units(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                h = [slots_of(z).tobytes() for z in index.places(units(batch.slice(at, 4096).column(0)))]
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(h)], pa.binary())], ["slots"])

    if not any(t.levels for t in index.trees):
        share = min(1.0, CODES / max(n, 1) / 1.1)
        some = vectors if share == 1 else vectors.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 40)) < int(share * (1 << 40)))
        parts: list[list[np.ndarray]] = [[] for _ in index.trees]
        for (raw,) in bounded(some.select("unit").mapInArrow(code, "slots binary"), CODES, "slots") if n > cell else []:
            for t, h in enumerate(np.frombuffer(raw, np.int8).reshape(len(parts), -1, index.trees[0].functions.shape[1])):
                parts[t].append(h)
        if n > cell:
            codes = [np.concatenate(p) for p in parts]
            index.plant(codes, n / len(codes[0]), cell)
    offsets = np.cumsum([0, *[len(t.depths) for t in index.trees]])

    def emit(batches: Iterator[pa.RecordBatch], count: bool) -> Iterator[pa.RecordBatch]:
        tally: dict[bool, np.ndarray] = {False: np.zeros(offsets[-1], np.int64), True: np.zeros(offsets[-1], np.int64)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                u = units(part.column(1))
                asked = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                packed = None if count else pa.array(pack16(u), pa.binary())
                for t, z in enumerate(index.places(u)):
                    own = offsets[t] + index.cells(t, slots_of(z))
                    row, to, rest = index.visits(t, z[asked])
                    row, to = asked[row], offsets[t] + to
                    if count:
                        tally[False] += np.bincount(own, minlength=offsets[-1])
                        tally[True] += np.bincount(to, minlength=offsets[-1])
                        continue
                    at_ = pa.array(np.concatenate([np.arange(len(u)), row]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([own, to])), pa.array(np.repeat([False, True], [len(u), len(row)])), part.column(0).take(at_), packed.take(at_), pa.array(np.concatenate([np.zeros(len(u), np.float32), rest]))],
                        ["cell", "ask", "key", "vec", "rest"],
                    )
        if count:
            for role, numbers in tally.items():
                there = np.flatnonzero(numbers)
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(np.full(len(there), role)), pa.array(numbers[there])], ["cell", "ask", "n"])

    counted = marked.mapInArrow(lambda b: emit(b, True), "cell bigint, ask boolean, n bigint").groupBy("cell", "ask").agg(F.sum("n").alias("n"))
    blocks: dict[int, list[int]] = {}
    for number, ask, rows_ in bounded(counted, 2 * int(offsets[-1]), "cells"):  # both roles of every cell
        blocks.setdefault(number, [1, 1])[int(ask)] = max(1, -(-rows_ // (query_block if ask else block)))
    split = {c: v for c, v in blocks.items() if v != [1, 1]}
    rows = marked.mapInArrow(lambda b: emit(b, False), f"cell bigint, ask boolean, key {kind}, vec binary, rest float")
    if split:  # the others are one block
        parts_ = spark.createDataFrame([(c, a, b) for c, (a, b) in split.items()], "cell bigint, nb bigint, nq bigint")
        rows = rows.join(F.broadcast(parts_), "cell", "left").fillna(1, ["nb", "nq"])  # at most as many rows as cells
        own = F.pmod(F.xxhash64("key"), F.when(F.col("ask"), F.col("nq")).otherwise(F.col("nb")))
        rows = rows.withColumn("own", own).withColumn("other_block", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("ask"), F.col("nb")).otherwise(F.col("nq")) - 1)))
        rows = rows.select("cell", F.when(F.col("ask"), F.col("other_block")).otherwise(F.col("own")).alias("i"), F.when(F.col("ask"), F.col("own")).otherwise(F.col("other_block")).alias("j"), "ask", "key", "vec", "rest")
    else:
        rows = rows.select("cell", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "ask", "key", "vec", "rest")
    names = ["key", "others", "similarities"]

    def compare(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy()
        base, asked = table.filter(pa.array(~ask)).combine_chunks(), table.filter(pa.array(ask)).combine_chunks()
        if not base.num_rows or not asked.num_rows:
            return pa.table([table.column("key").slice(0, 0), pa.array([], pa.list_(table.schema.field("key").type)), pa.array([], pa.list_(pa.float32()))], names)
        number = table.column("cell")[0].as_py()
        t = int(np.searchsorted(offsets, number, side="right")) - 1
        start = int(index.trees[t].depths[number - offsets[t]])
        b_vec, b_key, q_key = unpack16(base.column("vec"), dim), base.column("key").to_numpy(), asked.column("key").to_numpy()
        found, levels, _ = grow(slots_of(index.places(b_vec)[t]), index.leaf, start)
        order = np.argsort(found, kind="stable")
        b_vec, b_key, found = b_vec[order], b_key[order], found[order]
        ends = np.append(np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])), len(found))
        by_key = np.argsort(b_key, kind="stable")
        at = np.minimum(np.searchsorted(b_key[by_key], q_key), len(b_key) - 1)
        own = np.where(b_key[by_key[at]] == q_key, by_key[at], -1)
        width = min(k, len(b_key))
        best, which = np.full((len(q_key), width), -2, np.float32), np.full((len(q_key), width), -1, np.int64)
        rest = asked.column("rest").to_numpy()
        for low in range(0, len(q_key), 4096):
            q_vec = unpack16(asked.column("vec").slice(low, 4096), dim)
            row, leaf, p = descend(index.places(q_vec)[t], levels, index.spread, start)
            keep, _ = most_likely(row, p, rest[low : low + 4096])
            row, leaf = row[keep], leaf[keep]
            by_leaf = np.argsort(leaf, kind="stable")
            row, leaf = row[by_leaf], leaf[by_leaf]
            bounds = np.searchsorted(leaf, np.arange(len(ends)))
            for a, z, x, y in zip(ends[:-1], ends[1:], bounds[:-1], bounds[1:]):
                if x == y:
                    continue
                r = row[x:y]
                s = q_vec[r] @ b_vec[a:z].T
                mine = own[low + r]
                inside = np.flatnonzero((mine >= a) & (mine < z))
                s[inside, mine[inside] - a] = -2
                better = np.flatnonzero(s.max(1) > best[low + r].min(1))
                if len(better):
                    to = low + r[better]
                    both = np.concatenate([best[to], s[better]], axis=1)
                    top = np.argpartition(-both, width - 1, axis=1)[:, :width]
                    best[to] = np.take_along_axis(both, top, 1)
                    which[to] = np.where(top < width, np.take_along_axis(which[to], np.minimum(top, width - 1), 1), a + top - width)
        good = best > -1.5
        size = good.sum(1)
        keep = np.flatnonzero(size)
        edges = pa.array(np.append(0, np.cumsum(size[keep])).astype(np.int32))
        return pa.table([pa.array(q_key[keep]), pa.ListArray.from_arrays(edges, pa.array(b_key[which[good]])), pa.ListArray.from_arrays(edges, pa.array(best[good]))], names)

    found = rows.groupBy("cell", "i", "j").applyInArrow(compare, f"key {kind}, others array<{kind}>, similarities array<float>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _with_end(batches):
            if batch is not None:
                held = pa.table(batch) if held is None else pa.concat_tables([held, pa.table(batch)])
                if held.num_rows < 4096:
                    continue
                last = held.column("key")[held.num_rows - 1]
                same = pc.equal(held.column("key"), last).to_numpy()
                cut = len(same) - int(same[::-1].argmin()) if not same.all() else 0  # the last key may go on
            else:
                cut = held.num_rows if held is not None else 0
            if not cut:
                continue
            done, held = held.slice(0, cut).combine_chunks(), held.slice(cut)
            q = np.repeat(np.arange(cut), pc.list_value_length(done.column("others")).to_numpy())
            keys, back = np.unique(done.column("key").to_numpy(), return_inverse=True)
            q = back[q]
            others, o = np.unique(done.column("others").combine_chunks().flatten().to_numpy(), return_inverse=True)
            s = done.column("similarities").combine_chunks().flatten().to_numpy()
            order = np.lexsort((-s, o, q))
            q, o, s = q[order], o[order], s[order]
            once = np.concatenate([[True], (q[1:] != q[:-1]) | (o[1:] != o[:-1])])
            q, o, s = q[once], o[once], s[once]
            order = np.lexsort((o, -s, q))
            q, o, s = q[order], o[order], s[order]
            start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            keep = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) < k
            yield pa.RecordBatch.from_arrays([pa.array(keys[q[keep]]), pa.array(others[o[keep]]), pa.array(s[keep].astype(np.float64))], ["key", "other", "similarity"])

    return found.repartition("key").sortWithinPartitions("key").mapInArrow(merge, f"key {kind}, other {kind}, similarity double")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def similar_files(rows: DataFrame, key: str = "file_id", vector: str = "vector", k: int = 5, dim: int = 256, index: Index | None = None, queries=None) -> DataFrame:
    """``key, other, rank, similarity``: for every row its k most similar other rows by cosine.

    Ties go to the smaller key. Vectors without a direction (null, zero, of another length) are left out, a
    key counts once. Identical vectors are looked up once: the first k of a class by key are all that
    neighbours can need of it, so its size never multiplies. With fewer than k others all are given; an
    empty table gives an empty result. ``queries`` is a column over ``key`` that says who asks.
    """
    kind = dict(rows.dtypes)[key]
    units = stored(unit_vectors(rows, key, vector, dim), "units")
    own = Window.partitionBy("class").orderBy("key")
    firsts = units.select("class", "key").withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= k + 1)
    head = firsts.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("head"))  # at most k + 1 keys
    sizes = units.groupBy("class").agg(F.count("*").alias("n"), F.min("key").alias("rep"))
    classes = stored(sizes.join(head, "class"), "classes")
    reps = units.join(classes.select("class", F.col("rep").alias("key")), ["class", "key"], "left_semi").select("key", "unit")
    reps = stored(reps, "reps")
    asked = None
    if queries is not None:  # a class asks if one of its members does
        asking = units.where(queries).select("class").distinct().join(classes, "class").select(F.col("rep").alias("key"), F.lit(True).alias("ask"))
        with_ask = reps.join(asking, "key", "left").withColumn("ask", F.coalesce("ask", F.lit(False)))
        near = nearest(with_ask, k, dim, kind, index, F.col("ask"))
    else:
        near = nearest(reps, k, dim, kind, index, asked)
    # neighbours' members: at most k of each of k classes
    others = near.join(classes.select(F.col("rep").alias("other"), "head"), "other").select("key", "similarity", F.explode(F.slice("head", 1, k)).alias("id"))
    by = Window.partitionBy("key").orderBy(F.desc(F.round("similarity", 6)), "id")
    lists = others.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= k).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rn", "id", "similarity"))).alias("far"))
    info = classes.join(lists.withColumnRenamed("key", "rep"), "rep", "left").select("class", "head", "far", "n")
    # a class of very many copies is spread over salts; there are at most rows / BIG_CLASS of them
    big = info.where(F.col("n") > BIG_CLASS).select("class", F.ceil(F.col("n") / BIG_CLASS).alias("salts"))
    members = units.select("class", "key") if queries is None else units.where(queries).select("class", "key")
    members = members.join(F.broadcast(big), "class", "left").withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("salts", F.lit(1))))
    info = info.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / BIG_CLASS) - 1)))
    copies = F.transform(F.array_remove("head", F.col("key")), lambda x: F.struct(x.alias("id"), F.lit(1.0).alias("similarity")))
    far = F.transform(F.coalesce("far", F.array().cast(f"array<struct<rn:int,id:{kind},similarity:double>>")), lambda x: F.struct(x["id"].alias("id"), x["similarity"].alias("similarity")))
    final = members.join(info, ["class", "salt"]).select("key", F.posexplode(F.slice(F.concat(copies, far), 1, k)).alias("rank", "r"))
    return final.select(F.col("key").alias(key), F.col("r.id").alias("other"), (F.col("rank") + 1).alias("rank"), F.round(F.col("r.similarity"), 6).alias("similarity"))


def neighbour_pairs(found: DataFrame, key: str = "file_id") -> DataFrame:
    """``file_a, file_b``, smaller first, of all pairs in which one is among the other's nearest."""
    return found.select(F.least(key, "other").alias("file_a"), F.greatest(key, "other").alias("file_b")).distinct()
