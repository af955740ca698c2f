"""Filling containers of fixed capacity with documents.

Best fit in bulk-synchronous rounds. Documents and gaps are kept range-sorted by size; as sizes are whole
numbers up to the capacity, equal sizes are one run with a count, so both sorted sequences have at most
``capacity`` runs however many documents there are. In a round every run of documents, largest first, sweeps
to its successor among the gaps, the smallest gap it fits into; where runs want the same gaps the one of
higher rank (larger documents) takes them and the others sweep on; then the gaps are updated and the next
round begins. Documents that find no gap open containers. The rounds settle how many documents of a size go
into which range of containers; which document that is follows from its rank within its size, computed
where the documents are: a count by (size, salt) gives every salt its offset, so a size that a third of all
documents share is ranked by many tasks. No list of documents ever reaches the driver.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from findling.session import bounded, stored

CAPACITY = 2048
SALT_ROWS = 200_000
#: Fixed value: a run of letters, digits and _, or one other character that isn't white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
PLACES = T.StructType([T.StructField(n, T.LongType()) for n in ("size", "from_rank", "to_rank", "container")])


def token_count(text: Column) -> Column:
    """Tokens of a text by the rule above; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)).cast("long"), F.lit(0).cast("long"))


def plan(sizes: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(size, first rank, last rank + 1, first container): where the documents of every size go.

    Ranks count from 0 within a size; the documents of a range go one each to consecutive containers.
    """
    if any(not 0 <= s <= capacity for s in sizes):
        raise ValueError("sizes must lie within the capacity")
    places: list[tuple[int, int, int, int]] = []
    left = {s: n for s, n in sizes.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of containers (first, count)
    keys: list[int] = []  # the gaps' sizes, sorted
    opened = 0

    def add(gap: int, first: int, count: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(keys, gap)
        gaps[gap].append((first, count))

    def put(size: int, first: int, count: int) -> None:
        places.append((size, rank[size], rank[size] + count, first))
        rank[size] += count
        left[size] -= count

    while any(left.values()):
        moved: list[tuple[int, int, int]] = []  # gaps as they are after the round
        for size in sorted((s for s, n in left.items() if n), reverse=True):
            at = bisect.bisect_left(keys, size)
            while left[size] and at < len(keys):  # the successor, then the next one if that is taken up
                gap = keys[at]
                ranges = gaps[gap]
                while left[size] and ranges:
                    first, count = ranges.pop()
                    take = min(count, left[size])
                    put(size, first, take)
                    moved.append((gap - size, first, take))
                    if take < count:
                        ranges.append((first + take, count - take))
                if ranges:
                    break
                del gaps[gap]
                keys.pop(at)
        if moved:
            for gap, first, count in moved:
                add(gap, first, count)
            continue
        # nothing fits any more: the largest documents open containers, each filled with as many as it holds
        size = max(s for s, n in left.items() if n)
        each = capacity // size if size else left[size]
        full, rest = divmod(left[size], each)
        if full:
            for _ in range(each):
                put(size, opened, full)
            add(capacity - each * size, opened, full)
            opened += full
        if rest:
            for _ in range(rest):
                put(size, opened, 1)
            add(capacity - rest * size, opened, 1)
            opened += 1
    return places


def pack(documents: DataFrame, key: str = "doc_id", size: Column | None = None, capacity: int = CAPACITY, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``key, piece, pieces, from_token, n_tokens, container`` of all documents.

    A document larger than ``capacity`` is cut into pieces of ``capacity`` tokens and a rest; full pieces
    have a container each, the rest is packed like a document. All others come out once and whole. A null
    or negative size counts as 0; documents of size 0 are packed too. Repeated rows are packed one by one.
    Containers are numbered from 0 without gaps; the same input gives the same packing.
    """
    size = F.coalesce(F.col("n_tokens").cast("long"), token_count(F.col("text"))) if size is None else size
    kind = dict(documents.dtypes)[key]
    sized = documents.select(F.col(key).alias("key"), F.greatest(F.coalesce(size.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("total"))
    whole = F.when(F.col("total") > capacity, F.floor((F.col("total") - 1) / capacity)).otherwise(0)  # full pieces before the last
    items = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), whole.cast("long"))))
    items = items.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece") * capacity))
    items = stored(items, "items")
    spark = documents.sparkSession
    # a size has as many salts as its documents need, so that none is more than a task's work
    salts = [(s, -(-n // salt_rows)) for s, n in bounded(items.groupBy("size").agg(F.count("*").alias("n")), capacity + 1, "sizes")]
    salt_table = spark.createDataFrame(salts, "size bigint, salts bigint")
    items = items.join(F.broadcast(salt_table), "size").withColumn("salt", F.pmod(F.xxhash64("key", "piece"), F.col("salts")).cast("int")).drop("salts")  # at most capacity + 1 rows
    by_salt = items.groupBy("size", "salt").agg(F.count("*").alias("n"))
    counts = bounded(by_salt, sum(n for _, n in salts), "sizes and salts")  # one number for every ``salt_rows`` documents
    sizes: dict[int, int] = {}
    offsets = []
    for s, salt, n in sorted(tuple(r) for r in counts):
        offsets.append((s, salt, sizes.get(s, 0)))
        sizes[s] = sizes.get(s, 0) + n
    places = plan(sizes, capacity)
    offset = spark.createDataFrame(offsets, "size bigint, salt int, offset bigint")
    ranked = (
        items.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("key", "piece")) - 1)
        .join(F.broadcast(offset), ["size", "salt"])  # as many rows as ``counts``
        .withColumn("rank", F.col("r") + F.col("offset"))
    )
    # the ranges of a size as sorted arrays: a rank finds its place by position
    by_size: dict[int, list[tuple[int, int]]] = {}
    for s, a, _, c in sorted(places):
        by_size.setdefault(s, []).append((a, c))
    table = spark.createDataFrame([(s, [{"a": a, "c": c} for a, c in v]) for s, v in by_size.items()], "size bigint, places array<struct<a: bigint, c: bigint>>")
    placed = ranked.join(F.broadcast(table), "size").withColumn(
        "p", F.element_at(F.filter("places", lambda x: x["a"] <= F.col("rank")), -1)
    )
    return placed.select(
        F.col("key").cast(kind).alias(key), F.col("piece"), (F.greatest(F.ceil(F.col("total") / capacity), F.lit(1))).cast("long").alias("pieces"),
        (F.col("piece") * capacity).alias("from_token"), F.col("size").alias("n_tokens"),
        (F.col("p.c") + F.col("rank") - F.col("p.a")).alias("container"),
    )


def bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest containers that any packing needs: by volume, and one for each item over half the capacity."""
    return max(int(-(-int(sizes.sum()) // capacity)), int((sizes * 2 > capacity).sum()))
