"""Sums of large arrays that the tasks of a job make, added up where they are as a tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from findling.session import bounded

#: Parts that one task adds up; three steps of it take in a quarter of a million tasks and more.
FAN, STEPS = 64, 3


def tree_sum(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], tuple[int, np.ndarray]], shape: tuple[int, int], block: int = 64, tasks: int | None = None) -> tuple[int, np.ndarray]:
    """(n, sum) of the counts and arrays of one shape that ``partial`` makes of each task's batches.

    An array travels in blocks of its rows, in as many steps as ``tasks`` need where their number is known. What any task holds is ``FAN`` blocks, however many tasks there
    are; the driver gets one array.
    """
    height, width = shape
    starts = list(range(0, height, block))
    schema = "task int, at int, n bigint, part binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = partial(batches)
        parts = [np.ascontiguousarray(total[a : a + block], np.float64).tobytes() for a in starts]
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int32()), pa.array([n] * len(starts), pa.int64()), pa.array(parts, pa.binary())], ["at", "n", "part"])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(parts["part"].iloc[0]) // 8)
        for p in parts["part"]:
            total += np.frombuffer(p)
        return pd.DataFrame({"task": [key[0]], "at": [key[1]], "n": [int(parts["n"].sum())], "part": [total.tobytes()]})

    level = rows.mapInArrow(run, "at int, n bigint, part binary").withColumn("task", F.spark_partition_id())
    steps = STEPS if tasks is None else max(1, math.ceil(math.log(max(tasks, 1), FAN)))
    for step in range(steps):
        group = F.floor(F.col("task") / FAN).cast("int") if step < steps - 1 else F.lit(0)
        level = level.withColumn("task", group).groupBy("task", "at").applyInPandas(add, schema)
    out, n = np.zeros(shape), 0
    for _, at, count, part in bounded(level, len(starts), "blocks of sums"):
        out[at : at + block] = np.frombuffer(part).reshape(-1, width)
        n = count
    return n, out
