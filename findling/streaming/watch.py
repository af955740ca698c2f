"""Changes of files as a stream: debounced, routed, and taken in batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from findling.functions import filetypes as T, paths as P
from findling.operators.vector import nth_value


def debounced(events: DataFrame, key: str, at: str, order: str, value: str, gap: str = "2 seconds") -> DataFrame:
    """``key, value, at, n``: a key's last event once it has been quiet for ``gap``; works on tables and streams.

    On a stream put a watermark on ``at`` first: a key comes out when the watermark passes its quiet time.
    Events at the same time: the greatest ``order`` is the last.
    """
    quiet = events.groupBy(F.session_window(at, gap).alias("w"), key).agg(
        F.max_by(value, F.struct(at, order)).alias(value), F.max(at).alias("last"), F.count("*").alias("n")
    )
    return quiet.select(key, value, F.col("last").alias(at), "n")


def route(changes: DataFrame, folders: DataFrame) -> DataFrame:
    """Changed paths with the folder they belong to and what to do: remove, container, file, or nothing (null).

    ``changes`` has path and event; of several roots above a path the one of the smallest id counts.
    """
    roots = folders.select(F.col("id").alias("folder_id"), P.normcase(F.regexp_replace("path", r"[\\/]+$", "")).alias("root"))
    above = changes.select("*", F.explode(P.ancestors(P.normcase(F.col("path")))).alias("root")).join(roots, "root")
    best = above.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("folder_id"))).where("n = 1").drop("n")
    below = F.filter(F.split(F.substr("path", F.length("root") + 2), r"[\\/]"), lambda x: x != "")
    what = (
        F.when(F.col("event") == "removed", "remove").when(T.skip_path(below).isNotNull(), None)
        .when(T.looks_inside(F.col("path")), "container").when(T.decide(F.col("path")).isin("doc", "text", "code", "image"), "file")
    )
    return best.select("path", "event", "folder_id", what.alias("what"))


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every batch handed to ``apply`` with its number; a batch repeated after a failure has the same number,
    so ``apply`` must publish under it (see the versioned target) to take it in only once."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _seconds(at: Column) -> Column:
    return at.cast("timestamp").cast("double")


def rates(points: DataFrame, at: str, count: str, key: str, last: int = 120) -> DataFrame:
    """``per_minute`` over the last points of each key: what was added, by the minutes between the first and now."""
    w = Window.partitionBy(key).orderBy(at)
    over = w.rowsBetween(-(last - 1), 0)
    first_at, first_n = F.first(at).over(over), F.first(count).over(over)
    minutes = (_seconds(F.col(at)) - _seconds(first_at)) / 60
    return points.withColumn("per_minute", F.when(minutes > 0, (F.col(count) - first_n) / minutes))


def speed(points: DataFrame, at: str, count: str, key: str, back: int = 5) -> DataFrame:
    """Change per second against the sample five before."""
    w = Window.partitionBy(key).orderBy(at)
    seconds = _seconds(F.col(at)) - _seconds(F.lag(at, back).over(w))
    return points.withColumn("speed", F.when(seconds > 0, (F.col(count) - F.lag(count, back).over(w)) / seconds))


def last_samples(samples: DataFrame, at: str, *ties: str, keep: int = 600) -> DataFrame:
    """The newest samples, as a ring of so many would hold; of equal times the greatest ``ties``."""
    return samples.orderBy(F.desc(at), *[F.desc(t) for t in ties]).limit(keep)


def upper_median(samples: DataFrame, value: str) -> DataFrame:
    """``median``: the element at half of the sorted values, the upper one of two; null if there are none."""
    n = samples.where(F.col(value).isNotNull()).count()
    return samples.sparkSession.createDataFrame([(nth_value(samples, value, n // 2) if n else None,)], "median double")
