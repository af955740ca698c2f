"""Scans of folders handed on incrementally (the target holds each path's saved signature)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from findling.operators.incremental import VersionedTarget, new_or_changed
from findling.session import scratch, stored

MTIME_NOISE = 0.001
SIGNATURES = T.StructType([
    T.StructField("path_key", T.StringType()), T.StructField("size", T.LongType()),
    T.StructField("mtime", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("scan_id", T.LongType()),
])


def path_key(path: Column) -> Column:
    """The path with backslashes, in lower case."""
    return F.lower(F.translate(path, "/", "\\"))


def saved_signatures(files: DataFrame, containers: DataFrame) -> DataFrame:
    """Signatures saved before the first scan, one per path.

    Of a file's rows the one of the greatest ``indexed_at`` is valid; ties and paths that two ids share are
    settled by the greatest (indexed_at, mtime, size, status), so the result doesn't depend on row order.
    """
    valid = files.groupBy("id").agg(
        F.max(F.struct("indexed_at", "mtime", "size", "status", path_key(F.col("path")).alias("path_key"))).alias("v")
    )
    of_files = valid.select("v.path_key", "v.size", "v.mtime", "v.status", "v.indexed_at")
    of_containers = containers.select(
        path_key(F.col("path")).alias("path_key"), "size", "mtime", F.lit("indexed").alias("status"),
        F.lit(None).cast("double").alias("indexed_at"),
    )
    return (
        of_files.unionByName(of_containers)
        .groupBy("path_key")
        .agg(F.max(F.struct("indexed_at", "mtime", "size", "status")).alias("v"))
        .select("path_key", "v.size", "v.mtime", "v.status", F.lit(None).cast("long").alias("scan_id"))
    )


def seen_by_scans(sightings: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan_id, round, path_key, size, mtime) of the finished scans: the last sighting of each path counts.

    ``round`` numbers a folder's finished scans by start. Rows of late loads count for their scan. Equal
    ``found_at``: the greatest (mtime, size). Sightings of unknown or unfinished scans, or without a path,
    aren't cases of anything and don't come out. Rows of one path are combined before the shuffle, so a
    path seen very often costs no more than another.
    """
    one = scans.groupBy("scan_id").agg(
        F.max(F.struct("folder_id", "started_at", "state")).alias("s")
    ).select("scan_id", "s.*").where(F.col("state") == "finished")
    rounds = one.withColumn(
        "round", F.row_number().over(Window.partitionBy("folder_id").orderBy("started_at", "scan_id"))
    ).select("scan_id", "round")
    return (
        sightings.where(F.col("path").isNotNull())
        .select("scan_id", path_key(F.col("path")).alias("path_key"), "found_at", "mtime", "size")
        .join(F.broadcast(rounds) if _few(rounds) else rounds, "scan_id")
        .groupBy("scan_id", "round", "path_key")
        .agg(F.max(F.struct("found_at", "mtime", "size")).alias("v"))
        .select("scan_id", "round", "path_key", "v.size", "v.mtime")
    )


def _few(df: DataFrame, most: int = 200_000) -> bool:
    return df.limit(most + 1).count() <= most


def unchanged(s, t) -> Column:
    """The saved signature stands: same size, mtime within the noise, and not waiting or failed."""
    mtime = (s("mtime").eqNullSafe(t("mtime"))) | (F.abs(s("mtime") - t("mtime")) <= MTIME_NOISE)
    return s("size").eqNullSafe(t("size")) & mtime & ~F.coalesce(t("status"), F.lit("")).isin("pending", "error")


def replay_scans(sightings: DataFrame, scans: DataFrame, files: DataFrame, containers: DataFrame, path: str | None = None) -> VersionedTarget:
    """Run the finished scans against a target at ``path``, one published version per round of scans.

    A round holds at most one scan of each folder, so all folders advance together; a repeated call on the
    same ``path`` continues after the last version that was published.
    """
    spark = sightings.sparkSession
    target = VersionedTarget(spark, path or scratch(spark, "signatures"), SIGNATURES, ["path_key"])
    seen = stored(seen_by_scans(sightings, scans), "seen", ["round"])
    rounds = sorted(r[0] for r in seen.select("round").distinct().collect())  # as many as a folder has scans
    if target.version() == 0:
        target.publish(saved_signatures(files, containers), "saved", "base")
    for r in rounds:
        if f"round-{r}" in target.manifest()["sources"]:
            continue
        source, base = seen.where(F.col("round") == r).drop("round"), target.version()
        new = new_or_changed(source, target.current(base), ["path_key"], unchanged).withColumn("status", F.lit("indexed"))
        target.publish(new, f"round-{r}", base=base)
    return target


def changed_paths(sightings: DataFrame, scans: DataFrame, files: DataFrame, containers: DataFrame, path: str | None = None) -> DataFrame:
    """(scan_id, path_key) of what every finished scan found new or changed.

    Nulls: a path without a saved signature is new; null sizes and mtimes equal only null. Empty tables
    give no rows (or everything as new where nothing was saved). Extra columns of the inputs are ignored.
    """
    target = replay_scans(sightings, scans, files, containers, path)
    return target.deltas(since=1).select("scan_id", "path_key")
