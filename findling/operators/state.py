"""Changes of tables: each gives the new state as a DataFrame; publishing it is the versioned target's part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from findling.functions import paths as P, text as X
from findling.operators.scans import MTIME_NOISE
from findling.session import bounded, stored


def scan_diff(saved: DataFrame, found: DataFrame) -> DataFrame:
    """``path_key, state``: new, changed, gone or same, of saved (path, size, mtime, status) and found (path, size, mtime).

    Repeated paths count once (greatest mtime, size).
    """

    def one(df: DataFrame, cols: list[str]) -> DataFrame:
        return df.groupBy(P.normcase(F.col("path")).alias("path_key")).agg(F.max(F.struct(*cols)).alias("v"))

    s = one(saved, ["mtime", "size", "status"]).withColumnRenamed("v", "s")
    f = one(found, ["mtime", "size"]).withColumnRenamed("v", "f")
    changed = (F.col("s.size") != F.col("f.size")) | (F.abs(F.col("s.mtime") - F.col("f.mtime")) > MTIME_NOISE) | F.col("s.status").isin("pending", "error")
    state = F.when(F.col("s").isNull(), "new").when(F.col("f").isNull(), "gone").when(changed, "changed").otherwise("same")
    return s.join(f, "path_key", "full_outer").select("path_key", state.alias("state"))


def containers_to_open(saved: DataFrame, found: DataFrame, types: str) -> DataFrame:
    """Containers found (path, size, mtime) that must be looked into again: new, changed, or read under other settings."""
    s = saved.groupBy(P.normcase(F.col("path")).alias("k")).agg(F.max(F.struct("mtime", "size", "types")).alias("s"))
    f = found.withColumn("k", P.normcase(F.col("path")))
    same = (F.col("s.size") == F.col("size")) & (F.abs(F.col("s.mtime") - F.col("mtime")) <= MTIME_NOISE) & (F.col("s.types") == types)
    return f.join(s, "k", "left").where(~F.coalesce(same, F.lit(False))).select("path", "size", "mtime")


def upsert_files(files: DataFrame, entries: DataFrame, at: float) -> DataFrame:
    """Files with the entries taken in by path; a known path keeps its id, and ``muted`` while it still fails.

    New paths get the ids after the greatest, in order of their path.
    """
    e = entries.withColumn("k", P.normcase(F.col("path"))).dropDuplicates(["k"])
    old = files.withColumn("k", P.normcase(F.col("path")))
    kept = old.join(e.select("k"), "k", "left_anti").drop("k")
    known = old.select("k", F.col("id").alias("old_id"), F.col("muted").alias("old_muted"))
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    merged = e.join(known, "k", "left")
    fresh = number_rows(merged.where("old_id is null").select("k"), "k").crossJoin(F.broadcast(top)).select("k", (F.col("n") + F.col("top")).alias("new_id"))
    merged = merged.join(fresh, "k", "left").withColumn("id", F.coalesce("old_id", "new_id"))
    merged = merged.withColumn("muted", F.when(F.col("status") == "error", F.coalesce("old_muted", F.lit(0))).otherwise(0)).withColumn("indexed_at", F.lit(at))
    cols = files.columns
    return kept.select(*cols).unionByName(merged.select(*[F.col(c).cast(dict(files.dtypes)[c]).alias(c) if c in merged.columns else F.lit(None).cast(dict(files.dtypes)[c]).alias(c) for c in cols]))


def number_rows(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows with ``n`` from 1 in order: sorted by ranges, numbered in each, moved on by those before.

    The ranges are written once, as what they hold must not change between counting and numbering.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = dict(map(tuple, bounded(ranged.groupBy("__part").agg(F.count("*")), max(parts, 1), "ranges")))
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    offset = spark.createDataFrame(offsets, "__part int, __before bigint")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # as many rows as there are ranges
    return ranged.withColumn("__own", own).join(F.broadcast(offset), "__part").withColumn("n", F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def add_pending(files: DataFrame, found: DataFrame, folder_id: int, at: float) -> DataFrame:
    """Files just found as pending rows; known paths stay as they are."""
    new = found.withColumn("k", P.normcase(F.col("path"))).dropDuplicates(["k"])
    new = new.join(files.select(P.normcase(F.col("path")).alias("k")), "k", "left_anti")
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = number_rows(new, "k").crossJoin(F.broadcast(top)).select(
        (F.col("n") + F.col("top")).alias("id"), F.lit(folder_id).cast("long").alias("folder_id"), "path", "size", "mtime", "kind",
        F.lit("pending").alias("status"), F.lit(0).cast("long").alias("chunks"), F.lit(None).cast("string").alias("error"),
        F.lit(at).alias("indexed_at"), F.lit(0).alias("muted"), "search_name",
    )
    return files.unionByName(rows.select(*files.columns))


def remove_paths(files: DataFrame, paths: DataFrame) -> DataFrame:
    """Files without the given paths and all inside them."""
    gone = paths.select(P.normcase(F.col("path")).alias("k")).distinct()
    with_above = files.withColumn("above", F.array_union(P.ancestors(P.normcase(F.col("path"))), F.array(P.normcase(F.col("path")))))
    hit = with_above.select("id", F.explode("above").alias("k")).join(gone, "k", "left_semi").select("id").distinct()
    return files.join(hit, "id", "left_anti")


def keep_known(rows: DataFrame, files: DataFrame, key: str = "file_id") -> DataFrame:
    """Passages, vectors and the like of files that still exist."""
    return rows.join(files.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def remove_folder(files: DataFrame, folder_ids: list[int]) -> DataFrame:
    return files.where(~F.col("folder_id").isin(*folder_ids))


def take_over(files: DataFrame, child: int, parent: int) -> DataFrame:
    return files.withColumn("folder_id", F.when(F.col("folder_id") == child, F.lit(parent).cast("long")).otherwise(F.col("folder_id")))


def relocate(files: DataFrame, old: str, new: str) -> DataFrame:
    """Paths inside ``old`` moved to ``new``."""
    old, new = old.rstrip("\\/"), new.rstrip("\\/")
    inside = P.inside_range(P.normcase(F.col("path")), old.lower())
    return files.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1_000_000))).otherwise(F.col("path")))


def leave_out(files: DataFrame, left_out: DataFrame) -> DataFrame:
    """Files outside the subfolders left out (folder_id, path)."""
    x = left_out.select("folder_id", P.normcase(F.col("path")).alias("k")).distinct()
    above = files.select("id", "folder_id", F.explode(P.ancestors(P.normcase(F.col("path")))).alias("k"))
    return files.join(above.join(x, ["folder_id", "k"], "left_semi").select("id").distinct(), "id", "left_anti")


def reread(files: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents whose passages hold odd characters get mtime 0, so that the next scan reads them again."""
    odd = passages.where(X.has_odd_characters(F.col("text"))).select(F.col("file_id").alias("id")).distinct().withColumn("odd", F.lit(True))
    again = F.coalesce("odd", F.lit(False)) & (F.col("kind") == "doc")
    return files.join(odd, "id", "left").withColumn("mtime", F.when(again, 0.0).otherwise(F.col("mtime"))).drop("odd")


def without_pages(files: DataFrame, passages: DataFrame) -> DataFrame:
    """PDFs in the index of which passages have no page."""
    missing = passages.where(F.col("page").isNull()).select(F.col("file_id").alias("id"))
    pdf = files.where((F.col("status") == "indexed") & (P.suffix(F.col("path")) == ".pdf"))
    return pdf.join(missing, "id", "left_semi").select("id", "path")


def mute_errors(files: DataFrame, folder_id: int) -> DataFrame:
    seen = (F.col("folder_id") == folder_id) & (F.col("status") == "error")
    return files.withColumn("muted", F.when(seen, 1).otherwise(F.col("muted")))


#: Settings and their defaults.
DEFAULTS = {"kinds_off": [], "formats_off": [], "hidden_files": False, "program_folders": False, "archives_in_archives": True}


def settings(stored_values: dict, changes: dict | None = None) -> dict:
    """Settings with defaults and changes; an unknown key is an error."""
    unknown = set(changes or {}) - set(DEFAULTS)
    if unknown:
        raise KeyError(f"unknown setting: {', '.join(sorted(unknown))}")
    return {**DEFAULTS, **{k: v for k, v in stored_values.items() if k in DEFAULTS}, **(changes or {})}
