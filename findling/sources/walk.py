"""Files of a folder tree, with the rules for what is passed by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findling.functions import filetypes as T, paths as P


def files_of(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """``path, size, mtime`` (and bytes) of all files below a root; names as they are on disk.

    The listing is Spark's own; bytes are only read where a query asks for them.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:/+", "/"), "^" + root.rstrip("/").replace("file://", "").replace(".", r"\."), "")
    cols = [F.regexp_replace(below, r"^/", "").alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime")]
    return raw.select(*cols, *(["content"] if content else []))


def ruled(files: DataFrame, off: tuple[str, ...] = (), formats_off: tuple[str, ...] = ()) -> DataFrame:
    """Files with ``reason`` (why they are passed by, or null) and ``decision`` (how they are read)."""
    parts = F.filter(F.split("path", r"[\\/]"), lambda x: x != "")
    cache = files.where(P.base_name(F.col("path")) == "CACHEDIR.TAG").select(P.normcase(P.dir_name(F.col("path"))).alias("k")).distinct()
    marked = files.withColumn("above", F.explode_outer(P.ancestors(P.normcase(F.col("path"))))).join(cache, F.col("above") == F.col("k"), "left_semi").select("path").distinct().withColumn("cached", F.lit(True))
    reason = F.coalesce(T.skip_path(parts), F.when(F.col("cached"), "program_folder"))
    return files.join(marked, "path", "left").select(*files.columns, reason.alias("reason"), T.decide(F.col("path"), off, formats_off).alias("decision"))


def _system(root: str):
    """A file system that tasks can open, and the root's path in it."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = root.rpartition("://")
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), rest.rstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest.rstrip('/'))}")


def read_files(paths: DataFrame, root: str, hold: int = 32 * 1024 * 1024) -> DataFrame:
    """``path, content, problem`` of the files that ``paths`` (path, most) lists below a root; no other is opened.

    A file of more than ``most`` bytes isn't read (``too_large``); one that can't be is a row with its reason.
    """

    def run(batches):
        import pyarrow as pa

        system, base = _system(root)

        def made(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], ["path", "content", "problem"])

        for batch in batches:
            rows, held = [], 0
            for path, most in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body, problem = None, None
                try:
                    with system.open_input_file(f"{base}/{path}") as f:
                        if most is not None and f.size() > most:
                            problem = "too_large"
                        else:
                            body = f.read()
                except FileNotFoundError:
                    problem = "gone"
                except PermissionError:
                    problem = "no_access"
                except OSError:
                    problem = "in_use"
                rows.append((path, body, problem))
                held += len(body or b"")
                if held > hold:  # handed on piece by piece, so that big files don't add up
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return paths.select("path", F.col("most").cast("long")).mapInArrow(run, "path string, content binary, problem string")


def stat_files(paths: DataFrame, root: str) -> DataFrame:
    """``path, size, mtime`` of what ``paths`` (path) names below a root and is there now: files, and all in folders."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = _system(root)
        for batch in batches:
            found: dict[str, tuple] = {}
            for path in batch.column(0).to_pylist():
                infos = system.get_file_info([f"{base}/{path}".rstrip("/")])
                if infos[0].type == fs.FileType.Directory:
                    infos = system.get_file_info(fs.FileSelector(infos[0].path, recursive=True))
                for i in infos:
                    if i.type == fs.FileType.File:
                        found[i.path[len(base) + 1 :]] = (i.size, (i.mtime_ns or 0) // 1_000_000 / 1000)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.float64())], ["path", "size", "mtime"])

    return paths.select(F.regexp_replace("path", r"\\", "/").alias("path")).mapInArrow(run, "path string, size bigint, mtime double").distinct()
