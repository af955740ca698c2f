"""Processing only new or changed records: the target itself is the state.

A target is a folder with data folders (``base-…``, ``delta-…``) and a folder ``versions`` of small
manifests. A manifest ``00000007.json`` lists the data folders that make up version 7, oldest first, the one
that it added, and the names of the last source versions taken in. Output rows carry the source's key and
version (its signature), so what a run has to do is an anti join of the source against the target's current
rows; no side log of processed records exists that could disagree with the output.

Publishing writes the data folder first and then creates the next manifest by one exclusive step. Until that
step succeeds readers see the old version, so a run that dies anywhere before it leaves nothing but an orphan
folder, and is repeated as a whole; a run that died after it finds its source version in the manifest and
does nothing. A run names the version that it compared its source with: if another run has published since,
it fails and nothing of it is visible, so records are neither repeated nor set back.

Current rows are those of the latest data folder that has the key (merge on read), so a run writes only
what changed. When more than ``FOLDERS`` of them have gathered, the newest ones are folded into one, up to
the first that is larger than all behind it; so a record is rewritten a logarithmic number of times.

The exclusive step is a hard link in a local folder and an atomic rename that refuses an existing name
elsewhere, which HDFS and its like have. Object stores without such a rename are refused; for these
``exclusive`` can be given, a function of (path, bytes) that creates the object only if there is none and
says whether it did.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SEQ = "__seq"
FOLDERS, SOURCES = 8, 1000
#: Schemes of stores whose rename isn't atomic.
NOT_ATOMIC = frozenset("s3 s3a s3n gs oss cos wasb wasbs swift".split())


class ConcurrentPublish(RuntimeError):
    """Another run published first; nothing of this run is visible."""


class VersionedTarget:
    """Versions of a table in a folder.

    ``folders`` bounds how many data folders a version has; ``keep`` says which rows are still wanted when all
    of them are folded into one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Iterable[str], folders: int = FOLDERS, exclusive: Callable[[str, bytes], bool] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None):
        self.keep = keep
        self.spark, self.path, self.schema, self.key, self.folders, self.exclusive = spark, path.rstrip("/"), schema, list(key), folders, exclusive
        self._jvm = spark._jvm
        at = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self._scheme = self._fs.getScheme()
        if self._scheme in NOT_ATOMIC and exclusive is None:
            raise ValueError(f"{self._scheme} has no atomic rename: give a function that creates exclusively")

    def _p(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """The newest published version, 0 if there is none."""
        if not self._fs.exists(self._p("versions")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._p("versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "content": 0, "data": [], "bytes": [], "added": None, "sources": []}
        stream = self._fs.open(self._p("versions", f"{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _create(self, manifest: dict) -> None:
        """Make a manifest appear whole, or fail if its version is there."""
        final, body = self._p("versions", f"{manifest['version']:08d}.json"), json.dumps(manifest).encode()
        if self.exclusive is not None:
            if not self.exclusive(final.toString(), body):
                raise ConcurrentPublish(final.toString())
            return
        aside = self._p("versions", f".{uuid.uuid4().hex}.tmp")
        out = self._fs.create(aside, False)
        out.write(bytearray(body))
        out.close()
        try:
            if self._scheme == "file":
                os.link(aside.toUri().getPath(), final.toUri().getPath())
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(aside, final, none)
        except FileExistsError:
            raise ConcurrentPublish(final.toString()) from None
        except Exception as e:
            if self._fs.exists(final):
                raise ConcurrentPublish(final.toString()) from e
            raise
        finally:
            self._fs.delete(aside, False)

    def _union(self, names: list[str]) -> DataFrame:
        frames = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").withColumn(SEQ, F.lit(n)) for n, name in enumerate(names)]
        if not frames:
            return self.spark.createDataFrame([], self.schema).withColumn(SEQ, F.lit(0))
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _newest(self, names: list[str]) -> DataFrame:
        """The newest row of every key; one shuffle on the key, pre-aggregated."""
        rows = self._union(names)
        if len(names) <= 1:
            return rows.drop(SEQ)
        rest = [c for c in self.schema.fieldNames() if c not in self.key]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.col(SEQ)).alias("__row"))
        return newest.select(*self.key, *[F.col(f"__row.{c}").alias(c) for c in rest])

    def deltas(self, since: int = 0) -> DataFrame:
        """All rows that were published, whether folded since or not; ``since`` leaves out so many first runs."""
        added = [self.manifest(v)["added"] for v in range(1, self.version() + 1)]
        return self._union([name for name in added if name][since:])

    def unmerged(self) -> DataFrame:
        """All rows of the newest version, for tables whose keys never come twice: no shuffle."""
        return self._union(self.manifest()["data"]).drop(SEQ)

    def added(self, version: int) -> DataFrame:
        """The rows that one version added."""
        name = self.manifest(version)["added"]
        return self._union([name] if name else []).drop(SEQ)

    def current(self, version: int | None = None) -> DataFrame:
        """The newest row of every key, of the newest version or an older one."""
        return self._newest(self.manifest(version)["data"])

    def _write(self, rows: DataFrame, kind: str) -> tuple[str, int]:
        name = f"{kind}-{uuid.uuid4().hex[:12]}"
        rows.select(*self.schema.fieldNames()).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name, int(self._fs.getContentSummary(self._p(name)).getLength())

    def publish(self, rows: DataFrame, source: str, kind: str = "delta", base: int | None = None) -> int:
        """Write ``rows`` as the next version and name ``source`` as taken in; returns the version.

        ``base`` is the version that the rows were made against; if more has been published since, the run
        fails. Repeated sources are known among the last ``SOURCES`` names; an older one is taken in again,
        which hands on nothing, as its records are no longer new.
        """
        seen = self.manifest()
        if source in seen["sources"]:
            return seen["version"]
        if base is not None and self.manifest(base)["content"] != seen["content"]:
            raise ConcurrentPublish(f"{self.path}: published after version {base}")
        name, size = self._write(rows, kind)
        data, sizes = ([name], [size]) if kind == "base" else ([*seen["data"], name], [*seen["bytes"], size])
        version = seen["version"] + 1
        self._create({"version": version, "content": seen["content"] + 1, "data": data, "bytes": sizes, "added": name, "sources": [*seen["sources"], source][-SOURCES:]})
        if len(data) > self.folders:
            first = len(sizes) - 2
            while first > 0 and sizes[first - 1] <= 2 * sum(sizes[first:]):
                first -= 1
            try:
                self._fold(first)
            except ConcurrentPublish:
                pass  # a later run folds
        return version

    def _fold(self, first: int) -> int:
        seen = self.manifest()
        if len(seen["data"]) - first < 2:
            return seen["version"]
        rows = self._newest(seen["data"][first:])
        name, size = self._write(rows, "delta") if first else self._write(self.keep(rows) if self.keep else rows, "base")
        self._create({**seen, "version": seen["version"] + 1, "data": [*seen["data"][:first], name], "bytes": [*seen["bytes"][:first], size], "added": None})
        return seen["version"] + 1

    def compact(self) -> int:
        """Fold all data folders into one; readers of older versions aren't disturbed."""
        return self._fold(0)

    def clean(self, older: float = 86_400.0) -> list[str]:
        """Delete data folders that no version names and that are older than so many seconds: what dead runs left."""
        named = {n for v in range(1, self.version() + 1) for m in [self.manifest(v)] for n in (*m["data"], m["added"])}
        gone = []
        for status in self._fs.listStatus(self._p()) if self._fs.exists(self._p()) else []:
            name = status.getPath().getName()
            if name.startswith(("base-", "delta-")) and name not in named and status.getModificationTime() / 1000 < time.time() - older:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return gone


def new_or_changed(
    source: DataFrame, target: DataFrame, key: list[str], same: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]
) -> DataFrame:
    """Rows of ``source`` without a row of ``target`` of the same key that ``same`` accepts.

    ``same(s, t)`` gets functions that give a column of the source and of the target. A null or false
    ``same`` counts as changed; a null in the key is a key like any other, so such records are neither
    lost nor repeated. ``source`` must hold a key at most once; ``target`` too.
    """
    t = target.select(*[F.col(c).alias(f"__t_{c}") for c in target.columns])
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    accepted = F.coalesce(same(F.col, lambda c: F.col(f"__t_{c}")), F.lit(False))
    return source.join(t, on & accepted, "left_anti")


def run_once(
    target: VersionedTarget, source: DataFrame, source_name: str, process: Callable[[DataFrame], DataFrame],
    same: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
) -> int:
    """One run: what is new or changed against the target is processed and published under ``source_name``.

    The version that was compared with is the one published on; if another run published in between this one
    raises ``ConcurrentPublish`` and can be repeated.
    """
    seen = target.manifest()
    if source_name in seen["sources"]:
        return seen["version"]
    rows = process(new_or_changed(source, target.current(seen["version"]), target.key, same))
    return target.publish(rows, source_name, base=seen["version"])
