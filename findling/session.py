"""Sessions, test tables and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "folders", "files", "containers", "sightings", "passages",
    "mails", "layout", "results", "scans", "queries", "vectorhits", "evalset", "labels",
)


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster the caller brings their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("findling")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FINDLING_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python, once for a context, unless they find it by themselves."""
    sc = spark.sparkContext
    if getattr(sc, "_findling_shipped", False):
        return
    on_path = str(ROOT) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    same_folder = sc.master.startswith("local") and not sc.master.startswith("local-") and Path.cwd() == ROOT
    if not (same_folder or (on_path and sc.master.startswith("local"))):
        archive = Path(tempfile.mkdtemp(prefix="findling-")) / "findling_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((ROOT / "findling").rglob("*.py")):
                z.write(f, f.relative_to(ROOT))
        sc.addPyFile(str(archive))
    sc._findling_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set, but only in local mode: on a cluster a
    folder of one machine can't be read by the others, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_before.get() if set_before.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="findling-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder for a table that cuts lineage."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"


_made: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at the end; nothing that reads them may leave."""
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        jvm = spark._jvm
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe if executors are lost."""
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, what)
    for made in _made:
        made.append(path)
    w = df.write.option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of ``df`` at the driver, where a bound on their number is known; more is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; raise the bound or use the distributed way")
    return rows
