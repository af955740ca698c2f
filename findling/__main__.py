"""``python -m findling WHAT …``: what an operator makes of its input, as one JSON line per row.

extract FILE…: text or reason; walk FOLDER: files with rule and decision; open ARCHIVE…: what containers hold;
terms QUERY…: words a query is searched by; embed TEXT…: the first numbers of the stand-in's vectors.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from findling.functions import text as X
from findling.operators.embedding import embed
from findling.session import local_session
from findling.sources.containers import read_containers
from findling.sources.documents import read_documents
from findling.sources.walk import files_of, ruled


def rows(spark: SparkSession, what: str, given: list[str]) -> DataFrame:
    def bodies() -> DataFrame:
        return spark.createDataFrame([(Path(p).name, bytearray(Path(p).read_bytes())) for p in given], "path string, content binary")

    if what == "extract":
        return read_documents(bodies())
    if what == "walk":
        return ruled(files_of(spark, Path(given[0]).resolve().as_uri())).orderBy("path")
    if what == "open":
        return read_containers(bodies()).select("path", "size", "mtime", "problem")
    texts = spark.createDataFrame([(t,) for t in given], "text string")
    if what == "terms":
        return texts.select("text", X.query_terms(F.col("text")).alias("terms"), X.looks_like_identifier(F.col("text")).alias("identifier"))
    if what == "embed":
        return embed(texts, "text").select("text", F.slice("vector", 1, 8).alias("vector"), "embed_error")
    raise SystemExit(__doc__)


def main(argv: list[str]) -> None:
    if len(argv) < 2:
        raise SystemExit(__doc__)
    for row in rows(local_session("*", 8), argv[0], argv[1:]).toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


if __name__ == "__main__":
    main(sys.argv[1:])
