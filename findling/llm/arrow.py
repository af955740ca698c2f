"""Arrow batches in and out of Python functions, in slices small enough for an executor's memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from findling.session import ship


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: T.StructType | str, slice_rows: int = 2000) -> DataFrame:
    """``mapInArrow`` with columns as Python lists; ``fn`` maps a slice's columns to output columns."""
    ship(df.sparkSession)
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                got = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)
