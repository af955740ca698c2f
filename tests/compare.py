"""A query's rows against its SQL in DuckDB on the same tables, whatever their order."""

import glob
import math
import os

import duckdb

SF = os.environ.get("FINDLING_TEST_TABLES", "/root/testdata/sf0.001")


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=str)


def rows_of_sql(sql, sf=SF):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    cols = sorted(names)
    at = [names.index(n) for n in cols]
    return cols, sorted((tuple(shown(r[i]) for i in at) for r in got.fetchall()), key=str)
