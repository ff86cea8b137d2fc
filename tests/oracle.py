"""Compare a query with its SQL on the small test tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata/sf0.001")


def rows_of(frame):
    names = sorted(frame.columns)
    out = []
    for row in frame[names].itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row))
    return names, sorted(out)


def compare(spark, query, sql, data=DATA):
    c = duckdb.connect()
    for p in data.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    assert rows_of(query(spark, str(data)).toPandas()) == rows_of(c.sql(sql).df())
