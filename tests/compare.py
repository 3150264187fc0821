"""Runs a query and its SQL on the same tables and compares the rows."""

import math
import os

DATA = os.environ.get("FILINGLOOM_TEST_DATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def both(spark, query, sql):
    """Sorted rows of the query and of the SQL, columns by name."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    df = query(spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = con.sql(sql)
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns), (found.columns, columns)
    return ours, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
