"""Comparison of a query's rows with its DuckDB oracle's."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, decimal.Decimal)):
        return float(x)
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x)


def compare(spark_df, con, sql):
    """None, or what differs."""
    got_cols = sorted(spark_df.columns)
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != got_cols:
        return f"columns {got_cols} and {sorted(cols)}"
    order = [cols.index(c) for c in got_cols]
    want = sorted((tuple(plain(r[i]) for i in order) for r in want), key=str)
    got = sorted((tuple(plain(r[c]) for c in got_cols) for r in spark_df.collect()), key=str)
    if got == want:
        return None
    only = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only in Spark {only[0]}; only in SQL {only[1]}"
