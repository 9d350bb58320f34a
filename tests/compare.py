"""Spark result against DuckDB: names, rows and values, in any order."""

import datetime
import decimal
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v else "0"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def same(df, con, sql):
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = con.execute(sql)
    cols = [d[0] for d in cursor.description]
    assert sorted(cols) == names
    at = [cols.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert ours == theirs
    return len(ours)
