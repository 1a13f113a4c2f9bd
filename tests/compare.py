"""A query's rows and its SQL's rows in a comparable form."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(folder + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    import datetime
    import decimal

    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal, int)):
        return "%.9g" % v
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def both(spark, con, folder, query, sql):
    df = query(spark, folder)
    cols = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert sorted(con.sql(sql).columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    theirs = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())
    return ours, theirs
