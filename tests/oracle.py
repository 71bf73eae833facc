"""Runs a query and its SQL on the same folder and compares the rows."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def assert_same(df, sql, folder):
    found = connect(folder).execute(sql)
    names = [c[0] for c in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    ours = sorted([plain(v) for v in r] for r in df.select(*columns).collect())
    theirs = sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert ours == theirs
