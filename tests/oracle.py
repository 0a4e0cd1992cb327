"""Runs a query and its SQL side by side, as the driver does."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    result = connection(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=key)
    assert len(got) == len(want), (len(got), len(want), got[:3], want[:3])
    assert got == want, [(g, w) for g, w in zip(got, want) if g != w][:4]
    return len(got)
