"""Rows of a Spark query and of its SQL on the same tables, in comparable form."""

import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if x is None or x != x:
        return "NULL"
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted("|".join(map(plain, r)) for r in pdf.astype(object).itertuples(index=False, name=None))


def same(spark_df, sql, sf):
    got, want = canonical(spark_df.toPandas()), canonical(duck(sf).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
