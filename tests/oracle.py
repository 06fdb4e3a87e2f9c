"""Spark's rows against DuckDB's."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(map(_plain, value))
    return value


def compare(spark, sf_dir, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
    got = con.execute(sql)
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(c) for c in names]
    theirs = sorted((tuple(_plain(row[k]) for k in at) for row in got.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    assert ours == theirs
