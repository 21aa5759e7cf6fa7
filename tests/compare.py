"""Runs a query and its SQL side by side on the driver's tables."""

import math

import duckdb

from terradelta.plans.views import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def same(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    mine, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(list(rel.columns), rel.fetchall())
    assert mine == theirs
    return mine
