"""Queries on keys larger than those of the small tables, against their SQL."""

import os

import duckdb
import pytest
from compare import connect, same
from pyspark.sql import functions as F

from terradelta.operators import identity, markets
from terradelta.plans.registry import ORACLES, QUERIES
from terradelta.sources import readers

SF = "/root/testdata/sf0.001"


def shifted(path, table, **columns):
    """The driver's tables, one of them with other keys: column = expression."""
    for name in os.listdir(SF):
        if name != f"{table}.parquet":
            os.symlink(f"{SF}/{name}", path / name)
    change = ", ".join(f"CAST({e} AS BIGINT) AS {c}" for c, e in columns.items())
    duckdb.sql(f"COPY (SELECT * REPLACE ({change}) FROM '{SF}/{table}.parquet') TO '{path}/{table}.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["feature_looks", "layer_default_paint"])
def test_colours_of_parts_beyond_a_million(spark, tmp_path, name):
    """a colour has six digits, whatever the part's number."""
    d = shifted(tmp_path, "lineitem", l_partkey="l_partkey + 999900")
    assert same(spark, connect(d), QUERIES[name], ORACLES[name], d)


def test_identities_without_broadcast_joins(spark):
    """tables too large to broadcast keep the matches by nearness, which a union of joined parts lost."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.unionOutputPartitioning": "true"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(60_000).select(F.lit("s").alias("source_id"), (F.col("id") % 2).alias("obs"), F.concat(F.lit("b"), F.floor(F.col("id") / 6)).alias("base_key"), F.col("id").cast("string").alias("row_id"), F.md5(F.col("id").cast("string")).alias("content_hash"), F.lit(0.65).alias("confidence"), F.rand(1).alias("lon"), F.rand(2).alias("lat"))
        found = identity.fold_identities(rows).groupBy("obs", "confidence").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(tuple(r) for r in found) == [(0, 0.45, 30_000), (1, 0.55, 30_000)]


def test_polygons_beyond_the_web_map(spark, tmp_path):
    """answers in degrees keep latitudes that web maps don't have, as those of settlements with large numbers."""
    d = shifted(tmp_path, "supplier", s_suppkey="s_suppkey + 1600")
    assert same(spark, connect(d), QUERIES["arcgis_polygons"], ORACLES["arcgis_polygons"], d)
    (tmp_path / "a.json").write_text('{"spatialReference": {"wkid": 4326}, "features": [{"attributes": {"name": "a"}, "geometry": {"rings": [[[30.0, 86.5], [31.0, 86.5], [31.0, 87.0]]]}}]}')
    assert [(p.x, p.y) for p in readers.read_arcgis(spark, str(tmp_path / "a.json")).first()["rings"][0]] == [(30.0, 86.5), (31.0, 86.5), (31.0, 87.0)]


def test_names_that_are_alike_are_looked_up_once(spark):
    """the substring search meets distinct variants, not names, with the gazetteer."""
    names = spark.range(300).select(F.col("id").alias("name_id"), F.concat(F.lit("own "), F.col("id") % 3 + 1).alias("name"))
    towns = spark.range(40).select(F.concat(F.lit("s"), "id").alias("settlement_id"), F.concat(F.lit("Town "), "id").alias("name_en"), F.lit("").alias("name_ua"))
    out = markets.settlement_by_name(names.unionByName(spark.sql("SELECT 900L AS name_id, 'own 39' AS name UNION ALL SELECT 901L, 'town 7'")), towns)
    assert sorted(map(tuple, out.collect())) == [(900, "s39"), (901, "s7")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [variant") >= 4
