"""Views of the driver's tables in the shapes that the operators take, in SQL that Spark and DuckDB both run.

``{orders}`` and so on are tables; ``{runs}`` and so on are other views of this module."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: A run of a source: five sources, two runs in five repeat an earlier content.
RUNS = """SELECT o_orderpriority AS source_id, o_orderkey AS run_id, CAST(o_orderdate AS TIMESTAMP) AS observed_at,
  md5(o_orderstatus || CAST(o_custkey % 3 AS STRING)) AS content_hash,
  CASE WHEN o_custkey % 11 = 0 THEN 'failed' WHEN o_custkey % 3 = 0 THEN 'unchanged' ELSE 'stored' END AS status FROM {orders}"""

#: Observations with distinct times: the least run of a source and day.
STORED = """SELECT source_id, min(run_id) AS run_id, observed_at, min(content_hash) AS content_hash FROM {runs} WHERE status = 'stored' GROUP BY source_id, observed_at"""

#: Features of snapshots: a snapshot a source (line status) and year; up to seven features share a base, a part. Two
#: parts share a place, four places a neighbourhood. Two parts in ten are points or lines; one in seven moves by a hair.
FEATURES = """SELECT source_id, obs, layer_key, base || '#' || CAST(ln AS STRING) AS logical_key, base AS base_key, base || '#' || CAST(ln AS STRING) || layer_key || '@' || CAST(obs AS STRING) AS feature_id,
  md5(base || CAST(v AS STRING) || CAST(ln AS STRING)) AS content_hash, CAST(CASE WHEN b % 3 = 0 THEN 1.0 ELSE 0.65 END AS DOUBLE) AS confidence,
  md5(CAST(g AS STRING) || base) AS geometry_hash, md5(CAST(v % 2 AS STRING)) AS props_hash, kind, place,
  CAST(x + shift AS DOUBLE) AS w, CAST(y AS DOUBLE) AS s, CAST(x + shift + CASE WHEN kind = 'point' THEN 0.0 ELSE 0.1 END AS DOUBLE) AS e, CAST(y + CASE WHEN kind = 'point' THEN 0.0 ELSE 0.1 END AS DOUBLE) AS n,
  b, v, g FROM (
  SELECT *, CASE b % 10 WHEN 8 THEN 'point' WHEN 9 THEN 'line' ELSE 'polygon' END AS kind, g * CASE WHEN b % 7 = 0 THEN 0.0001 ELSE 0.004 END AS shift,
    -170.0 + CAST(floor(place / 4) AS BIGINT) % 150 * 2.0 + place % 4 * 0.3 AS x, -60.0 + CAST(floor(place / 600) AS BIGINT) % 120 AS y FROM (
  SELECT l_linestatus AS source_id, l_returnflag AS layer_key, l_partkey AS b, CAST(floor(l_partkey / 2) AS BIGINT) AS place, l_linenumber AS ln,
    l_linestatus || ':' || CAST(l_partkey AS STRING) AS base, max(l_orderkey) % 4 AS v, CAST(floor((max(l_orderkey) % 8) / 4) AS BIGINT) AS g,
    dense_rank() OVER (PARTITION BY l_linestatus ORDER BY year(l_shipdate)) - 1 AS obs
  FROM {lineitem} GROUP BY l_linestatus, year(l_shipdate), l_returnflag, l_partkey, l_linenumber) t) u"""

LAYERS = """SELECT source_id, obs, layer_key, 'Layer ' || layer_key AS label, CASE WHEN layer_key = 'A' THEN 'polygon' ELSE 'line' END AS geometry_type,
  CASE WHEN sum(v) % 3 = 0 THEN '#ff0000' WHEN sum(v) % 3 = 1 THEN '#00ff00' ELSE '#0000ff' END AS paint, CASE layer_key WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ordinal
  FROM {features} GROUP BY source_id, obs, layer_key"""

OBSERVATIONS = """SELECT DISTINCT source_id, obs, CAST('2024-01-01' AS DATE) AS base_day FROM {features}"""

#: Geolocated events: one in nine lies outside the region, some dates are before retention.
GEO_EVENTS = """SELECT substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS uuid,
  substr(CAST(ts AS STRING), 1, 19) AS timestamp_text, CAST(ts AS DATE) AS event_date, CAST(ts AS TIMESTAMP) AS occurred_at,
  CAST(44.0 + (event_id % 97) * 0.1 AS DOUBLE) AS lat, CAST(22.0 + (event_id % 211) * 0.1 AS DOUBLE) AS lon,
  event_type || ' near place ' || CAST(user_id AS STRING) AS description, 'f' || CAST(length(event_type) AS STRING) AS faction_id, event_type AS faction_name,
  CASE WHEN user_id % 2 = 0 THEN '#112233' ELSE '#445566' END AS faction_color, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'i' || CAST(user_id % 7 AS STRING) END AS icon_id,
  CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'Icon ' || CAST(user_id % 7 AS STRING) END AS icon_name, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'origin ' || CAST(user_id % 4 AS STRING) END AS origin,
  'item ' || CAST(event_id % 13 AS STRING) AS equipment, 'unit ' || CAST(user_id % 17 AS STRING) AS units, md5(event_type || CAST(user_id AS STRING)) AS source_hash, event_id AS updated_at, event_id
  FROM (SELECT *, md5(CAST(event_id AS STRING)) AS m FROM {events}) t"""

#: What a new pull holds: six of seven events, of which one in five has changed.
PULL = """SELECT uuid, event_date, CASE WHEN event_id % 5 = 0 THEN md5(source_hash) ELSE source_hash END AS source_hash, event_id FROM {geo_events} WHERE event_id % 7 <> 0"""

BOOK = """SELECT 't' || CAST(l_partkey AS STRING) AS token, CASE WHEN l_returnflag = 'A' THEN 'bid' ELSE 'ask' END AS side,
  CASE WHEN l_returnflag = 'A' THEN l_discount * 4 + 0.05 ELSE 0.5 + l_discount * 4 END AS price, sum(l_quantity) AS size FROM {lineitem} GROUP BY 1, 2, 3"""

POINTS = """SELECT 't' || CAST(user_id AS STRING) AS token, CASE WHEN event_id % 19 = 0 THEN 'bad' ELSE CAST(event_id AS STRING) END AS t, CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(value AS STRING) END AS p FROM {events}"""

#: Markets: titles over nations, in three types, some with a description's target.
MARKETS = """SELECT p_partkey AS row_id, CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'slug-' || CAST(p_partkey % 500 AS STRING) END AS slug,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'event-' || CAST(p_partkey % 60 AS STRING) || '-' || CAST(CAST(floor(p_partkey / 1500) AS BIGINT) AS STRING) END AS event_slug,
  CASE p_partkey % 3 WHEN 0 THEN 'Will Russia capture all of ' WHEN 1 THEN 'Will Russia capture the ' ELSE 'Will Russia enter ' END || n_name || CASE WHEN p_partkey % 5 = 0 THEN ' (again)' ELSE '' END || ' by June ' || CAST(1 + p_partkey % 30 AS STRING) || '?' AS title,
  'This market resolves when Russia captures the ' || p_name || ' located at ' || CAST(44 + p_partkey % 8 AS STRING) || '.5, ' || CAST(30 + p_partkey % 9 AS STRING) || '.25 in the city of ' || n_name || ', Region' AS description, n_name AS nation, 'City of ' || n_name AS stored_name,
  CASE p_partkey % 3 WHEN 0 THEN 'capture_all' WHEN 1 THEN 'capture' ELSE 'enter' END AS type, 'c' || CAST(n_nationkey AS STRING) AS city_id,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 'resolved' ELSE 'active' END AS status, CASE WHEN p_partkey % 14 = 0 THEN false WHEN p_partkey % 7 = 0 THEN true ELSE NULL END AS active,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'label ' || CAST(p_partkey % 11 AS STRING) END AS target_label, CAST(CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 44.5 + p_partkey % 8 END AS DOUBLE) AS lat, CAST(CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 30.25 + p_partkey % 9 END AS DOUBLE) AS lon,
  CASE WHEN p_partkey % 10 = 0 THEN 'soon' ELSE '2025-0' || CAST(1 + p_partkey % 9 AS STRING) || '-1' || CAST(p_partkey % 10 AS STRING) END AS resolved_at, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE '2025-0' || CAST(1 + p_partkey % 9 AS STRING) || '-01' END AS deadline,
  CASE WHEN p_partkey % 2 = 0 THEN 'No' ELSE 'Yes' END AS outcome, '["Yes","No"]' AS outcomes,
  CASE p_partkey % 4 WHEN 0 THEN '["1","0"]' WHEN 1 THEN '["0","1"]' WHEN 2 THEN '["0.4","0.6"]' ELSE 'broken' END AS prices, '["t' || CAST(p_partkey AS STRING) || '","x"]' AS tokens, p_partkey % 3 <> 0 AS closed, CAST(p_size AS DOUBLE) / 100 AS last_price
  FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25"""

TEXTS = """SELECT doc_id AS id, 'see https://x.com/user' || CAST(doc_id AS STRING) || '/status/' || CAST(doc_id * 7 AS STRING) || ', and (https://t.me/ch' || CAST(doc_id % 9 AS STRING) || '/' || CAST(doc_id AS STRING) || '). at 48.' || CAST(100 + doc_id % 800 AS STRING) || ', 37.' || CAST(100 + doc_id % 700 AS STRING) || ' ' || coalesce(text, '') AS text, lang || ', ' || source || ';' || lang || ' ;' AS names FROM {documents}"""

#: Boxes and points around them.
BOXES = """SELECT 's' || CAST(s_suppkey AS STRING) AS settlement_id, CAST(30.0 + (s_suppkey % 20) * 0.5 AS DOUBLE) AS w, CAST(44.0 + CAST(floor(s_suppkey / 20) AS BIGINT) * 0.5 AS DOUBLE) AS s, CAST(30.4 + (s_suppkey % 20) * 0.5 AS DOUBLE) AS e, CAST(44.4 + CAST(floor(s_suppkey / 20) AS BIGINT) * 0.5 AS DOUBLE) AS n, 'Town ' || CAST(s_suppkey AS STRING) AS name_en, 'Місто ' || CAST(s_suppkey % 50 AS STRING) AS name_ua FROM {supplier}"""
PLACES = """SELECT 'p' || CAST(c_custkey AS STRING) AS point_id, CAST(30.05 + (c_custkey % 200) * 0.1 AS DOUBLE) AS lon, CAST(44.05 + (c_custkey % 60) * 0.1 AS DOUBLE) AS lat, c_custkey AS k FROM {customer}"""

VIEWS = {"runs": RUNS, "stored": STORED, "features": FEATURES, "layers": LAYERS, "observations": OBSERVATIONS, "geo_events": GEO_EVENTS, "pull": PULL, "book": BOOK, "points": POINTS, "markets": MARKETS, "texts": TEXTS, "boxes": BOXES, "places": PLACES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver's, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "features":
        return _features(spark, sf_dir)
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in set(re.findall(r"\{([a-z_]+)\}", sql))})


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features view, with the plan that its SQL leaves open: lines are dealt once, by base, before anything is made of them,
    so that operators that work by base find their rows together. The years of a source (one row each) are numbered apart,
    not over all its features in one task."""
    lines = view(spark, sf_dir, "lineitem").selectExpr("l_linestatus", "l_returnflag", "l_partkey", "l_linenumber", "l_orderkey", "year(l_shipdate) AS shipyear", "l_linestatus || ':' || CAST(l_partkey AS STRING) AS base")
    years = lines.groupBy("l_linestatus", "shipyear").agg(F.lit(0).alias("n"))
    years = spark.sql("SELECT l_linestatus, shipyear, dense_rank() OVER (PARTITION BY l_linestatus ORDER BY shipyear) - 1 AS obs FROM {years}", years=years)
    dealt = lines.repartition("l_linestatus", "base")
    rows = dealt.groupBy("l_linestatus", "base", "shipyear", "l_returnflag", "l_partkey", "l_linenumber").agg(F.max("l_orderkey").alias("m"))
    null_safe = rows["l_linestatus"].eqNullSafe(years["l_linestatus"]) & rows["shipyear"].eqNullSafe(years["shipyear"])
    rows = rows.join(F.broadcast(years), null_safe).select(rows["*"], "obs")
    inner = """SELECT l_linestatus AS source_id, l_returnflag AS layer_key, l_partkey AS b, CAST(floor(l_partkey / 2) AS BIGINT) AS place, l_linenumber AS ln, base, m % 4 AS v, CAST(floor((m % 8) / 4) AS BIGINT) AS g, obs FROM {rows}"""
    head, tail = FEATURES.split("  SELECT l_linestatus AS source_id")[0], ") t) u"
    return spark.sql(head + inner + tail, rows=rows)


def expand(sql: str) -> str:
    """The same SQL for DuckDB: views become common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\{([a-z_]+)\}", text):
            if n in VIEWS and n not in need:
                add(VIEWS[n])
                need.append(n)

    add(sql)
    flat = lambda text: re.sub(r"\{([a-z_]+)\}", r"\1", text)
    ctes = ", ".join(f"{n} AS ({flat(VIEWS[n])})" for n in need)
    body = flat(sql)
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.startswith("WITH ") else f"WITH {ctes} {body}"
