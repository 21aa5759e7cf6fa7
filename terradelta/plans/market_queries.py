"""Driver queries over prediction markets and settlements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import markets as mk
from .snapshot_queries import rings_of
from .views import view as V

Q: dict = {}
O: dict[str, str] = {}


def add(name: str, fn, sql: str | None = None) -> None:
    Q[name] = fn
    if sql:
        O[name] = sql


def texts_of() -> F.Column:
    return F.array("title", "description")


def stored(s, d) -> DataFrame:
    """The archive: every third market, placed; positions by row."""
    return V(s, d, "markets").where("row_id % 3 = 0").withColumn("position", F.col("row_id"))


def cities(s, d) -> DataFrame:
    m = V(s, d, "markets").where("row_id % 2 = 0")
    return m.groupBy("city_id").agg(F.min("row_id").alias("position"), F.min("stored_name").alias("name"))


def remote(s, d) -> DataFrame:
    m = V(s, d, "markets").where("row_id % 5 <> 0")
    return m.select("id", "closed", text.decode_list(F.col("outcomes")).alias("outcomes"), text.decode_list(F.col("prices")).alias("prices"), text.decode_list(F.col("tokens")).alias("tokens"), "last_price", F.when(F.col("row_id") % 4 == 0, F.lit("")).otherwise(F.lit("2025-01-02")).alias("closed_time"), F.when(F.col("row_id") % 3 == 0, F.lit("2025-01-03")).alias("resolution_time"), F.lit("2025-01-04").alias("updated_at"), F.lit("2025-01-05").alias("end_date"))


def book(s, d) -> DataFrame:
    return V(s, d, "book")


PARSED = "(SELECT *, CASE row_id % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS won FROM {markets})"
NAMED = "regexp_replace(nation, '^(the )?city of ', '')"

add("market_rows", lambda s, d: mk.explode_events(V(s, d, "markets").groupBy("city_id", F.floor(F.col("row_id") / 1000).alias("doc"), "event_slug").agg(F.collect_list(F.struct("id", "slug", "closed")).alias("markets")).groupBy("city_id", "doc").agg(F.collect_list(F.struct(F.col("event_slug").alias("slug"), F.lit("t").alias("title"), "markets")).alias("events"))).select("event_slug", "id", "slug", "closed"),
    "SELECT event_slug, id, slug, closed FROM {markets}")
add("market_types", lambda s, d: V(s, d, "markets").select("id", text.market_type(texts_of()).alias("type")), "SELECT id, type FROM {markets}")
add("market_city_names", lambda s, d: V(s, d, "markets").select("id", text.city_name(texts_of()).alias("name"), text.normal_city(text.city_name(texts_of())).alias("plain"), text.city_name(F.array("description")).alias("told")),
    "SELECT id, CASE WHEN row_id % 3 = 1 THEN 'the ' ELSE '' END || nation || CASE WHEN row_id % 5 = 0 THEN ' (again)' ELSE '' END AS name, CASE WHEN row_id % 3 = 1 THEN 'the ' ELSE '' END || nation AS plain, nation AS told FROM {markets}")
add("market_targets", lambda s, d: V(s, d, "markets").select("id", text.target_label(F.col("title"), F.col("description"), F.col("nation")).alias("label"), text.target_label(F.col("title"), F.lit(None).cast("string"), F.col("nation")).alias("stem"), text.coordinates(F.col("description"))["lat"].alias("lat")),
    "SELECT id, upper(p_name[1]) || substr(p_name, 2) AS label, CASE row_id % 3 WHEN 0 THEN 'all of ' || nation WHEN 1 THEN nation ELSE 'Will Russia enter ' || nation END || CASE WHEN row_id % 5 = 0 THEN ' (again)' ELSE '' END AS stem, CAST(CAST(44 + row_id % 8 AS VARCHAR) || '.5' AS DOUBLE) AS lat FROM {markets} JOIN {part} ON p_partkey = row_id")
add("market_stems", lambda s, d: V(s, d, "markets").select("id", text.question_stem(F.col("title")).alias("stem"), text.deadline_text(F.col("title")).alias("by")),
    "SELECT id, CASE row_id % 3 WHEN 0 THEN 'will russia capture all of ' WHEN 1 THEN 'will russia capture the ' ELSE 'will russia enter ' END || replace(lower(nation), '_', ' ') || CASE WHEN row_id % 5 = 0 THEN ' again' ELSE '' END AS stem, 'June ' || CAST(1 + row_id % 30 AS VARCHAR) AS by FROM {markets}")
add("market_status", lambda s, d: remote(s, d).select("id", text.settled_outcome(F.col("outcomes"), F.col("prices")).alias("won")).join(V(s, d, "markets").select("id", "closed"), "id").select("id", "won", text.market_status(F.col("closed"), F.col("won")).alias("status")),
    f"SELECT id, won, CASE WHEN NOT closed THEN 'active' WHEN won IS NULL THEN 'closed' ELSE 'resolved' END AS status FROM {PARSED} p WHERE row_id % 5 <> 0")
add("market_deadlines", lambda s, d: V(s, d, "markets").select("id", text.deadline({"endDate": F.col("deadline"), "closedTime": F.col("slug")}, {"endDate": F.when(F.col("row_id") % 18 == 0, F.lit("event end"))}).alias("deadline")),
    "SELECT id, coalesce(deadline, CASE WHEN row_id % 18 = 0 THEN 'event end' END, nullif(slug, '')) AS deadline FROM {markets}")
add("market_odds", lambda s, d: remote(s, d).select("id", text.yes_no(F.col("outcomes"), F.col("prices"), F.col("tokens"), F.col("last_price")).alias("o")).select("id", F.round("o.yes", 6).alias("yes"), F.round("o.no", 6).alias("no"), "o.token"),
    "SELECT id, round(CASE row_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.4 ELSE last_price END, 6) AS yes, round(CASE row_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 1 - last_price END, 6) AS no, 't' || CAST(row_id AS VARCHAR) AS token FROM {markets} WHERE row_id % 5 <> 0")
add("markets_active", lambda s, d: V(s, d, "markets").select("id", mk.is_active(F.col("status"), F.col("active")).alias("is_active"), mk.migrate_status(F.col("status"), F.col("active")).alias("new_status")),
    "SELECT id, CASE WHEN status IS NOT NULL THEN status = 'active' ELSE coalesce(active, true) END AS is_active, coalesce(status, CASE WHEN coalesce(active, true) THEN 'active' ELSE 'closed' END) AS new_status FROM {markets}")
add("markets_matched", lambda s, d: mk.match_stored(V(s, d, "markets"), stored(s, d)).select("row_id", "stored_id"),
    "SELECT m.row_id, least((SELECT min(x.row_id) FROM {markets} x WHERE x.row_id % 3 = 0 AND x.slug = m.slug AND m.slug <> ''), CASE WHEN m.row_id % 3 = 0 THEN m.row_id END) AS stored_id FROM {markets} m")
add("markets_reconciled", lambda s, d: mk.reconcile_status(V(s, d, "markets").select("id", "status", "active"), remote(s, d)),
    f"SELECT id, CASE WHEN row_id % 5 <> 0 THEN CASE WHEN NOT closed THEN 'active' WHEN won IS NULL THEN 'closed' ELSE 'resolved' END ELSE coalesce(status, CASE WHEN coalesce(active, true) THEN 'active' ELSE 'closed' END) END AS new_status, CASE WHEN row_id % 5 <> 0 AND closed THEN won END AS outcome, CASE WHEN row_id % 5 <> 0 AND closed THEN CASE WHEN row_id % 4 <> 0 THEN '2025-01-02' WHEN row_id % 3 = 0 THEN '2025-01-03' ELSE '2025-01-04' END END AS closed_at, CASE WHEN row_id % 5 <> 0 AND closed AND won IS NOT NULL THEN CASE WHEN row_id % 3 = 0 THEN '2025-01-03' WHEN row_id % 4 <> 0 THEN '2025-01-02' ELSE '2025-01-04' END END AS resolved_at FROM {PARSED} p")
add("settlements_by_point", lambda s, d: mk.settlement_by_point(V(s, d, "places"), V(s, d, "boxes").withColumn("rings", rings_of(F.col("w"), F.col("s"), F.col("e"), F.col("n")))),
    "SELECT point_id, min(settlement_id) AS settlement_id FROM {places} JOIN {boxes} ON lon >= w AND lon < e AND lat >= s AND lat < n GROUP BY 1 HAVING count(*) = 1")


def asked(s, d) -> DataFrame:
    p = V(s, d, "places")
    n = (F.col("k") % 130).cast("string")
    return p.select(F.col("point_id").alias("name_id"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("city of town-"), n)).when(F.col("k") % 9 == 0, F.concat(F.lit("місто "), (F.col("k") % 50).cast("string"))).otherwise(F.concat(F.lit("own "), n)).alias("name"))


add("settlements_by_name", lambda s, d: mk.settlement_by_name(asked(s, d), V(s, d, "boxes")),
    """WITH a AS (SELECT point_id AS name_id, k, CASE WHEN k % 2 = 0 THEN 'city of town-' || CAST(k % 130 AS VARCHAR) WHEN k % 9 = 0 THEN 'місто ' || CAST(k % 50 AS VARCHAR) ELSE 'own ' || CAST(k % 130 AS VARCHAR) END AS name FROM {places}),
v AS (SELECT name_id, unnest(CASE WHEN k % 2 = 0 THEN [name, regexp_replace(name, '^city of ', ''), replace(name, '-', ' '), replace(regexp_replace(name, '^city of ', ''), '-', ' ')] ELSE [name] END) AS variant, unnest(CASE WHEN k % 2 = 0 THEN [0, 1, 2, 3] ELSE [0] END) AS v FROM a),
f AS (SELECT settlement_id, 0 AS f, upper(name_en) AS n FROM {boxes} UNION ALL SELECT settlement_id, 1, upper(name_ua) FROM {boxes}),
x AS (SELECT name_id, v, f, count(DISTINCT settlement_id) AS k, min(settlement_id) AS settlement_id FROM v JOIN f ON upper(variant) = n GROUP BY 1, 2, 3),
xe AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY name_id ORDER BY v, f) = 1),
y AS (SELECT name_id, v, f, count(DISTINCT settlement_id) AS k, min(settlement_id) AS settlement_id FROM v JOIN f ON contains(n, upper(variant)) WHERE name_id NOT IN (SELECT name_id FROM xe) GROUP BY 1, 2, 3),
ye AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY name_id ORDER BY v, f) = 1)
SELECT name_id, settlement_id FROM xe WHERE k = 1 UNION ALL SELECT name_id, settlement_id FROM ye WHERE k = 1""")  # fmt: skip
add("cities_by_name", lambda s, d: mk.existing_city(V(s, d, "markets").select(F.col("id").alias("name_id"), F.concat(F.upper("nation"), F.lit(" (old), Region")).alias("name")), cities(s, d)),
    "SELECT id AS name_id, city_id FROM {markets} WHERE city_id IN (SELECT city_id FROM {markets} WHERE row_id % 2 = 0)")


def to_place(s, d) -> DataFrame:
    m = V(s, d, "markets").where("row_id % 3 <> 0")
    return m.select("row_id", "event_slug", "title", F.when(F.col("row_id") % 4 == 1, F.array("title")).otherwise(F.array(F.lit("nothing"))).alias("texts"))


add("markets_backfilled", lambda s, d: mk.backfill_city(to_place(s, d), stored(s, d).where("row_id % 6 = 0"), cities(s, d).where("city_id <> 'c4'"), V(s, d, "markets").where("row_id % 11 = 1").select("row_id", F.lit("s1").alias("settlement_id"))),
    """WITH st AS (SELECT *, CASE row_id % 3 WHEN 0 THEN 'will russia capture all of ' WHEN 1 THEN 'will russia capture the ' ELSE 'will russia enter ' END || replace(lower(nation), '_', ' ') || CASE WHEN row_id % 5 = 0 THEN ' again' ELSE '' END AS stem FROM {markets}),
c AS (SELECT * FROM st WHERE row_id % 6 = 0), a AS (SELECT event_slug, stem, arg_min(city_id, row_id) AS stem_city FROM c GROUP BY 1, 2), o AS (SELECT event_slug, min(city_id) AS only_city FROM c GROUP BY 1 HAVING count(DISTINCT city_id) = 1),
n AS (SELECT st.row_id, st.city_id AS named_city FROM st WHERE row_id % 4 = 1 AND row_id % 3 <> 1 AND city_id <> 'c4' AND city_id IN (SELECT city_id FROM {markets} WHERE row_id % 2 = 0))
SELECT row_id, coalesce(stem_city, named_city, only_city, CASE WHEN row_id % 11 = 1 AND row_id % 4 = 1 THEN 's1' END) AS city_id, CASE WHEN stem_city IS NOT NULL THEN 'stem' WHEN named_city IS NOT NULL THEN 'name' WHEN only_city IS NOT NULL THEN 'only' WHEN row_id % 11 = 1 AND row_id % 4 = 1 THEN 'settlement' END AS rule
FROM st LEFT JOIN a USING (event_slug, stem) LEFT JOIN n USING (row_id) LEFT JOIN o USING (event_slug) WHERE row_id % 3 <> 0""")  # fmt: skip
add("markets_live", lambda s, d: mk.live_view(V(s, d, "markets").select("id"), remote(s, d), V(s, d, "points"), book(s, d)).select("id", "closed", F.round("yes", 6).alias("yes"), "token", "n_points", "n_levels"),
    "WITH p AS (SELECT token, count(*) AS k FROM {points} WHERE t <> 'bad' AND p IS NOT NULL GROUP BY 1), b AS (SELECT token, count(*) AS k FROM {book} GROUP BY 1) SELECT m.id, m.closed, round(CASE row_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.4 ELSE last_price END, 6) AS yes, 't' || CAST(row_id AS VARCHAR) AS token, coalesce(p.k, 0) AS n_points, coalesce(b.k, 0) AS n_levels FROM {markets} m LEFT JOIN p ON p.token = 't' || CAST(row_id AS VARCHAR) LEFT JOIN b ON b.token = CASE WHEN NOT closed THEN 't' || CAST(row_id AS VARCHAR) END WHERE row_id % 5 <> 0")
add("markets_missing", lambda s, d: mk.missing(V(s, d, "markets").select("id"), remote(s, d)), "SELECT count(*) AS missing, CASE WHEN count(*) = 0 THEN 'ok' ELSE 'partial' END AS status FROM {markets} WHERE row_id % 5 = 0")
add("price_history", lambda s, d: mk.clean_history(V(s, d, "points")), "SELECT token, CAST(t AS BIGINT) AS t, CAST(p AS DOUBLE) AS p FROM {points} WHERE t <> 'bad' AND p IS NOT NULL")
add("price_history_refreshed", lambda s, d: mk.refreshed_history(mk.clean_history(V(s, d, "points").where("t < '5'")), V(s, d, "points").where("token < 't5'")).groupBy("token").agg(F.count("*").alias("n")),
    "SELECT token, count(*) AS n FROM {points} WHERE t <> 'bad' AND p IS NOT NULL AND (token < 't5' OR (t < '5' AND token NOT IN (SELECT token FROM {points} WHERE t <> 'bad' AND p IS NOT NULL AND token < 't5'))) GROUP BY 1")
add("book_depth", lambda s, d: mk.depth(book(s, d)).select("token", "side", F.round("price", 4).alias("price"), F.round("total", 4).alias("total"), F.round("depth", 6).alias("depth")),
    "SELECT token, side, round(price, 4) AS price, round(sum(price * size) OVER (PARTITION BY token, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, size ROWS UNBOUNDED PRECEDING), 4) AS total, round(sum(price * size) OVER (PARTITION BY token, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, size ROWS UNBOUNDED PRECEDING) / sum(price * size) OVER (PARTITION BY token, side), 6) AS depth FROM {book}")
add("book_spreads", lambda s, d: mk.spreads(book(s, d)).select("token", F.round("bid", 4).alias("bid"), F.round("ask", 4).alias("ask"), F.round("spread", 4).alias("spread")),
    "SELECT token, round(max(price) FILTER (side = 'bid'), 4) AS bid, round(min(price) FILTER (side = 'ask'), 4) AS ask, round(min(price) FILTER (side = 'ask') - max(price) FILTER (side = 'bid'), 4) AS spread FROM {book} GROUP BY 1")
STEM = "CASE row_id % 3 WHEN 0 THEN 'will russia capture all of ' WHEN 1 THEN 'will russia capture the ' ELSE 'will russia enter ' END || replace(lower(nation), '_', ' ') || CASE WHEN row_id % 5 = 0 THEN ' again' ELSE '' END"
add("markets_grouped", lambda s, d: mk.grouped_events(V(s, d, "markets")).select("key", "label", "type", "n", F.md5("search").alias("search")),
    f"WITH m AS (SELECT *, coalesce(target_label, {STEM}) AS label FROM {{markets}}), k AS (SELECT *, CASE WHEN event_slug <> '' THEN event_slug ELSE lower(label) END AS key FROM m) SELECT key, arg_min(label, row_id) AS label, CASE min(CASE type WHEN 'capture_all' THEN 1 WHEN 'capture' THEN 2 ELSE 3 END) WHEN 1 THEN 'capture_all' WHEN 2 THEN 'capture' ELSE 'enter' END AS type, count(*) AS n, md5(lower(string_agg(concat_ws(' ', title, slug, target_label), ' ' ORDER BY row_id))) AS search FROM k GROUP BY key")
ACTIVE = "CASE WHEN status IS NOT NULL THEN status = 'active' ELSE coalesce(active, true) END"
add("cities_active", lambda s, d: mk.active_cities(V(s, d, "markets")),
    f"SELECT city_id, count(*) AS n_active, CASE min(CASE type WHEN 'capture_all' THEN 1 WHEN 'capture' THEN 2 ELSE 3 END) WHEN 1 THEN 'capture_all' WHEN 2 THEN 'capture' ELSE 'enter' END AS type, coalesce(string_agg(DISTINCT target_label, '|' ORDER BY target_label), '') AS labels FROM {{markets}} WHERE {ACTIVE} GROUP BY 1")
add("capture_objectives", lambda s, d: mk.objectives(V(s, d, "markets")),
    f"SELECT city_id, CASE WHEN event_slug <> '' THEN event_slug ELSE CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) END AS key, count(*) AS n, arg_min(lat, row_id) AS lat, arg_min(lon, row_id) AS lon FROM {{markets}} WHERE {ACTIVE} AND type = 'capture' AND lat IS NOT NULL GROUP BY 1, 2")
add("markets_resolved", lambda s, d: mk.resolved_feed(V(s, d, "markets")).select("id", F.date_format("at", "yyyy-MM-dd").alias("at")), "SELECT id, CASE WHEN resolved_at = 'soon' THEN '1970-01-01' ELSE resolved_at END AS at FROM {markets} WHERE status = 'resolved'")
add("markets_resolved_events", lambda s, d: mk.resolved_events(V(s, d, "markets")),
    f"SELECT city_id, type, CASE WHEN event_slug <> '' THEN event_slug ELSE {STEM} END AS event, count(*) AS n, max(resolved_at) AS resolved_at, string_agg(id, ',' ORDER BY deadline NULLS LAST, id) AS ids FROM {{markets}} WHERE status = 'resolved' GROUP BY 1, 2, 3")
add("market_status_counts", lambda s, d: mk.status_counts(V(s, d, "markets").withColumn("status", F.coalesce("status", F.lit("none"))).withColumn("city_id", F.when(F.col("row_id") % 4 != 0, F.col("city_id"))).withColumn("name", F.when(F.col("row_id") % 3 == 0, F.lit("DONETSK Oblast")).when(F.col("row_id") % 5 != 0, F.col("nation")))),
    "SELECT 'status:' || coalesce(status, 'none') AS what, count(*) AS n FROM {markets} GROUP BY 1 UNION ALL SELECT 'unresolved:' || CASE WHEN row_id % 3 = 0 THEN 'no_place' WHEN row_id % 5 = 0 THEN 'no_name' ELSE 'not_found' END, count(*) FROM {markets} WHERE row_id % 4 = 0 GROUP BY 1")
add("markets_found", lambda s, d: mk.search(V(s, d, "markets"), "Enter  NATION-1").select("id"), "SELECT id FROM {markets} WHERE row_id % 3 = 2 AND (nation = 'NATION_1' OR nation LIKE 'NATION_1%') AND outcome <> 'No'")
