"""Prediction markets: matching, places, status, live data, grouped views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import contains, grid_cells
from ..functions.text import city_name, filled, market_status, normal_city, question_stem, settled_outcome, yes_no

#: Market types, the strongest first, and words that are no place.
TYPES = ("capture_all", "capture", "enter")
NO_PLACE = ("donetsk oblast",)
OUTCOME_NO = "no"


def type_rank(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in TYPES]), kind), F.lit(0)), F.lit(len(TYPES)))


def is_active(status: Column, active: Column) -> Column:
    """P5: status 'active' where there is a status, else anything but active = false."""
    return F.when(filled(status).isNotNull(), status == "active").otherwise(F.coalesce(active, F.lit(True)))


def migrate_status(status: Column, active: Column) -> Column:
    """P5: a status for rows that only have ``active``."""
    return F.when(status.isin("active", "resolved", "closed"), status).when(F.coalesce(active, F.lit(True)), "active").otherwise("closed")


def explode_events(payloads: DataFrame) -> DataFrame:
    """Event x market rows from search payloads (events array)."""
    e = payloads.select(F.explode("events").alias("e"))
    return e.select(F.col("e.slug").alias("event_slug"), F.col("e.title").alias("event_title"), F.explode("e.markets").alias("m")).select("event_slug", "event_title", "m.*")


def match_keys(markets: DataFrame) -> DataFrame:
    """A row (row_id, key) for each filled id and slug of a market: 'or' becomes one equi-join."""
    keys = F.array(F.when(F.col("id") != "", F.concat(F.lit("id:"), "id")), F.when(F.col("slug") != "", F.concat(F.lit("slug:"), "slug")))
    return markets.select("row_id", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def match_stored(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Each candidate's first stored market with its id or its slug; null for new ones."""
    met = match_keys(candidates).join(match_keys(stored).select(F.col("row_id").alias("stored_id"), "key"), "key")
    first = met.groupBy("row_id").agg(F.min("stored_id").alias("stored_id"))
    return candidates.join(first, "row_id", "left")


def settlement_by_point(points: DataFrame, settlements: DataFrame, step: float = 0.5) -> DataFrame:
    """The settlement whose polygon holds a point (point_id, lon, lat), if exactly one does. Settlements:
    (settlement_id, rings, w, s, e, n); they meet points by grid cell."""
    cells = settlements.withColumn("cell", F.explode(grid_cells(F.col("w"), F.col("s"), F.col("e"), F.col("n"), step)))
    at = points.withColumn("cell", F.struct(F.floor(F.col("lon") / step).alias("cx"), F.floor(F.col("lat") / step).alias("cy")))
    near = at.join(cells, "cell").where(F.col("lon").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
    inside = near.where(contains(F.col("rings"), F.col("lon"), F.col("lat")))
    return inside.groupBy("point_id").agg(F.count("*").alias("n"), F.min("settlement_id").alias("settlement_id")).where("n = 1").select("point_id", "settlement_id")


def name_variants(name: Column) -> Column:
    """A name, its normal form, and both with spaces for dashes."""
    two = F.filter(F.array(name, normal_city(name)), lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(F.concat(two, F.transform(two, lambda v: F.replace(v, F.lit("-"), F.lit(" ")))))


def settlement_by_name(names: DataFrame, settlements: DataFrame) -> DataFrame:
    """The one settlement that a name (name_id, name) finds: variants equal to its English, then its other
    name; if none is, variants found within either. The first variant and field with hits decides; it must
    have exactly one. Variants are looked up once, however many names share them. Equality is an equi-join; names without any go on to the substring search, which meets the
    gazetteer's names by the variant's first three letters (all of a shorter one) among theirs, then tests."""
    tries = names.select("name_id", F.posexplode(name_variants(F.col("name"))).alias("v", "variant")).withColumn("variant", F.upper("variant"))
    fields = settlements.select("settlement_id", F.explode(F.array(F.struct(F.lit(0).alias("f"), F.upper("name_en").alias("n")), F.struct(F.lit(1).alias("f"), F.upper("name_ua").alias("n")))).alias("x")).select("settlement_id", "x.*").where("n <> ''")

    def decided(tries: DataFrame, met: DataFrame) -> DataFrame:
        told = met.groupBy("variant", "f").agg(F.count_distinct("settlement_id").alias("k"), F.min("settlement_id").alias("settlement_id"))
        best = told.groupBy("variant").agg(F.min(F.struct("f", "k", "settlement_id")).alias("t"))
        hits = tries.join(best, "variant").groupBy("name_id").agg(F.min(F.struct("v", "t")).alias("h"))
        return hits.select("name_id", F.col("h.t.k").alias("k"), F.col("h.t.settlement_id").alias("settlement_id"))

    known = tries.select("variant").distinct()
    exact = decided(tries, known.join(fields, known["variant"] == fields["n"]))
    rest = tries.join(exact, "name_id", "left_anti")
    cut = lambda size: F.transform(F.sequence(F.lit(1), F.length("n") - size + 1), lambda i: F.substring("n", i, F.lit(size)))
    grams = F.flatten(F.array(*[F.when(F.length("n") >= k, cut(k)).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3)]))
    held = fields.withColumn("gram", F.explode(F.array_distinct(grams)))
    asked = rest.select("variant").distinct().withColumn("gram", F.substring("variant", 1, 3))
    within = decided(rest, asked.join(held, "gram").where(F.col("n").contains(F.col("variant"))))
    return exact.unionByName(within).where("k = 1").select("name_id", "settlement_id")


def existing_city(names: DataFrame, cities: DataFrame) -> DataFrame:
    """The first stored city (position, city_id, name) with a name's normal form, in any case."""
    key = lambda c: F.lower(normal_city(F.col(c)))
    stored = cities.select("city_id", "position", key("name").alias("k"))
    met = names.select("name_id", key("name").alias("k")).where("k <> ''").join(stored, "k")
    return met.groupBy("name_id").agg(F.min_by("city_id", "position").alias("city_id"))


def backfill_city(markets: DataFrame, stored: DataFrame, cities: DataFrame, settled: DataFrame) -> DataFrame:
    """A city for each market (row_id, event_slug, title, texts) by the first rule that gives one: a stored
    market of the event with the same question stem; the city its texts name; the event's only city; the
    settlement found for it (row_id, settlement_id), unless the name is no place."""
    m = markets.withColumn("stem", question_stem(F.col("title"))).withColumn("name", city_name(F.col("texts")))
    contexts = stored.select("event_slug", "city_id", "position", question_stem(F.col("title")).alias("stem"))
    by_stem = contexts.groupBy("event_slug", "stem").agg(F.min_by("city_id", "position").alias("stem_city"))
    only = contexts.groupBy("event_slug").agg(F.count_distinct("city_id").alias("k"), F.min("city_id").alias("only_city")).where("k = 1").drop("k")
    named = existing_city(m.select(F.col("row_id").alias("name_id"), "name"), cities).select(F.col("name_id").alias("row_id"), F.col("city_id").alias("named_city"))
    out = m.join(by_stem, ["event_slug", "stem"], "left").join(named, "row_id", "left").join(only, "event_slug", "left").join(settled, "row_id", "left")
    place = ~F.lower(normal_city(F.col("name"))).isin(*NO_PLACE)
    rules = [("stem", F.col("stem_city")), ("name", F.col("named_city")), ("only", F.col("only_city")), ("settlement", F.when(place, F.col("settlement_id")))]
    rule = F.coalesce(*[F.when(c.isNotNull(), F.lit(r)) for r, c in rules])
    return out.select("row_id", F.coalesce(*[c for _, c in rules]).alias("city_id"), rule.alias("rule"))


def reconcile_status(archive: DataFrame, remote: DataFrame) -> DataFrame:
    """The archive's status, outcome and times by the remote state of each id; without one, as migrated."""
    r = remote.select(F.col("id"), "closed", settled_outcome(F.col("outcomes"), F.col("prices")).alias("won"), "closed_time", "resolution_time", "updated_at", "end_date")
    j = archive.join(r, "id", "left")
    known = F.col("closed").isNotNull()
    new = market_status(F.col("closed"), F.col("won"))
    status = F.when(known, new).otherwise(migrate_status(F.col("status"), F.col("active")))
    closed_at = F.when(known & (new != "active"), filled(*[F.col(c) for c in ("closed_time", "resolution_time", "updated_at", "end_date")]))
    resolved_at = F.when(known & (new == "resolved"), filled(*[F.col(c) for c in ("resolution_time", "closed_time", "updated_at", "end_date")]))
    return j.select("id", status.alias("new_status"), F.when(new == "resolved", F.col("won")).alias("outcome"), closed_at.alias("closed_at"), resolved_at.alias("resolved_at"))


def live_view(references: DataFrame, remote: DataFrame, history: DataFrame, book: DataFrame) -> DataFrame:
    """Referenced markets with their odds, price history and, while open, their order book. References that
    have no remote market are left out (see missing)."""
    r = remote.select(F.col("id"), "closed", yes_no(F.col("outcomes"), F.col("prices"), F.col("tokens"), F.col("last_price").cast("double")).alias("o"))
    m = references.join(r, "id").select("id", "closed", "o.yes", "o.no", "o.token")
    points = clean_history(history).groupBy("token").agg(F.count("*").alias("n_points"), F.max_by("p", "t").alias("last_p"))
    levels = book.groupBy("token").agg(F.count("*").alias("n_levels"))
    open_token = F.when(~F.col("closed"), F.col("token"))
    out = m.join(points, "token", "left").withColumn("open_token", open_token)
    out = out.join(levels.withColumnRenamed("token", "open_token"), "open_token", "left")
    return out.select("id", "closed", "yes", "no", "token", F.coalesce("n_points", F.lit(0)).alias("n_points"), "last_p", F.coalesce("n_levels", F.lit(0)).alias("n_levels"))


def missing(references: DataFrame, remote: DataFrame) -> DataFrame:
    """How many references have no remote market, and the status: ok or partial."""
    n = references.join(remote.select("id"), "id", "left_anti").agg(F.count("*").alias("missing"))
    return n.select("missing", F.when(F.col("missing") == 0, "ok").otherwise("partial").alias("status"))


def clean_history(history: DataFrame) -> DataFrame:
    """Price points (token, t, p) whose time and price are numbers; whole seconds."""
    t, p = F.col("t").try_cast("double"), F.col("p").try_cast("double")
    ok = t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p)
    return history.where(ok).select("token", t.cast("long").alias("t"), p.alias("p"))


def refreshed_history(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """A token's fresh points where it has any, else the cached ones."""
    new = clean_history(fresh)
    return new.unionByName(cached.join(new.select("token").distinct(), "token", "left_anti"))


def depth(levels: DataFrame) -> DataFrame:
    """Order-book levels (token, side, price, size) with the running total of price x size from the best price
    and its share of the side's total."""
    worth = F.col("price") * F.col("size")
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    one = W.partitionBy("token", "side")
    run = F.sum(worth).over(one.orderBy(best, "size").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum(worth).over(one)
    return levels.select("token", "side", "price", "size", run.alias("total"), (run / F.when(whole == 0, 1.0).otherwise(whole)).alias("depth"))


def spreads(levels: DataFrame) -> DataFrame:
    """Best bid, best ask and their spread for each token."""
    out = levels.groupBy("token").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask"))
    return out.withColumn("spread", F.col("ask") - F.col("bid"))


def grouped_events(markets: DataFrame) -> DataFrame:
    """Markets by event slug, else by normal label: strongest type, label, search text; by label."""
    title = F.coalesce(filled(F.col("title")), filled(F.col("slug")), F.lit("Untitled market"))
    label = F.coalesce(filled(F.col("target_label")), question_stem(title))
    m = markets.withColumn("t", title).withColumn("label", label).withColumn("key", F.coalesce(filled(F.col("event_slug")), F.lower("label")))
    text = F.concat_ws(" ", "t", "slug", "target_label")
    out = m.groupBy("key").agg(F.count("*").alias("n"), F.min(type_rank(F.col("type"))).alias("rank"), F.min_by("label", "row_id").alias("label"), F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", text.alias("x")))), lambda s: s["x"]), " ")).alias("search"))
    return out.withColumn("type", F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("rank").cast("int"))).select("key", "label", "type", "n", "search").orderBy("label", "key")


def active_cities(markets: DataFrame) -> DataFrame:
    """Cities with active markets: their number, strongest type and labels."""
    m = markets.where(is_active(F.col("status"), F.col("active")))
    out = m.groupBy("city_id").agg(F.count("*").alias("n_active"), F.min(type_rank(F.col("type"))).alias("rank"), F.array_join(F.array_sort(F.collect_set("target_label")), "|").alias("labels"))
    return out.select("city_id", "n_active", F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.col("rank").cast("int")).alias("type"), "labels")


def objectives(markets: DataFrame) -> DataFrame:
    """Active capture markets with a target by city and event, else by place."""
    m = markets.where(is_active(F.col("status"), F.col("active")) & (F.col("type") == "capture") & F.col("lat").isNotNull())
    key = F.coalesce(filled(F.col("event_slug")), F.concat_ws(",", "lon", "lat"))
    return m.groupBy("city_id", key.alias("key")).agg(F.count("*").alias("n"), F.min_by("lat", "row_id").alias("lat"), F.min_by("lon", "row_id").alias("lon"))


def resolved_feed(markets: DataFrame) -> DataFrame:
    """K3: resolved markets, newest first; times that don't parse count as the epoch and come last."""
    m = markets.where("status = 'resolved'").withColumn("at", F.coalesce(F.try_to_timestamp("resolved_at"), F.lit("1970-01-01").cast("timestamp")))
    return m.orderBy(F.desc("at"), "id")


def resolved_events(markets: DataFrame) -> DataFrame:
    """Resolved markets by city, type and event: their number, the latest time, titles by deadline (none last);
    newest first."""
    key = F.coalesce(filled(F.col("event_slug")), question_stem(F.col("title")))
    order = F.struct(F.col("deadline").isNull().alias("a"), F.col("deadline").alias("b"), F.col("id").alias("id"))
    out = markets.where("status = 'resolved'").groupBy("city_id", "type", key.alias("event")).agg(F.count("*").alias("n"), F.max("resolved_at").alias("resolved_at"), F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda s: s["id"]), ",").alias("ids"))
    return out.orderBy(F.desc("resolved_at"), "city_id", "type", "event")


def status_counts(markets: DataFrame) -> DataFrame:
    """Markets by status, and those without a city by reason."""
    by_status = markets.groupBy(F.concat(F.lit("status:"), "status").alias("what")).count()
    reason = F.when(F.col("name").isNull(), "no_name").when(F.lower("name").isin(*NO_PLACE), "no_place").otherwise("not_found")
    lost = markets.where("city_id IS NULL").groupBy(F.concat(F.lit("unresolved:"), reason).alias("what")).count()
    return by_status.unionByName(lost).withColumnRenamed("count", "n")


def search(markets: DataFrame, text: str, with_no: bool = False) -> DataFrame:
    """K4: markets whose normal text holds the normal query; those that ended 'no' only if asked."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    rows = markets.where(normal(F.concat_ws(" ", "title", "slug", "target_label")).contains(normal(F.lit(text))))
    return rows if with_no else rows.where(F.lower(F.coalesce("outcome", F.lit(""))) != OUTCOME_NO)
