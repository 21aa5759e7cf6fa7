"""Geolocated events: admission, merging of feeds, upsert, reconciliation, daily views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import filled, parse_instant, precision, row_hash, split_names, urls

#: The region of interest (south, north, west, east), and the looks of unknown factions.
REGION = (43.575, 52.925, 21.075, 41.425)
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
NO_FACTION, NO_COLOR = "Unknown", "#666666"


def near_region(lat: Column, lon: Column) -> Column:
    """Within the region, edges included; numbers that don't parse are outside."""
    south, north, west, east = REGION
    inside = lat.try_cast("double").between(south, north) & lon.try_cast("double").between(west, east)
    return F.coalesce(inside, F.lit(False))


def day_query(events: DataFrame, day: Column, faction: str | None = None, icon: str | None = None, origin: str | None = None, text: str | None = None) -> DataFrame:
    """A day's events in the region, as filtered; ``text`` is found literally, in any case. Newest first by
    timestamp text, then uuid."""
    rows = events.where((F.col("event_date") == day) & near_region(F.col("lat"), F.col("lon")))
    for column, value in (("faction_id", faction), ("icon_id", icon), ("origin", origin)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if text is not None:
        hit = [F.coalesce(F.lower(c).contains(F.lower(F.lit(text))), F.lit(False)) for c in ("description", "equipment", "units")]
        rows = rows.where(hit[0] | hit[1] | hit[2])
    return rows.orderBy(F.desc("timestamp_text"), "uuid")


def admit(rows: DataFrame, retention_start: Column, today: Column) -> DataFrame:
    """Rows with a well-formed uuid whose timestamp parses to a date from retention_start to today. The date is
    the timestamp's own, without a change of zone."""
    day = F.to_date(parse_instant(F.col("timestamp_text")))
    rows = rows.withColumn("event_date", day)
    return rows.where(F.col("uuid").rlike(UUID) & day.isNotNull() & (day >= retention_start) & (day <= today))


def merge_feeds(csv: DataFrame, index: DataFrame, icons: DataFrame) -> DataFrame:
    """CSV rows, with what the index and the icon table know of them. Index wins for place, time and faction;
    empty values fall back: index, icon, CSV, default."""
    c, i, k = csv.alias("c"), index.alias("i"), icons.alias("k")
    j = c.join(i, F.trim("c.id") == F.col("i.id"), "left").join(k, F.col("i.icon_id") == F.col("k.icon_id"), "left")
    col = F.col
    stamp = filled(col("i.timestamp_text"), col("c.date"))
    return j.select(
        F.trim("c.id").alias("uuid"), stamp.alias("timestamp_text"), precision(stamp).alias("time_precision"),
        F.coalesce("i.lat", col("c.latitude").try_cast("double")).alias("lat"), F.coalesce("i.lon", col("c.longitude").try_cast("double")).alias("lon"),
        F.trim(F.coalesce(filled(col("c.description"), col("c.name")), F.lit(""))).alias("description"),
        F.coalesce(filled(col("i.faction_id"), col("k.faction_id")), F.lit("")).alias("faction_id"),
        F.coalesce(filled(col("i.faction_name"), col("c.faction")), F.lit(NO_FACTION)).alias("faction_name"),
        F.coalesce(filled(col("i.faction_color"), col("k.faction_color")), F.lit(NO_COLOR)).alias("faction_color"),
        F.nullif("i.icon_id", F.lit("")).alias("icon_id"), col("k.icon_name"), filled(col("i.icon_path"), col("k.icon_path")).alias("icon_path"),
        F.trim(F.coalesce("c.origin", F.lit(""))).alias("origin"), F.trim(F.coalesce("c.equipment", F.lit(""))).alias("equipment"), F.trim(F.coalesce("c.units", F.lit(""))).alias("units"),
        urls(col("c.source")).alias("evidence_links"), urls(col("c.geolocation")).alias("geolocation_links"),
        split_names(col("c.equipment_items")).alias("gear_items"), split_names(col("c.orbat_units")).alias("orbat_units"),
        row_hash(*[col(f"c.{x}") for x in sorted(csv.columns)]).alias("source_hash"),
    )


def enrich(changed: DataFrame, details: DataFrame, icons: DataFrame, factions: DataFrame) -> DataFrame:
    """Changed events with their detail rows: a detail's filled fields win; the icon is found by its path, the
    faction by its name."""
    d = details.select("uuid", *[F.col(x).alias(f"d_{x}") for x in ("description", "faction", "icon", "lat", "lon")])
    j = changed.join(d, "uuid", "left").join(icons.select("icon_path", F.col("icon_id").alias("k_id"), F.col("icon_name").alias("k_name")), F.col("d_icon") == F.col("icon_path"), "left")
    f = factions.select(F.col("faction_name").alias("f_name"), F.col("faction_id").alias("f_id"), F.col("faction_color").alias("f_color"))
    j = j.join(f, F.coalesce(filled(F.col("d_faction")), F.col("faction_name")) == F.col("f_name"), "left")
    return j.select("uuid", F.coalesce(filled(F.col("d_description")), F.col("description")).alias("description"), F.coalesce(filled(F.col("d_faction")), F.col("faction_name")).alias("faction_name"), F.coalesce("f_id", F.lit("")).alias("faction_id"), F.coalesce("f_color", F.lit(NO_COLOR)).alias("faction_color"), F.coalesce("d_lat", "lat").alias("lat"), F.coalesce("d_lon", "lon").alias("lon"), F.col("k_id").alias("icon_id"), F.col("k_name").alias("icon_name"))


def detect_changes(incoming: DataFrame, store: DataFrame, since: Column) -> DataFrame:
    """Incoming rows whose hash the store (pruned to dates from ``since``) lacks or has otherwise."""
    known = store.where(F.col("event_date") >= since).select("uuid", F.col("source_hash").alias("known"))
    return incoming.join(known, "uuid", "left").where(~F.col("known").eqNullSafe(F.col("source_hash"))).drop("known")


def upsert(store: DataFrame, changed: DataFrame) -> DataFrame:
    """The store with changed rows put in place of those with their uuid, as a table. On disk it is
    sources.versions.upsert_version, which rewrites only the days that change."""
    return store.join(changed.select("uuid"), "uuid", "left_anti").unionByName(changed)


def reconcile(store: DataFrame, pulled: DataFrame, retention_start: Column) -> DataFrame:
    """Without recent rows that the full pull lacks; older rows stay. On disk: sources.versions.keep_version."""
    recent = store.where(F.col("event_date") >= retention_start).join(pulled.select("uuid").distinct(), "uuid", "left_semi")
    return recent.unionByName(store.where(F.col("event_date") < retention_start))


def daily_counts(events: DataFrame, first: Column, last: Column) -> DataFrame:
    """Events a day, with zeros for days without."""
    spine = events.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("event_date"))
    n = events.groupBy("event_date").agg(F.count("*").alias("n"))
    return spine.join(n, "event_date", "left").select("event_date", F.coalesce("n", F.lit(0)).alias("n"))


def facets(events: DataFrame) -> DataFrame:
    """The distinct factions, icons and origins of the events, as rows (facet, id, name, color), sorted."""
    factions = events.select(F.lit("faction").alias("facet"), F.col("faction_id").alias("id"), F.col("faction_name").alias("name"), F.col("faction_color").alias("color"))
    icons = events.where(F.col("icon_id").isNotNull()).select(F.lit("icon").alias("facet"), F.col("icon_id").alias("id"), F.coalesce("icon_name", F.lit("Uncategorized")).alias("name"), F.lit(None).cast("string").alias("color"))
    origins = events.where(F.col("origin") != "").select(F.lit("origin").alias("facet"), F.col("origin").alias("id"), F.col("origin").alias("name"), F.lit(None).cast("string").alias("color"))
    return factions.unionByName(icons).unionByName(origins).distinct().orderBy("facet", "name", "id")


def latest_factions(events: DataFrame) -> DataFrame:
    """Each faction's newest attributes by updated_at, then uuid."""
    last = events.groupBy("faction_name").agg(F.max(F.struct("updated_at", "uuid", "faction_id", "faction_color")).alias("x"))
    return last.select("faction_name", "x.faction_id", "x.faction_color")


def icon_stubs(events: DataFrame, icons: DataFrame) -> DataFrame:
    """A stub row for each icon that events name but the icon table lacks."""
    need = events.where(F.col("icon_id").isNotNull()).select("icon_id").distinct()
    return need.join(icons, "icon_id", "left_anti")


def compare_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Uuids whose hashes differ, or that one side lacks; repeated rows count."""
    x, y = a.select("uuid", "source_hash"), b.select("uuid", "source_hash")
    return x.exceptAll(y).withColumn("side", F.lit("only_left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("only_right")))


def flat_index(factions: DataFrame) -> DataFrame:
    """Event rows from an index of factions, their icons and placemarks; a later row of an id wins."""
    f = factions.select(F.posexplode("factions").alias("fp", "f")).select("fp", F.col("f.*"))
    i = f.select("fp", "factionId", "name", "color", F.posexplode("icons").alias("ip", "i"))
    p = i.select("fp", "factionId", "name", "color", "ip", "i.iconId", "i.icon", F.col("i.name").alias("icon_name"), F.posexplode("i.placemarks").alias("pp", "p"))
    order = W.partitionBy("p.id").orderBy(F.desc("fp"), F.desc("ip"), F.desc("pp"))
    p = p.withColumn("r", F.row_number().over(order)).where("r = 1")
    return p.select(F.col("p.id").alias("id"), F.col("p.date").alias("timestamp_text"), F.col("p.la").alias("lat"), F.col("p.lo").alias("lon"), F.col("factionId").cast("string").alias("faction_id"), F.col("name").alias("faction_name"), F.col("color").alias("faction_color"), F.col("iconId").alias("icon_id"), F.col("icon").alias("icon_path"), "icon_name")
