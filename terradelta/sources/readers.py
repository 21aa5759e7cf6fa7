"""Readers of landed payloads, and the sinks of versioned tables. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import from_mercator
from ..functions.text import any_of, canonical_text

#: Geometry, properties and paint stay JSON texts, so that what is nested in them isn't lost.
OVERLAY = "mapper_id string, captured_at timestamp, run_id long, layers array<struct<id string, label string, geom_type string, paint string, data struct<type string, features array<struct<type string, id string, geometry string, properties string>>>>>"
ARCGIS = "features array<struct<attributes map<string,string>, geometry struct<rings array<array<array<double>>>>>>, spatialReference struct<wkid int>"
#: The spatial reference of longitude and latitude; answers without one are in web-map metres.
DEGREES = 4326
INDEX = "factions array<struct<factionId int, name string, color string, icons array<struct<iconId string, icon string, name string, placemarks array<struct<id string, date string, la double, lo double>>>>>>"
SEARCH = "events array<struct<slug string, title string, ticker string, rules string, description string, markets array<struct<id string, conditionId string, question string, title string, slug string, description string, rules string, closed boolean, closedTime string, resolutionTime string, updatedAt string, endDate string, outcomes string, outcomePrices string, clobTokenIds string, lastTradePrice double, volumeNum double>>>>"
EVENTS = "Date string, Name string, Faction string, Origin string, Latitude string, Longitude string, PlusCode string, Description string, Source string, Geolocation string, Equipment string, EquipmentItems string, Units string, OrbatUnits string, Id string"
_POLY = "struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>,innerBoundaryIs:array<struct<LinearRing:struct<coordinates:string>>>>"
_LINE = "struct<coordinates:string>"
#: Folders and geometries may hold others; schemas are unrolled to these depths, and deeper ones are an error.
FOLDERS, GEOMETRIES = 8, 3


def _geometries(depth: int) -> str:
    more = f"MultiGeometry:array<{_geometries(depth - 1)}>" if depth else "MultiGeometry:array<string>"
    return f"struct<Point:array<{_LINE}>,LineString:array<{_LINE}>,Polygon:array<{_POLY}>,{more}>"


PLACEMARK = "struct<_id:string,name:string,description:string,styleUrl:string," + _geometries(GEOMETRIES)[7:]


def _folder(depth: int) -> str:
    more = f"Folder:array<{_folder(depth - 1)}>" if depth else "Folder:array<string>"
    return f"struct<name:string,Placemark:array<{PLACEMARK}>,{more}>"


STYLE = "_id string, LineStyle struct<color:string,width:string>, PolyStyle struct<color:string>, IconStyle struct<color:string>"
STYLE_MAP = "_id string, Pair array<struct<key:string,styleUrl:string>>"
#: How bodies are told apart, the first that fits: words of the content type, the end of the URL's path.
BODY_TYPES = {"json": (("json",), ".json"), "kml": (("xml", "kml"), ".kml")}
OTHER_BODY = "bin"


def read_overlays(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows of overlay payloads."""
    return overlay_features(spark.read.schema(OVERLAY).json(path, multiLine=True))


def overlay_features(payloads: DataFrame) -> DataFrame:
    """A row for each feature of each layer: a layer without id is layer-<place>, its label is its id, its type
    polygon. A layer without features has one row with a null feature."""
    layer = payloads.select("mapper_id", "run_id", "captured_at", F.posexplode_outer("layers").alias("ordinal", "l"))
    key = F.coalesce(F.nullif("l.id", F.lit("")), F.concat(F.lit("layer-"), "ordinal"))
    rows = layer.select(F.col("mapper_id").alias("source_id"), "run_id", "captured_at", "ordinal", key.alias("layer_key"), F.coalesce(F.nullif("l.label", F.lit("")), key).alias("label"), F.coalesce(F.nullif("l.geom_type", F.lit("")), F.lit("polygon")).alias("geometry_type"), F.col("l.paint").alias("paint"), F.posexplode_outer("l.data.features").alias("position", "f"))
    return rows.select("source_id", "run_id", "captured_at", "ordinal", "layer_key", "label", "geometry_type", "paint", "position", F.col("f.id").alias("feature_id"), F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties"))


def feature_hash(geometry: Column, properties: Column) -> Column:
    """A2: SHA-256 of a feature's normal geometry and properties (JSON texts of any depth, collections of geometries
    among them); its id plays no part. Without properties they are empty."""
    return F.sha2(F.concat_ws("|", F.coalesce(canonical_text(geometry), F.lit("null")), F.coalesce(canonical_text(properties), F.lit("{}"))), 256)


def read_arcgis(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of an ArcGIS answer in longitude and latitude, with their attributes."""
    return arcgis_features(spark.read.schema(ARCGIS).json(path, multiLine=True))


def arcgis_features(payloads: DataFrame) -> DataFrame:
    """Features that have rings, from web-map metres to degrees. An answer whose spatial reference is degrees keeps its
    numbers: web maps end at 85 degrees of latitude."""
    said = F.col("spatialReference.wkid") if "spatialReference" in payloads.columns else F.lit(None)
    f = payloads.select(F.coalesce(said == DEGREES, F.lit(False)).alias("plain"), F.posexplode("features").alias("position", "f")).where(F.size("f.geometry.rings") > 0)

    def point(p: Column) -> Column:
        x, y = F.get(p, 0), F.get(p, 1)
        lon, lat = from_mercator(x, y)
        return F.struct(F.when(F.col("plain"), x).otherwise(lon).alias("x"), F.when(F.col("plain"), y).otherwise(lat).alias("y"))

    return f.select("position", F.transform("f.geometry.rings", lambda r: F.transform(r, point)).alias("rings"), F.col("f.attributes").alias("properties"))


def line_points(text: Column) -> Column:
    """S3: the points of a KML coordinate list 'lon,lat[,alt] …'; what doesn't parse is left out."""
    cut = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: F.struct(F.get(F.split(t, ","), 0).try_cast("double").alias("x"), F.get(F.split(t, ","), 1).try_cast("double").alias("y")))
    return F.filter(cut, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def _all_deep(node: Column, child: str, own, depth: int, kind: str) -> Column:
    """``own`` (an array) of a node and of all nodes below it."""
    below = F.coalesce(node[child], F.array())
    if not depth:
        return F.when(F.size(below) > 0, F.raise_error(F.lit(f"{child} elements are nested too deep")).cast(kind)).otherwise(own(node))
    return F.concat(own(node), F.flatten(F.transform(below, lambda n: _all_deep(n, child, own, depth - 1, kind))))


def kml_placemarks(documents: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """S3: (file, folder, position, p) of documents (file, Folder): the placemarks of each top folder, at any depth below it.
    Only folders of the very names in ``include`` (all, if none is named) and not in ``exclude``."""
    top = documents.select("file", F.posexplode("Folder").alias("nth", "f")).select("file", "nth", F.coalesce(F.trim("f.name"), F.lit("")).alias("folder"), "f")
    if include is not None:
        top = top.where(F.col("folder").isin(*include))
    if exclude:
        top = top.where(~F.col("folder").isin(*exclude))
    kind = f"array<{PLACEMARK}>"
    deep = _all_deep(F.col("f"), "Folder", lambda n: F.coalesce(n["Placemark"], F.array().cast(kind)), FOLDERS, kind)
    return top.select("file", "nth", "folder", F.posexplode(deep).alias("position", "p"))


def _shapes(tag: str, kind: str, rings) -> Column:
    """The geometries of one tag in a placemark, at any depth, as (geometry_type, geometry)."""
    own = lambda n: F.coalesce(n[tag], F.array().cast(f"array<{kind}>"))
    every = _all_deep(F.col("p"), "MultiGeometry", own, GEOMETRIES, f"array<{kind}>")
    return F.transform(every, lambda q: F.struct(F.lit(tag.replace("String", "").lower()).alias("geometry_type"), rings(q).alias("geometry")))


def kml_features(placemarks: DataFrame, looks: DataFrame) -> DataFrame:
    """Features of placemarks: one row for each polygon, line of two points or more, or point, wherever in the
    placemark it stands, with the looks of its style (see kml_styles). Features of one type are a layer; its id names the
    type only if its folder has several."""
    found = []
    ring = lambda b: line_points(b["LinearRing"]["coordinates"])
    inner = lambda q: F.filter(F.coalesce(F.transform(q["innerBoundaryIs"], ring), F.array().cast("array<array<struct<x:double,y:double>>>")), lambda r: F.size(r) > 0)
    first_point = lambda q: F.slice(line_points(q["coordinates"]), 1, 1)
    rings = {
        "Polygon": (_POLY, lambda q: F.concat(F.array(ring(q["outerBoundaryIs"])), inner(q))),
        "LineString": (_LINE, lambda q: F.array(line_points(q["coordinates"]))),
        "Point": (_LINE, lambda q: F.array(first_point(q))),
    }
    for tag, (kind, of) in rings.items():
        found.append(_shapes(tag, kind, of))
    rows = placemarks.select("file", "nth", "folder", "position", F.col("p._id").alias("placemark_id"), F.coalesce("p.name", F.lit("")).alias("name"), F.coalesce("p.description", F.lit("")).alias("description"), F.col("p.styleUrl").alias("style_url"), F.posexplode(F.concat(*found)).alias("part", "g"))
    least = F.when(F.col("g.geometry_type") == "line", 2).otherwise(1)
    rows = rows.where(F.size(F.get("g.geometry", 0)) >= least).select("*", "g.geometry_type", "g.geometry").drop("g")
    several = F.size(F.collect_set("geometry_type").over(W.partitionBy("file", "nth"))) > 1
    rows = rows.withColumn("several", several)
    label = F.when(F.col("several"), F.concat(F.col("folder"), F.lit(" ("), F.col("geometry_type"), F.lit(")"))).otherwise(F.col("folder"))
    words = F.when(F.col("several"), F.concat_ws(" ", "folder", "geometry_type")).otherwise(F.col("folder"))
    rows = rows.withColumn("label", label).withColumn("layer_key", F.trim(F.regexp_replace(F.lower(words), "[^a-z0-9]+", "-"), F.lit("-")))
    rows = rows.join(looks.withColumn("style_url", F.concat(F.lit("#"), "style_id")).drop("style_id"), ["file", "style_url"], "left")
    return rows.drop("several", "nth").withColumns({"line_opacity": F.coalesce("line_opacity", F.lit(1.0)), "line_width": F.coalesce("line_width", F.lit(1.5)), "circle_opacity": F.coalesce("circle_opacity", F.lit(1.0))})


def read_kml(spark: SparkSession, path: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The features of KML files, with layers and looks."""
    documents = spark.read.format("xml").option("rowTag", "Document").schema(f"Folder array<{_folder(FOLDERS)}>").load(path)
    documents = documents.select(F.col("_metadata.file_path").alias("file"), "Folder")
    return kml_features(kml_placemarks(documents, include, exclude), read_kml_styles(spark, path))


def kml_color(text: Column) -> Column:
    """struct(color '#rrggbb', opacity) of aabbggrr."""
    low = F.lower(text)
    rgb = F.concat(F.lit("#"), F.substring(low, 7, 2), F.substring(low, 5, 2), F.substring(low, 3, 2))
    alpha = F.round(F.conv(F.substring(low, 1, 2), 16, 10).cast("double") / 255, 3)
    return F.when(low.rlike("^[0-9a-f]{8}$"), F.struct(rgb.alias("color"), alpha.alias("opacity")))


def read_kml_styles(spark: SparkSession, path: str) -> DataFrame:
    """Looks by file and style id, a StyleMap standing for its 'normal' style."""
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).select(F.col("_metadata.file_path").alias("file"), "*")
    return kml_styles(xml("Style", STYLE), xml("StyleMap", STYLE_MAP))


def kml_styles(styles: DataFrame, maps: DataFrame) -> DataFrame:
    """Fill, line and circle of each style (file, style_id): a line's colour and opacity fall back to the fill's, a
    circle's colour to fill, then line; opacities of lines and circles are 1.0, widths 1.5 if nothing is said. A map to a
    style that isn't there has just these defaults, and a map wins over a style of its id."""
    fill, line, icon = kml_color(F.col("PolyStyle.color")), kml_color(F.col("LineStyle.color")), kml_color(F.col("IconStyle.color"))
    said = styles.where("_id <> ''").select("file", F.col("_id").alias("style_id"), fill.alias("f"), line.alias("l"), icon.alias("i"), F.col("LineStyle.width").try_cast("double").alias("width"))
    normal = F.get(F.filter("Pair", lambda p: p["key"] == "normal"), 0)["styleUrl"]
    mapped = maps.where(F.col("_id").isNotNull() & (normal != "")).select("file", F.col("_id").alias("map_id"), normal.alias("to"))
    through = mapped.join(said.withColumn("to", F.concat(F.lit("#"), "style_id")).drop("style_id"), ["file", "to"], "left").drop("to").withColumnRenamed("map_id", "style_id")
    every = said.join(mapped.select("file", F.col("map_id").alias("style_id")), ["file", "style_id"], "left_anti").unionByName(through)
    return every.select(
        "file", "style_id", F.col("f.color").alias("fill_color"), F.col("f.opacity").alias("fill_opacity"),
        F.coalesce("l.color", "f.color").alias("line_color"), F.coalesce("l.opacity", "f.opacity", F.lit(1.0)).alias("line_opacity"), F.coalesce("width", F.lit(1.5)).alias("line_width"),
        F.coalesce("i.color", "f.color", "l.color").alias("circle_color"), F.coalesce("i.opacity", F.lit(1.0)).alias("circle_opacity"),
    )


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """The event export: semicolons, a byte-order mark, quotes over lines."""
    return spark.read.schema(EVENTS).csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)


def read_event_index(spark: SparkSession, path: str) -> DataFrame:
    """The compact index, a JSON list of factions (see operators.events.flat_index)."""
    text = spark.read.text(path, wholetext=True)
    kind = INDEX.split(" ", 1)[1]
    return text.select(F.from_json("value", kind).alias("factions"))


def read_search(spark: SparkSession, path: str) -> DataFrame:
    """Search payloads, a list of events or an object that holds one."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    kind = SEARCH.split(" ", 1)[1]
    whole = F.when(F.col("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", SEARCH)["events"])
    return text.select(whole.alias("events"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Landed bodies as (path, body)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))


def body_rank(content_type: Column, url: Column) -> Column:
    """The place of a body's type in BODY_TYPES; after the last for others."""
    told, path = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))), F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0)
    rank = F.lit(len(BODY_TYPES))
    for n, (words, end) in reversed(list(enumerate(BODY_TYPES.values()))):
        rank = F.when(any_of(*[told.contains(w) for w in words], path.endswith(end)), n).otherwise(rank)
    return rank


def archive_bodies(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct bodies (sha256, suffix, size, body) and links (source_id, url, sha256) of (source_id, url,
    content_type, body). A body's type is the strongest that any of its deliveries tells. Equal bodies are combined
    map-side, so a body that comes a million times travels once a task."""
    rows = bodies.withColumn("sha256", F.sha2("body", 256)).withColumn("rank", body_rank(F.col("content_type"), F.col("url")))
    distinct = rows.groupBy("sha256").agg(F.min("rank").alias("rank"), F.first("body").alias("body"))
    suffix = F.get(F.array(*[F.lit(x) for x in (*BODY_TYPES, OTHER_BODY)]), F.col("rank"))
    return distinct.select("sha256", suffix.alias("suffix"), F.octet_length("body").alias("size"), "body"), rows.select("source_id", "url", "sha256").distinct()


def append_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Append facts; nothing that is there is rewritten. Keyed tables are in ``versions``."""
    df.write.mode("append").partitionBy(*partitions).parquet(path)
