"""Column functions over texts, links, names, timestamps and market titles. All run JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The properties whose change can be seen on a map.
VISIBLE = (
    "name", "title", "label", "description", "fill_color", "fill_opacity", "line_color", "line_opacity",
    "line_width", "circle_color", "circle_opacity", "circle_radius", "circle_stroke_color", "circle_stroke_width",
)
#: Properties that identify a feature, best first, and those as good as an id of its own.
ID_FIELDS = ("globalid", "global_id", "objectid", "object_id", "fid", "placemark_id", "kml_id", "id")
SURE_FIELDS = ("globalid", "global_id", "placemark_id", "kml_id")
#: Words that open a place's name, and fields that hold a deadline, best first.
PLACE_PREFIXES = r"(?i)^(the city of|city of|the town of|town of|the village of|village of) "
DEADLINES = ("endDate", "closeTime", "closedTime", "closeDate", "closeDateTime", "endTime", "resolutionTime")


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group matches, null where it doesn't match (regexp_extract gives '')."""
    return F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group))


def normal_number(x: Column) -> Column:
    """M1: numbers as identity sees them: 7 places, no negative zero, no NaN or infinity."""
    r = F.round(x.cast("double"), 7)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).when(r == 0, F.lit(0.0)).otherwise(r)


def sorted_entries(m: Column) -> Column:
    """M1: a map in canonical order; equal maps give equal arrays whatever order they were built in."""
    return F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))


def canonical_json(m: Column) -> Column:
    """M1: JSON of a map with its keys sorted."""
    return F.to_json(F.map_from_entries(sorted_entries(m)))


#: The pieces of a JSON text: strings, numbers, and what stands between them.
_JSON_PIECE = r'("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|[^"\d-]+|-)'


def canonical_text(json: Column) -> Column:
    """M1: JSON text of any depth in canonical form: keys sorted at every depth, numbers to 7 places, no negative zero, no
    white space. Numbers and texts stay apart; equal numbers are equal however they are written. A text that is no JSON,
    or repeats a key, keeps its order; null stays null."""
    whole = F.coalesce(F.to_json(F.try_parse_json(json)), json)
    one = lambda t: F.when(t.rlike(r"^-?\d"), normal_number(t.try_cast("double")).cast("string")).when(t.startswith('"'), t).otherwise(F.regexp_replace(t, r"\s", ""))
    return F.array_join(F.transform(F.regexp_extract_all(whole, F.lit(_JSON_PIECE), 1), one), "")


def slug(text: Column) -> Column:
    """M2: lower case, runs of other than a-z0-9 as one dash, 160 characters, 'unnamed' if nothing is left."""
    s = F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-")), 1, 160)
    return F.coalesce(F.when(s != "", s), F.lit("unnamed"))


def base_key(source: Column, layer: Column, feature_id: Column, properties: Column, geometry_type: Column) -> Column:
    """M2: struct(key, confidence) of a feature: its id, else an identifying property, else name and type."""
    lower = F.transform_keys(F.coalesce(properties, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    value = lambda f: F.when(lower[f] != "", lower[f])
    stem = F.concat_ws(":", source, layer)
    made = lambda kind, v, c: F.struct(F.concat_ws(":", stem, F.lit(kind), slug(v)).alias("key"), F.lit(c).alias("confidence"))
    tries = [F.when(feature_id != "", made("id", feature_id, 1.0))]
    tries += [F.when(value(f).isNotNull(), made(f, value(f), 1.0 if f in SURE_FIELDS else 0.95)) for f in ID_FIELDS]
    name = F.coalesce(value("name"), value("title"))
    last = F.struct(F.concat_ws(":", stem, F.lit("fallback"), slug(name), slug(F.coalesce(geometry_type, F.lit("Geometry")))).alias("key"), F.lit(0.65).alias("confidence"))
    return F.coalesce(*tries, last)


def visible_properties(properties: Column) -> Column:
    """The visible properties with lower-case keys; null gives an empty map."""
    m = F.transform_keys(F.coalesce(properties, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    return F.map_filter(m, lambda k, _: k.isin(*VISIBLE))


def local_date(instant: Column, zone: str = "Europe/Kyiv") -> Column:
    """M3: the calendar date of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def day_range(day: Column, zone: str = "Europe/Kyiv") -> tuple[Column, Column]:
    """M3: the UTC instants between which a local day lies."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def parse_instant(text: Column) -> Column:
    """M4: ISO timestamp, else the date in the first ten characters; without a zone it is UTC."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t)), F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd")))


def precision(text: Column) -> Column:
    """M4: 'minute' if the timestamp has a time of day, else 'day'."""
    t = parse_instant(text)
    return F.when(t != F.date_trunc("day", t), "minute").otherwise("day")


def urls(text: Column) -> Column:
    """M5: links in order of first appearance, without closing punctuation."""
    every = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s<>\"']+)"), 1)
    return F.array_distinct(F.filter(F.transform(every, lambda u: F.regexp_replace(u, r"[.)\],;:!?]+$", "")), lambda u: u != ""))


def split_names(text: Column) -> Column:
    """M6: names split at lines, commas and semicolons, trimmed, distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,;]"), lambda n: F.trim(n)), lambda n: n != ""))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """M7: a name-based UUID (version 5): SHA-1 of the namespace's bytes and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def tile_id(text: Column) -> Column:
    """M7: a 60-bit id: the first 15 hexadecimal digits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_hash(*columns: Column) -> Column:
    """M7: SHA-256 of a row's values, nulls told from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


def _host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1)), r"^www\.", "")


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def status_id(url: Column) -> Column:
    """M8: the id of a status link of x.com or twitter.com, else null."""
    return F.when(_host(url).isin("x.com", "twitter.com", "mobile.twitter.com"), found(_path(url), r"/status/(\d+)"))


def channel_post(url: Column) -> Column:
    """M8: channel/number of a public t.me post, else null."""
    path = F.regexp_replace(F.regexp_replace(_path(url), "^/+|/+$", ""), "^s/", "")
    return F.when(_host(url).isin("t.me", "telegram.me") & path.rlike(r"^[^/]+/\d+$") & ~path.startswith("c/"), path)


def first_of(texts: Column, pick) -> Column:
    """The first non-null ``pick`` of an array's texts."""
    return F.get(F.filter(F.transform(texts, pick), lambda x: x.isNotNull()), 0)


def market_type(texts: Column) -> Column:
    """M9: of the first text that tells: capture_all, capture or enter."""

    def tell(t: Column) -> Column:
        low = F.lower(t)
        return F.when(low.contains("capture all"), "capture_all").when(low.contains("capture"), "capture").when(low.contains("enter"), "enter")

    return first_of(texts, tell)


def city_name(texts: Column) -> Column:
    """The place that titles name (capture all … by, capture … by, enter … by), else descriptions."""
    title = (r"(?i)capture all(?: of)?\s+(.*?)\s+by", r"(?i)capture\s+(.*?)\s+by", r"(?i)enter\s+(.*?)\s+by")
    prose = (r"(?i)territory of\s+([^,]+)", r"(?i)in the city of\s+([^,]+)", r"(?i)in\s+([^,]+)\s+oblast")
    one = lambda patterns: lambda t: F.coalesce(*[F.trim(found(t, p)) for p in patterns])
    named = lambda patterns: first_of(texts, lambda t: F.when(one(patterns)(t) != "", one(patterns)(t)))
    return F.coalesce(named(title), named(prose))


def normal_city(name: Column) -> Column:
    """A place's name without brackets, tail after a comma, '(once) again' and 'city of'."""
    s = F.regexp_replace(F.replace(name, F.lit("’"), F.lit("'")), r"\s*\(.*?\)", "")
    s = F.trim(F.substring_index(s, ",", 1))
    s = F.trim(F.regexp_replace(s, r"(?i)\b(once\s+)?again\b$", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(s, PLACE_PREFIXES, ""), r"\s+", " "))


def coordinates(text: Column) -> Column:
    """struct(lat, lon) by four labelled forms in order, then a bare pair, swapped if it must be."""
    n = r"(-?\d+\.\d+)"
    forms = (rf"(?is){n}\s*[°º]?\s*[Nn].*?{n}\s*[°º]?\s*[Ee]", rf"(?is)lat(?:itude)?\s*[:=]\s*{n}.*?lon(?:gitude)?\s*[:=]\s*{n}", rf"(?is)!3d{n}!4d{n}", rf"(?is)@{n},{n}")
    pair = lambda p: F.struct(found(text, p, 1).cast("double").alias("lat"), found(text, p, 2).cast("double").alias("lon"))
    labelled = [F.when(F.coalesce(text, F.lit("")).rlike(p), pair(p)) for p in forms]
    bare = rf"{n}\s*,\s*{n}"
    a, b = found(text, bare, 1).cast("double"), found(text, bare, 2).cast("double")
    swap = (F.abs(a) > 90) & (F.abs(b) <= 90)
    lat, lon = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.coalesce(*labelled, F.when((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.struct(lat.alias("lat"), lon.alias("lon"))))


def question_stem(title: Column) -> Column:
    """A title in lower-case words, without 'by …'."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(words, r"\s+by\s+.+$", ""))


def deadline_text(title: Column) -> Column:
    """What follows 'by' in a question, without its question mark."""
    return found(title, r"(?i)\s+by\s+([^?]+)\??\s*$")


def target_label(title: Column, description: Column, city: Column) -> Column:
    """The objective of a capture market: '… in <city> by', else its description, else the stem."""
    specific = F.trim(found(title, r"(?i)capture\s+(?:the\s+)?(.+?)\s+in\s+.+?\s+by"))
    said = F.trim(found(description, r"(?i)captures?\s+the\s+(.+?)\s+(?:located|at\s+-?\d)"))
    starts = F.lower(said).startswith(F.concat(F.lower(city), F.lit(" ")))
    said = F.when(starts, F.ltrim(said.substr(F.length(city) + 1, F.length(said)))).otherwise(said)
    said = F.concat(F.upper(F.substring(said, 1, 1)), said.substr(F.lit(2), F.length(said)))
    stem = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^Will Russia capture\s+(?:the\s+)?", "")
    stem = F.trim(F.regexp_replace(stem, r"(?i)\s+by.*$", ""), F.lit(" ?"))
    return F.coalesce(specific, said, F.when(stem != "", stem), F.lit("Capture target"))


def decode_list(text: Column) -> Column:
    """A JSON list of texts kept as text; anything else is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def settled_outcome(outcomes: Column, prices: Column) -> Column:
    """The outcome whose price is highest and at least 0.99; the first of equals; else null."""
    n = F.transform(prices, lambda p: F.when(p.try_cast("double") >= 0.99, p.try_cast("double")).otherwise(F.lit(-1.0)))
    best = F.array_max(n)
    return F.when(best >= 0.99, F.get(outcomes, (F.array_position(n, best) - 1).cast("int")))


def market_status(closed: Column, outcome: Column) -> Column:
    """Active, closed or resolved."""
    return F.when(~F.coalesce(closed, F.lit(False)), "active").when(F.coalesce(outcome, F.lit("")) == "", "closed").otherwise("resolved")


def deadline(market: dict[str, Column], event: dict[str, Column]) -> Column:
    """The first filled deadline field, the market's before the event's, field by field."""
    return filled(*[side[f] for f in DEADLINES for side in (market, event) if f in side])


def yes_no(outcomes: Column, prices: Column, tokens: Column, last: Column) -> Column:
    """struct(yes, no, token): odds by the outcomes' places, 'yes' first and 'no' second if unnamed."""
    low = F.transform(outcomes, F.lower)
    at = lambda word, other: F.when(F.array_contains(low, word), (F.array_position(low, word) - 1).cast("int")).otherwise(other)
    price = lambda i: F.get(prices, i).try_cast("double")
    yes = F.when(at("yes", 0) < F.size(prices), price(at("yes", 0))).otherwise(last)
    no = F.when(at("no", 1) < F.size(prices), price(at("no", 1))).otherwise(1 - yes)
    return F.struct(yes.alias("yes"), no.alias("no"), F.when(F.get(tokens, at("yes", 0)) != "", F.get(tokens, at("yes", 0))).alias("token"))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
