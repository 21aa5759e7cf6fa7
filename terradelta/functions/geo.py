"""Column functions over coordinates. A geometry is array<array<struct<x double, y double>>>: rings or lines."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere of web maps, its latitude limit, and the mean radius of the Earth in metres.
MERCATOR_RADIUS = 6378137.0
LATITUDE_LIMIT = 85.05112878
EARTH = 6371008.8
WORLD = 2 * pi * MERCATOR_RADIUS


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """G1: web-map metres of a point; latitude is clamped."""
    y = F.radians(F.greatest(F.least(lat, F.lit(LATITUDE_LIMIT)), F.lit(-LATITUDE_LIMIT)))
    return F.radians(lon) * MERCATOR_RADIUS, F.log(F.tan(F.lit(pi / 4) + y / 2)) * MERCATOR_RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """G1: longitude and latitude of web-map metres."""
    return F.degrees(x / MERCATOR_RADIUS), F.degrees(F.lit(2.0) * F.atan(F.exp(y / MERCATOR_RADIUS)) - pi / 2)


def _edges(ring: Column, of) -> Column:
    """``of`` (x1, y1, x2, y2) for each edge of a ring, its closing edge included."""
    n = F.size(ring)
    turned = F.when(n > 0, F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))).otherwise(ring)
    return F.zip_with(ring, turned, lambda a, b: of(a["x"], a["y"], b["x"], b["y"]))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def ring_area(ring: Column) -> Column:
    """Signed area of a ring, counter-clockwise positive."""
    return total(_edges(ring, lambda x1, y1, x2, y2: x1 * y2 - x2 * y1)) / 2


def marker(rings: Column) -> Column:
    """struct(x, y) centroid of the ring with the largest area; without area, its box's centre."""
    ring = F.element_at(F.array_sort(F.transform(F.filter(rings, lambda r: F.size(r) > 0), lambda r: F.struct(F.abs(ring_area(r)).alias("a"), r.alias("r")))), -1)["r"]
    a = ring_area(ring)
    cx = total(_edges(ring, lambda x1, y1, x2, y2: (x1 + x2) * (x1 * y2 - x2 * y1))) / (6 * a)
    cy = total(_edges(ring, lambda x1, y1, x2, y2: (y1 + y2) * (x1 * y2 - x2 * y1))) / (6 * a)
    box = bounds(F.array(ring))
    flat = F.struct(((box["w"] + box["e"]) / 2).alias("x"), ((box["s"] + box["n"]) / 2).alias("y"))
    return F.when(F.abs(a) < 1e-12, flat).otherwise(F.struct(cx.alias("x"), cy.alias("y")))


def bounds(geometry: Column) -> Column:
    """struct(w, s, e, n); nulls if there is no point."""
    points = F.flatten(geometry)
    side = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.struct(side(F.array_min, "x").alias("w"), side(F.array_min, "y").alias("s"), side(F.array_max, "x").alias("e"), side(F.array_max, "y").alias("n"))


def json_kind(geometry: Column) -> Column:
    """polygon, line or point of a GeoJSON text; null for collections and what is no geometry."""
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind.endswith("Polygon"), "polygon").when(kind.endswith("LineString"), "line").when(kind.endswith("Point"), "point")


def json_rings(geometry: Column) -> Column:
    """The rings, lines or points of a GeoJSON text, polygons' rings without the repeated last point; null for collections."""
    kind, at = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
    deep = lambda n: F.from_json(at, "array<" * n + "double" + ">" * n)
    lists = (
        F.when(kind == "Point", F.array(F.array(deep(1)))).when(kind.isin("LineString", "MultiPoint"), F.array(deep(2)))
        .when(kind.isin("Polygon", "MultiLineString"), deep(3)).when(kind == "MultiPolygon", F.flatten(deep(4)))
    )
    rings = F.transform(lists, lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))
    shut = lambda r: (F.size(r) > 1) & F.get(r, 0).eqNullSafe(F.element_at(r, -1))
    return F.when(kind.endswith("Polygon"), F.transform(rings, lambda r: F.when(shut(r), F.slice(r, 1, F.size(r) - 1)).otherwise(r))).otherwise(rings)


def vertex_mean(geometry: Column) -> Column:
    """struct(x, y), the mean of all vertices."""
    points = F.flatten(geometry)
    mean = lambda c: total(F.transform(points, lambda p: p[c])) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def ground_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere (haversine)."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2 * EARTH


def clip_box(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Bounds grown by 15 % of the longer side and 0.001 degrees."""
    by = F.greatest(e - w, n - s) * 0.15 + 0.001
    return F.struct((w - by).alias("w"), (s - by).alias("s"), (e + by).alias("e"), (n + by).alias("n"))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon: an odd number of edges crosses the ray to its right."""
    crosses = lambda x1, y1, x2, y2: F.when(((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1.0).otherwise(0.0)
    return total(F.transform(rings, lambda r: total(_edges(r, crosses)))) % 2 == 1


def canonical_ring(ring: Column) -> Column:
    """A ring as rounded points, without its closing point, counter-clockwise, from its least point on."""
    points = F.transform(ring, lambda p: F.struct(F.round(p["x"], 7).alias("x"), F.round(p["y"], 7).alias("y")))
    n = F.size(points)
    points = F.when((n > 1) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, 1, F.greatest(n - 1, F.lit(1)))).otherwise(points)
    points = F.when(ring_area(points) < 0, F.reverse(points)).otherwise(points)
    at = F.array_position(points, F.array_min(points)).cast("int")
    return F.concat(F.slice(points, at, F.size(points)), F.slice(points, 1, at - 1))


def same_shape(a: Column, b: Column) -> Column:
    """Whether two polygons have the same rings, wherever these start and however they turn."""
    canon = lambda g: F.array_sort(F.transform(g, canonical_ring))
    return canon(a) == canon(b)


def boxes_meet(w1, s1, e1, n1, w2, s2, e2, n2) -> Column:
    return (w1 <= e2) & (w2 <= e1) & (s1 <= n2) & (s2 <= n1)


def grid_cells(w: Column, s: Column, e: Column, n: Column, step: float) -> Column:
    """The grid cells, as struct(cx, cy), that a box meets: the equi-join key of spatial joins."""
    low = lambda c: F.floor(c / step)
    xs = F.sequence(low(w), low(e))
    return F.flatten(F.transform(xs, lambda cx: F.transform(F.sequence(low(s), low(n)), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the map tile at a point."""
    x, y = to_mercator(lon, lat)
    count = float(2**zoom)
    col = F.floor((x / WORLD + 0.5) * count)
    row = F.floor((F.lit(0.5) - y / WORLD) * count)
    fit = lambda v: F.greatest(F.least(v, F.lit(int(count) - 1)), F.lit(0))
    return fit(col), fit(row)
