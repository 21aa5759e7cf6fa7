"""The pieces of which a change consists: what is gone, what is new, what only looks different.

A shape is (source_id, feature_id, kind, rings): kind polygon (even-odd rings), line (a list of points each) or point (its
points in one list). Convex polygons, points and lines are pieces as they are; only moved polygons and those that are not
convex get to the overlay helper."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geo import clip_box
from ..sources.staging import stage_table
from .overlay import overlay_pairs

#: A piece of a polygon below all three is a sliver: square metres, metres, roundness.
SLIVER_AREA, SLIVER_RADIUS, SLIVER_ROUNDNESS = 500_000, 50, 0.01
#: Against rounding: turns of a ring within this count as none.
EPS = 1e-9
PIECE = ("change_id", "source_id", "obs", "logical_key", "change_type", "phase", "kind", "w", "s", "e", "n", "lon", "lat", "geometry")


def material(area: Column, radius: Column, perimeter: Column, is_polygon: Column) -> Column:
    """Whether a piece is material: not a polygon, or not small, thin and ragged at once."""
    roundness = F.when(perimeter != 0, 4 * 3.141592653589793 * area / (perimeter * perimeter))
    sliver = (area < SLIVER_AREA) & (radius < SLIVER_RADIUS) & (roundness < SLIVER_ROUNDNESS)
    return ~(is_polygon & F.coalesce(sliver, F.lit(False)))


def _segments(lines: Column) -> Column:
    """The segments of lines, each as its two points in one order."""
    one = lambda r: F.transform(F.sequence(F.lit(1), F.size(r) - 1), lambda i: F.array_sort(F.slice(r, i, 2)))
    return F.flatten(F.transform(F.filter(lines, lambda r: F.size(r) > 1), one))


def place(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Adds bounds and an inner point to pieces with a ``geometry``: a convex ring's centroid, a line's or point's middle;
    the inner point of other polygons is null. All pieces of a batch at once, over their flat coordinates."""
    geometry = batch.column("geometry")
    n_rings = pc.list_value_length(geometry).to_numpy(zero_copy_only=False).astype(int)
    rings = geometry.flatten()
    n_points = pc.list_value_length(rings).to_numpy(zero_copy_only=False).astype(int)
    points = rings.flatten()
    x, y = (points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    first_ring = np.cumsum(n_rings) - n_rings
    ring_start = np.cumsum(n_points) - n_points
    start, many = ring_start[first_ring], np.add.reduceat(n_points, first_ring)
    box = [f.reduceat(v, start) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))]
    # Of rings: each point's next one, turns and areas, from the piece's own corner on.
    piece = np.repeat(np.arange(len(many)), many)
    u, v = x - box[0][piece], y - box[1][piece]
    after = np.arange(len(x)) + 1
    after[(ring_start + n_points - 1)[n_points > 0]] = ring_start[n_points > 0]
    cross = u * v[after] - u[after] * v
    area = np.add.reduceat(cross, start) / 2
    dx, dy = u[after] - u, v[after] - v
    turn = np.arctan2(dx * dy[after] - dy * dx[after], dx * dx[after] + dy * dy[after])
    around = np.add.reduceat(turn, start)
    same_way = (np.minimum.reduceat(turn, start) >= -EPS) | (np.maximum.reduceat(turn, start) <= EPS)
    convex = (n_rings == 1) & same_way & (np.abs(np.abs(around) - 2 * np.pi) < 1e-6) & (np.abs(area) > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = [np.add.reduceat((c + c[after]) * cross, start) / (6 * area) + low for c, low in ((u, box[0]), (v, box[1]))]
    k = many // 2
    a, b = start + np.maximum(k - 1, 0), start + np.minimum(k, many - 1)
    polygon = np.array(batch.column("kind").to_pylist()) == "polygon"
    inner = [np.where(polygon, np.where(convex, m, np.nan), (c[a] + c[b]) / 2) for m, c in zip(middle, (x, y), strict=True)]
    columns = [*box, *inner]
    made = [pa.array(c, pa.float64(), mask=np.isnan(c)) for c in columns]
    return pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "w", "s", "e", "n", "lon", "lat"])


def _with_place(rows: DataFrame) -> DataFrame:
    schema = StructType([*rows.schema.fields, *(StructField(c, DoubleType()) for c in ("w", "s", "e", "n", "lon", "lat"))])
    return rows.mapInArrow(lambda batches: (place(b) for b in batches if b.num_rows), schema)


def change_pieces(changed: DataFrame, shapes: DataFrame | Callable[[str], Column]) -> DataFrame:
    """One row a piece (PIECE) of changes (change_id, source_id, obs, logical_key, change_type, moved,
    old_feature_id, new_feature_id): the parts of what was added (phase after) or removed (before), the material parts
    of old without new and new without old of what moved, the parts of what only changed its look (style).

    Moved points lose what both sides hold; moved lines lose the segments that both hold. Where a side's kind changed,
    both sides are whole. A moved change without a piece has no row. Shapes without points: no row.
    """
    what = F.when(F.col("change_type") != "modified", F.col("change_type")).when(F.col("moved"), "moved").otherwise("style")
    c = changed.withColumn("what", what)
    keep = ("change_id", "source_id", "obs", "logical_key", "change_type", "what", "old_feature_id", "new_feature_id")
    side = lambda p: shapes.select("source_id", F.col("feature_id").alias(f"{p}_feature_id"), F.col("kind").alias(f"{p}_kind"), F.col("rings").alias(f"{p}_rings"))
    if callable(shapes):
        rings = lambda p: F.when(F.col(f"{p}_kind").isNotNull(), shapes(f"{p}_")).alias(f"{p}_rings")
        c = c.select(*keep, "old_kind", rings("old"), "new_kind", rings("new"))
    else:
        c = c.select(*keep).join(side("old"), ["source_id", "old_feature_id"], "left").join(side("new"), ["source_id", "new_feature_id"], "left")
    of = ("change_id", "source_id", "obs", "logical_key", "change_type")
    alike = (F.col("what") == "moved") & (F.col("old_kind") == F.col("new_kind"))

    before, after = F.col("what").isin("removed", "moved"), F.col("what").isin("added", "moved", "style")
    apart = c.where(~F.coalesce(alike, F.lit(False)) | (F.col("old_kind") != "polygon"))
    parts = lambda mine, other, kind: F.when(kind == "line", F.when(alike, F.array_except(_segments(mine), _segments(other))).otherwise(mine)).otherwise(F.transform(F.when(alike, F.array_except(F.flatten(mine), F.flatten(other))).otherwise(F.flatten(mine)), lambda p: F.array(p)))
    rows = []
    for p, q, here, phase in (("old", "new", before, F.lit("before")), ("new", "old", after, F.when(F.col("what") == "style", "style").otherwise("after"))):
        kind, mine = F.col(f"{p}_kind"), F.col(f"{p}_rings")
        some = apart.where(here & (F.size(F.flatten(mine)) > 0))
        rows.append(some.where(kind == "polygon").select(*of, phase.alias("phase"), kind.alias("kind"), mine.alias("geometry")))
        thin = some.where(kind != "polygon").select(*of, phase.alias("phase"), kind.alias("kind"), F.explode(parts(mine, F.col(f"{q}_rings"), kind)).alias("part"))
        rows.append(thin.select(*of, "phase", "kind", F.array("part").alias("geometry")))
    whole = stage_table(_with_place(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])), "placed")
    easy = F.col("lon").isNotNull()  # one piece with that inner point; other polygons are taken apart

    hard = whole.where(~easy).select(*of, "phase", "geometry")
    hard = hard.withColumn("pair_id", F.concat_ws("\n", "change_id", "phase"))
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")
    taken = overlay_pairs(hard.select("pair_id", F.col("geometry").alias("old_rings"), empty.alias("new_rings"))).drop("phase")
    taken = hard.drop("geometry").join(taken, "pair_id")

    moved = c.where(F.coalesce(alike & (F.col("old_kind") == "polygon"), F.lit(False)))
    deltas = overlay_pairs(moved.select(F.col("change_id").alias("pair_id"), "old_rings", "new_rings"))
    deltas = deltas.where(material(F.col("area"), F.col("radius"), F.col("perimeter"), F.lit(True)))
    deltas = moved.select(*of).join(deltas, F.col("change_id") == F.col("pair_id"))
    polygons = taken.unionByName(deltas, allowMissingColumns=True).withColumn("kind", F.lit("polygon"))
    return whole.where(easy).select(*PIECE).unionByName(polygons.select(*PIECE))


def clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float], closed: bool) -> list[list[tuple[float, float]]]:
    """A ring, or line, cut to a box: side after side what lies beyond goes. A line may fall into several."""
    runs = [ring]
    for axis, limit, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        out = []
        for run in runs:
            now: list[tuple[float, float]] = []
            pairs = list(zip(run, run[1:] + run[:1] if closed else run[1:], strict=False)) if len(run) > 1 else [(run[0], run[0])]
            for p, q in pairs:
                inside, next_in = sign * (p[axis] - limit) >= 0, sign * (q[axis] - limit) >= 0
                if inside:
                    now.append(p)
                if inside != next_in:
                    t = (limit - p[axis]) / (q[axis] - p[axis])
                    now.append((p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t))
                    if inside and not closed:
                        out.append(now)
                        now = []
            if not closed and len(run) > 1 and sign * (run[-1][axis] - limit) >= 0:
                now.append(run[-1])
            if now:
                out.append(now)
        runs = [r for r in out if len(r) > 2 * closed]
    return runs


def clipped(pieces: DataFrame, areas: DataFrame) -> DataFrame:
    """Pieces (PIECE and source_id, obs, cluster) with their geometry cut to the bounds of their change area (source_id,
    obs, cluster, w, s, e, n), grown as G6 says. Pieces with nothing left go."""
    box = areas.select("source_id", "obs", "cluster", clip_box(*[F.col(c) for c in "wsen"]).alias("clip"))
    met = pieces.join(box, ["source_id", "obs", "cluster"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = []
            for kind, geometry, c in zip(b["kind"], b["geometry"], b["clip"], strict=True):
                parts = [part for ring in geometry for part in clip_ring([(p["x"], p["y"]) for p in ring], (c["w"], c["s"], c["e"], c["n"]), kind == "polygon")]
                cut.append([[{"x": x, "y": y} for x, y in part] for part in parts])
            yield b.assign(geometry=cut)[b.columns.drop("clip")]

    return met.mapInPandas(run, met.drop("clip").schema).where(F.size("geometry") > 0)
