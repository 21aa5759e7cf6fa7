"""Polygon overlay for pairs that survive all cheaper tests: a vectorised helper inside mapInArrow.

Polygons are lists of rings of (lon, lat), even-odd. Between neighbouring y values of vertices and crossings no
edges cross, so both polygons cut such a slab into trapezoids; each is in A, B or both. Work is done on the
equal-area cylinder (lon, sin lat), so areas are those on the sphere. Boxes stay boxes there: pairs of them are
measured in closed form, a batch at a time."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.geo import EARTH

ONLY_A, ONLY_B, BOTH = 1, 2, 3
EPS = 1e-12
PIECES = pa.schema([("pair_id", pa.string()), ("phase", pa.string()), *((c, pa.float64()) for c in ("area", "perimeter", "radius", "w", "s", "e", "n", "lon", "lat")), ("geometry", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])


def _edges(rings: list, owner: int) -> list[tuple[float, float, float, float, int]]:
    out = []
    for ring in rings:
        pts = [(math.radians(x), math.sin(math.radians(y))) for x, y in ring]
        for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
            if abs(y1 - y2) > EPS:
                out.append((x1, y1, x2, y2, owner) if y1 < y2 else (x2, y2, x1, y1, owner))
    return out


def _levels(edges: np.ndarray) -> np.ndarray:
    """All y of vertices and crossings, ascending."""
    ys = [edges[:, 1], edges[:, 3]]
    dx, dy = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    for i in range(len(edges) - 1):
        rest = slice(i + 1, None)
        cross = dx[i] * dy[rest] - dy[i] * dx[rest]
        with np.errstate(divide="ignore", invalid="ignore"):
            ox, oy = edges[rest, 0] - edges[i, 0], edges[rest, 1] - edges[i, 1]
            t, u = (ox * dy[rest] - oy * dx[rest]) / cross, (ox * dy[i] - oy * dx[i]) / cross
        hit = (np.abs(cross) > 1e-18) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        ys.append(edges[i, 1] + t[hit] * dy[i])
    y = np.unique(np.concatenate(ys))
    return y[np.concatenate(([True], np.diff(y) > EPS))]


def trapezoids(a: list, b: list) -> list[tuple[int, int, float, float, float, float, float, float]]:
    """(slab, class, y0, y1, left and right x at y0, left and right x at y1)."""
    edges = np.array(_edges(a, ONLY_A) + _edges(b, ONLY_B))
    if not len(edges):
        return []
    ys, out = _levels(edges), []
    slope = (edges[:, 2] - edges[:, 0]) / (edges[:, 3] - edges[:, 1])
    for slab, (y0, y1) in enumerate(zip(ys, ys[1:], strict=False)):
        live = np.flatnonzero((edges[:, 1] <= y0 + EPS) & (edges[:, 3] >= y1 - EPS))
        at = lambda y: edges[live, 0] + (y - edges[live, 1]) * slope[live]  # noqa: B023, E731
        order = np.argsort(at((y0 + y1) / 2), kind="stable")
        low, high, owner = at(y0)[order], at(y1)[order], edges[live, 4][order].astype(int)
        inside = 0
        for k in range(len(order) - 1):
            inside ^= owner[k]
            if inside and max(low[k + 1] - low[k], high[k + 1] - high[k]) > EPS:
                last = out[-1] if out else None
                if last and last[0] == slab and last[1] == inside and abs(last[5] - low[k]) < EPS and abs(last[7] - high[k]) < EPS:
                    out[-1] = (*last[:5], low[k + 1], last[6], high[k + 1])
                else:
                    out.append((slab, inside, y0, y1, low[k], low[k + 1], high[k], high[k + 1]))
    return out


def _area(t: tuple) -> float:
    return (t[5] - t[4] + t[7] - t[6]) / 2 * (t[3] - t[2]) * EARTH * EARTH


def overlap_ratio(a: list, b: list) -> float | None:
    """Intersection over union; null without any area."""
    parts = trapezoids(a, b)
    both, every = sum(_area(t) for t in parts if t[1] == BOTH), sum(map(_area, parts))
    return both / every if every else None


def _metres(x1: float, y1: float, x2: float, y2: float) -> float:
    p, q = math.asin(max(-1, min(1, y1))), math.asin(max(-1, min(1, y2)))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH * math.asin(min(1, math.sqrt(h)))


def difference_pieces(a: list, b: list) -> list[dict]:
    """The connected pieces of A without B ('before') and B without A ('after'), each with area, perimeter,
    the radius of about the largest circle inside, box, an inner point and its geometry as trapezoids."""
    parts = [t for t in trapezoids(a, b) if t[1] != BOTH]
    by_slab: dict[int, list[int]] = {}
    for n, t in enumerate(parts):
        by_slab.setdefault(t[0], []).append(n)
    parent = list(range(len(parts)))

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for slab, below in by_slab.items():
        for i in below:
            for j in by_slab.get(slab + 1, ()):
                p, q = parts[i], parts[j]
                if p[1] == q[1] and min(p[7], q[5]) - max(p[6], q[4]) > EPS:
                    parent[root(i)] = root(j)
    groups: dict[int, list[int]] = {}
    for n in range(len(parts)):
        groups.setdefault(root(n), []).append(n)
    out = []
    for group in groups.values():
        border = []
        mine = set(group)
        for n in group:
            slab, _, y0, y1, l0, r0, l1, r1 = parts[n]
            border += [(l0, y0, l1, y1), (r0, y0, r1, y1)]
            for y, left, right, other, k in ((y0, l0, r0, slab - 1, 6), (y1, l1, r1, slab + 1, 4)):
                at = left
                for lo, hi in sorted((max(left, parts[m][k]), min(right, parts[m][k + 1])) for m in by_slab.get(other, ()) if m in mine):
                    if hi > lo:
                        if lo - at > EPS:
                            border.append((at, y, lo, y))
                        at = max(at, hi)
                if right - at > EPS:
                    border.append((at, y, right, y))
        seg = np.array(border)
        seg = seg[np.abs(seg[:, 0] - seg[:, 2]) + np.abs(seg[:, 1] - seg[:, 3]) > EPS]
        perimeter = sum(_metres(*s) for s in seg.tolist())
        radius, (px, py) = _inner_circle([parts[n] for n in group], seg)
        t = np.array([parts[n] for n in group])
        deg = lambda y: math.degrees(math.asin(max(-1, min(1, y))))
        exact = lambda x: round(x, 9)  # bounds come back as they were given, without the noise of radians
        out.append({
            "phase": "before" if parts[group[0]][1] == ONLY_A else "after", "area": sum(_area(parts[n]) for n in group), "perimeter": perimeter, "radius": radius,
            "w": exact(math.degrees(t[:, [4, 6]].min())), "s": exact(deg(t[:, 2].min())), "e": exact(math.degrees(t[:, [5, 7]].max())), "n": exact(deg(t[:, 3].max())), "lon": math.degrees(px), "lat": deg(py),
            "geometry": [[{"x": math.degrees(x), "y": deg(y)} for x, y in ((l0, y0), (r0, y0), (r1, y1), (l1, y1))] for _, _, y0, y1, l0, r0, l1, r1 in (parts[n] for n in group)],
        })
    return out


def _inner_circle(parts: list, seg: np.ndarray) -> tuple[float, tuple[float, float]]:
    """The largest distance to the border, in metres, found from points in the trapezoids, then refined."""
    rows = []
    for _, _, y0, y1, l0, r0, l1, r1 in parts:
        for v in (0.25, 0.5, 0.75):
            left, right = l0 + (l1 - l0) * v, r0 + (r1 - r0) * v
            rows += [(left + (right - left) * u, y0 + (y1 - y0) * v) for u in (0.1, 0.3, 0.5, 0.7, 0.9)]
    pts = np.array(rows)
    mid = pts[:, 1].mean()
    stretch = np.array([EARTH * math.sqrt(max(1 - mid * mid, 1e-9)), EARTH / math.sqrt(max(1 - mid * mid, 1e-9))])
    a, b = seg[:, :2] * stretch, seg[:, 2:] * stretch
    d = b - a
    dd = np.maximum((d * d).sum(axis=1), 1e-12)

    def reach(p: np.ndarray) -> np.ndarray:
        q = (p * stretch)[:, None, :] - a
        u = np.clip((q * d).sum(axis=2) / dd, 0, 1)
        return np.sqrt(((q - u[:, :, None] * d) ** 2).sum(axis=2)).min(axis=1)

    far = reach(pts)
    best, radius = pts[far.argmax()], float(far.max())
    step = radius
    inside = lambda p: any(y0 <= p[1] <= y1 and l0 + (l1 - l0) * (p[1] - y0) / (y1 - y0) <= p[0] <= r0 + (r1 - r0) * (p[1] - y0) / (y1 - y0) for _, _, y0, y1, l0, r0, l1, r1 in parts)
    while step > radius * 0.01 and step > 0.01:
        near = [p for p in best + np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]) * step / stretch if inside(p)]
        if near and (found := reach(np.array(near))).max() > radius:
            best, radius = near[int(found.argmax())], float(found.max())
        else:
            step /= 2
    return radius, (float(best[0]), float(best[1]))


def _rings(value) -> list:
    return [[(p["x"], p["y"]) for p in ring] for ring in value] if value is not None else []


def _boxes(rings: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which polygons of a column are boxes along the axes (one ring of four points, closed or not, with an area), and the
    bounds (w, s, e, n) of those; nan for others."""
    n_rings = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(int)
    flat = rings.flatten()
    n_points = pc.fill_null(pc.list_value_length(flat), 0).to_numpy(zero_copy_only=False).astype(int)
    points = flat.flatten()
    first_ring, first_point = np.cumsum(n_rings) - n_rings, np.cumsum(n_points) - n_points
    one = np.flatnonzero(n_rings == 1)
    one = one[np.isin(n_points[first_ring[one]], (4, 5))]
    ring = first_ring[one]
    at = first_point[ring][:, None] + np.arange(5) % n_points[ring][:, None]
    x, y = (points.field(c).to_numpy(zero_copy_only=False).astype(float)[at] for c in ("x", "y"))
    flat_first = (y[:, 0] == y[:, 1]) & (x[:, 1] == x[:, 2]) & (y[:, 2] == y[:, 3]) & (x[:, 3] == x[:, 0])
    tall_first = (x[:, 0] == x[:, 1]) & (y[:, 1] == y[:, 2]) & (x[:, 2] == x[:, 3]) & (y[:, 3] == y[:, 0])
    bounds = np.array([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)]).T.reshape(-1, 4)
    wide = np.radians(bounds[:, 2] - bounds[:, 0]) > 1e3 * EPS
    high = np.sin(np.radians(bounds[:, 3])) - np.sin(np.radians(bounds[:, 1])) > 1e3 * EPS
    good = (flat_first | tall_first) & (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4]) & wide & high
    box = np.full((len(rings), 4), np.nan)
    box[one[good]] = bounds[good]
    return ~np.isnan(box[:, 0]), box


def _flat_box(box: np.ndarray) -> np.ndarray:
    """Bounds on the equal-area cylinder."""
    out = np.radians(box)
    out[:, 1::2] = np.sin(out[:, 1::2])
    return out


def _box_rest(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What boxes ``a`` have that ``b`` don't (degrees; p and q are the same on the cylinder): whether there is a piece, and its
    bounds. nan where it is no box."""
    common = np.concatenate([np.maximum(p[:, :2], q[:, :2]), np.minimum(p[:, 2:], q[:, 2:])], axis=1)
    apart = ((common[:, 2:] - common[:, :2]) <= EPS).any(axis=1)
    over = np.abs(common - p) > EPS  # the sides on which something of a lies beyond b
    count = np.where(apart, 0, over.sum(axis=1))
    rest = a.copy()
    for side, far in ((0, 2), (1, 3), (2, 0), (3, 1)):
        cut = (count == 1) & over[:, side]
        rest[cut, far] = b[cut, side]
    rest[count > 1] = np.nan
    return apart | (count > 0), rest


def _box_pieces(pair: pa.Array, phase: np.ndarray, box: np.ndarray) -> pa.RecordBatch:
    """Pieces that are boxes, as difference_pieces has them."""
    w, s, e, n = box.T
    x0, y0, x1, y1 = _flat_box(box).T
    along = lambda y: 2 * EARTH * np.arcsin(np.minimum(1, np.sqrt(1 - y * y) * np.abs(np.sin((x1 - x0) / 2))))
    mid = (y0 + y1) / 2
    stretch = np.sqrt(np.maximum(1 - mid * mid, 1e-9))
    perimeter = 2 * EARTH * np.radians(n - s) + along(y0) + along(y1)
    radius = np.minimum((x1 - x0) * EARTH * stretch, (y1 - y0) * EARTH / stretch) / 2
    xs, ys = np.stack([w, e, e, w], axis=1).ravel(), np.stack([s, s, n, n], axis=1).ravel()
    points = pa.StructArray.from_arrays([pa.array(xs), pa.array(ys)], names=["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * 4, pa.int32()), points)
    geometry = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1), pa.int32()), rings)
    numbers = ((x1 - x0) * (y1 - y0) * EARTH * EARTH, perimeter, radius, *(np.round(c, 9) for c in (w, s, e, n)), (w + e) / 2, np.degrees(np.arcsin(np.clip(mid, -1, 1))))
    return pa.RecordBatch.from_arrays([pair, pa.array(phase, pa.string()), *map(pa.array, numbers), geometry], schema=PIECES)


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The pieces of a batch of pairs. Boxes that differ by boxes are measured all at once, other pairs one by one."""
    pair, old, new = (batch.column(c) for c in ("pair_id", "old_rings", "new_rings"))
    (is_a, a), (is_b, b) = _boxes(old), _boxes(new)
    rows = np.flatnonzero(is_a & is_b)
    p, q = _flat_box(a[rows]), _flat_box(b[rows])
    (has_a, rest_a), (has_b, rest_b) = _box_rest(a[rows], b[rows], p, q), _box_rest(b[rows], a[rows], q, p)
    plain = ~(np.isnan(rest_a[:, 0]) | np.isnan(rest_b[:, 0]))
    for phase, has, rest in (("before", has_a & plain, rest_a), ("after", has_b & plain, rest_b)):
        if has.any():
            yield _box_pieces(pair.take(pa.array(rows[has])), np.full(has.sum(), phase), rest[has])
    easy = np.zeros(batch.num_rows, bool)
    easy[rows[plain]] = True
    hard = batch.filter(pa.array(~easy))
    for at in range(0, hard.num_rows, 1000):
        some = hard.slice(at, 1000).to_pylist()
        found = [{"pair_id": r["pair_id"]} | piece for r in some for piece in difference_pieces(_rings(r["old_rings"]), _rings(r["new_rings"]))]
        yield pa.RecordBatch.from_pylist(found, schema=PIECES)


def overlaps_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Intersection over union of a batch of pairs: boxes all at once, other pairs one by one."""
    (is_a, a), (is_b, b) = _boxes(batch.column("old_rings")), _boxes(batch.column("new_rings"))
    rows = np.flatnonzero(is_a & is_b)
    p, q = _flat_box(a[rows]), _flat_box(b[rows])
    size = np.maximum(np.minimum(p[:, 2:], q[:, 2:]) - np.maximum(p[:, :2], q[:, :2]), 0)
    both = np.where((size > EPS).all(axis=1), size[:, 0] * size[:, 1], 0.0)
    every = (p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1]) + (q[:, 2] - q[:, 0]) * (q[:, 3] - q[:, 1]) - both
    out = np.full(batch.num_rows, np.nan)
    out[rows] = both / every
    hard = np.flatnonzero(~(is_a & is_b))
    for at in range(0, len(hard), 1000):
        some = hard[at : at + 1000]
        for n, r in zip(some, batch.take(pa.array(some)).to_pylist(), strict=True):
            ratio = overlap_ratio(_rings(r["old_rings"]), _rings(r["new_rings"]))
            out[n] = np.nan if ratio is None else ratio
    kept = batch.drop_columns(["old_rings", "new_rings"])
    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, mask=np.isnan(out))], names=[*kept.schema.names, "overlap"])


def _each(of: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: (out for b in batches if b.num_rows for out in of(b))


def overlay_pairs(pairs: DataFrame) -> DataFrame:
    """The pieces of each pair (pair_id, old_rings, new_rings): one row a piece, as difference_pieces."""
    return pairs.select("pair_id", "old_rings", "new_rings").mapInArrow(_each(pieces_of), "pair_id string, phase string, area double, perimeter double, radius double, w double, s double, e double, n double, lon double, lat double, geometry array<array<struct<x: double, y: double>>>")


def overlap_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (old_rings, new_rings and what else they have) with their intersection over union instead of the rings."""
    schema = StructType([*pairs.drop("old_rings", "new_rings").schema.fields, StructField("overlap", DoubleType())])
    return pairs.mapInArrow(_each(overlaps_of), schema)
