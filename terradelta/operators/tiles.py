"""Map tiles: which tiles features touch, coordinates within a tile, simplified lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import WORLD, tile_of, to_mercator

#: Units of a tile's side, how far beyond it features are kept, and the zoom from which lines stay whole.
EXTENT, BUFFER, WHOLE_ZOOM = 4096, 64, 12


def assign(features: DataFrame, zoom: int) -> DataFrame:
    """(source_id, obs, feature_id, z, x, y) for each tile that a feature's box, grown by the buffer, touches."""
    pad = 360.0 / 2**zoom * BUFFER / EXTENT
    west, north = tile_of(F.col("w") - pad, F.col("n") + pad, zoom)
    east, south = tile_of(F.col("e") + pad, F.col("s") - pad, zoom)
    rows = features.withColumn("x", F.explode(F.sequence(west, east)))
    rows = rows.withColumn("y", F.explode(F.sequence(north, south)))
    return rows.select("source_id", "obs", "feature_id", F.lit(zoom).alias("z"), "x", "y")


def in_tile(points: DataFrame) -> DataFrame:
    """Adds tx, ty: coordinates on the 4096 grid of tile (z, x, y) for rows with lon and lat."""
    mx, my = to_mercator(F.col("lon"), F.col("lat"))
    count = F.pow(F.lit(2.0), F.col("z"))
    tx = F.round(((mx / WORLD + 0.5) * count - F.col("x")) * EXTENT).cast("int")
    ty = F.round(((F.lit(0.5) - my / WORLD) * count - F.col("y")) * EXTENT).cast("int")
    return points.withColumn("tx", tx).withColumn("ty", ty)


def tolerance(zoom: int) -> float:
    """Half a grid unit of a tile, in web-map metres; 0 where lines stay whole."""
    return 0.0 if zoom >= WHOLE_ZOOM else WORLD / 2**zoom / (2 * EXTENT)


def simplify(points: np.ndarray, reach: float, closed: bool) -> np.ndarray:
    """Douglas-Peucker with an own stack; a ring keeps at least four points, or stays as it was."""
    if len(points) < 3 or reach <= 0:
        return points
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        d = q - p
        along = np.clip(((mid - p) @ d) / max(float(d @ d), 1e-18), 0, 1)
        far = np.hypot(*(mid - p - along[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > reach:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points if closed and keep.sum() < 4 else points[keep]


def simplify_lines(lines: DataFrame, zoom: int) -> DataFrame:
    """(line_id, n_points, n_kept) and the kept points of lines (line_id, xs, ys, closed) in web-map metres."""
    reach = tolerance(zoom)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [simplify(np.column_stack((x, y)), reach, c) for x, y, c in zip(b["xs"], b["ys"], b["closed"], strict=True)]
            yield pd.DataFrame({"line_id": b["line_id"], "n_points": [len(x) for x in b["xs"]], "n_kept": [len(k) for k in kept], "xs": [k[:, 0].tolist() for k in kept], "ys": [k[:, 1].tolist() for k in kept]})

    return lines.mapInPandas(run, "line_id string, n_points long, n_kept long, xs array<double>, ys array<double>")
