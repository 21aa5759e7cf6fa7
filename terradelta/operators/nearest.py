"""Nearest features of one group in another, without all pairs of large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH, ground_distance
from ..sources.staging import stage_table

#: Pairs of a group up to which all of them are candidates.
ALL_PAIRS = 10_000
#: Rings are cells of 360 / 2^level degrees and their eight neighbours, from fine to coarse.
LEVELS = (16, 13, 10, 7, 4, 2)

KEY = ["source_id", "obs", "base_key"]


def _cell(level: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    step = 360 / 2**level
    return F.floor((lon + 180) / step), F.floor((lat + 90) / step)


def nearest(asking: DataFrame, asked: DataFrame) -> DataFrame:
    """(KEY, id, other, distance) for each row of ``asking`` (KEY, id, lon, lat) the nearest of ``asked`` in its group by metres
    on the sphere; of equals the smallest id.

    Each looks in its own cell and those around it. What it finds there is the nearest if it lies nearer than anything
    beyond these cells can; only those without such a find look again in cells eight times as wide. Equal centres ask and
    answer once. A group whose two sides lie far from each other still meets there as all pairs.
    """
    centre = [*KEY, "lon", "lat"]
    left = stage_table(asking.select(*centre).distinct(), "nearest-asking")
    right = stage_table(asked.groupBy(*centre).agg(F.min("id").alias("other")).withColumnsRenamed({"lon": "x", "lat": "y"}), "nearest-asked")
    found = None
    for level in (*LEVELS, None):
        if left.isEmpty():
            break
        if level is None:
            met = left.join(right, KEY)
        else:
            cx, cy = _cell(level, F.col("lon"), F.col("lat"))
            around = F.array_distinct(F.array(*[F.struct(F.pmod(cx + i, F.lit(2**level)).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
            rx, ry = _cell(level, F.col("x"), F.col("y"))
            there = right.withColumn("cx", F.pmod(rx, F.lit(2**level))).withColumn("cy", ry)
            met = left.withColumn("c", F.explode(around)).select(*centre, "c.*").join(there, [*KEY, "cx", "cy"])
        best = met.groupBy(*centre).agg(F.min(F.struct(ground_distance(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")).alias("distance"), "other")).alias("best"))
        if level is None:
            sure = F.lit(True)
        else:  # the way to the meridian one cell off is shorter than that to the parallel
            step = F.radians(F.lit(min(360 / 2**level, 90.0)))
            sure = F.col("best.distance") < F.asin(F.cos(F.radians("lat")) * F.sin(step)) * EARTH * (1 - 1e-9)
        best = stage_table(best.where(sure), "nearest-found")
        found = best if found is None else found.unionByName(best)
        if level is not None:
            left = stage_table(left.join(best, centre, "left_anti"), "nearest-left")
    if found is None:
        return asking.limit(0).select(*KEY, "id", F.col("id").alias("other"), F.lit(0.0).alias("distance"))
    return asking.join(found, centre).select(*KEY, "id", "best.other", "best.distance")


def candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """(KEY, old_id, new_id, distance) between rows (KEY, id, lon, lat) of one group: all pairs of groups that have few,
    of others each row's nearest on the other side. Each row's best is among them, which is all that mutual_best needs."""
    size = lambda df, name: df.groupBy(*KEY).agg(F.count("*").alias(name))
    large = stage_table(size(old, "a").join(size(new, "b"), KEY).where(F.col("a") * F.col("b") > ALL_PAIRS).select(*KEY), "nearest-large")
    few = lambda df: df.join(large, KEY, "left_anti")
    theirs = few(new).select(*KEY, F.col("id").alias("new_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    distance = ground_distance(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    out = few(old).withColumnRenamed("id", "old_id").join(theirs, KEY).select(*KEY, "old_id", "new_id", distance.alias("distance"))
    if large.isEmpty():
        return out
    many = lambda df: df.join(large, KEY, "left_semi")
    forth = nearest(many(old), many(new)).select(*KEY, F.col("id").alias("old_id"), F.col("other").alias("new_id"), "distance")
    back = nearest(many(new), many(old)).select(*KEY, F.col("other").alias("old_id"), F.col("id").alias("new_id"), "distance")
    return out.unionByName(forth.unionByName(back).dropDuplicates([*KEY, "old_id", "new_id"]))
