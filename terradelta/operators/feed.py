"""The feed of change areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(areas: DataFrame, sources: DataFrame, limit: int, day: tuple[Column, Column] | None = None, source: str | None = None, cursor: tuple[Column, Column] | None = None) -> DataFrame:
    """K1: newest areas first, by (observed_at, area_id): of enabled sources, a source, an instant range and before a
    cursor, as asked. One row more than ``limit`` tells that there is more; Spark takes them per partition."""
    rows = areas.join(sources.where("enabled").select("source_id"), "source_id")
    if day is not None:
        rows = rows.where((F.col("observed_at") >= day[0]) & (F.col("observed_at") < day[1]))
    if source is not None:
        rows = rows.where(F.col("source_id") == source)
    if cursor is not None:
        rows = rows.where(F.struct("observed_at", "area_id") < F.struct(cursor[0].alias("observed_at"), cursor[1].alias("area_id")))
    return rows.orderBy(F.desc("observed_at"), F.desc("area_id")).limit(limit + 1)


def status(areas: DataFrame, cursor: tuple[Column, Column], most: int = 100) -> DataFrame:
    """K2: the newest (observed_at, area_id) and how many areas are newer than the cursor, at most ``most``."""
    place = F.struct("observed_at", "area_id")
    newer = place > F.struct(cursor[0].alias("observed_at"), cursor[1].alias("area_id"))
    out = areas.agg(F.max(place).alias("last"), F.count_if(newer).alias("unread"))
    return out.select("last.observed_at", "last.area_id", F.least("unread", F.lit(most)).alias("unread"))
