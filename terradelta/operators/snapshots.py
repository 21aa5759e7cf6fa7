"""Snapshots: content hashes, statuses, the observation timeline, as-of reads, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import bounds


def content_hashes(features: DataFrame) -> DataFrame:
    """A2: (source_id, run_id, content_hash, n_features) from (source_id, run_id, layer_key, label, geometry_type,
    paint, feature_hash): independent of the order of features and layers; a feature's id plays no part.
    Only hashes are shuffled: per bucket of a layer (by their first digits, so that no task gathers a layer's) first,
    then the buckets' hashes per layer, then the layers' per run."""
    key = ("source_id", "run_id", "layer_key", "label", "geometry_type", "paint")
    buckets = features.groupBy(*key, F.substring("feature_hash", 1, 4).alias("bucket")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("feature_hash"))), 256).alias("h"), F.count("feature_hash").alias("n"))
    parts = F.concat_ws(",", F.array_sort(F.collect_list(F.concat("bucket", "h"))))
    layers = buckets.groupBy(*key).agg(F.sha2(parts, 256).alias("h"), F.sum("n").alias("n"))
    line = F.concat_ws("|", "layer_key", "label", "geometry_type", "paint", "h")
    return layers.groupBy("source_id", "run_id").agg(F.sha2(F.concat_ws("\n", F.col("source_id"), F.concat_ws("\n", F.array_sort(F.collect_list(line)))), 256).alias("content_hash"), F.sum("n").alias("n_features"))


def snapshot_bounds(features: DataFrame) -> DataFrame:
    """A3: (source_id, run_id, w, s, e, n) over all coordinates; nulls without any."""
    b = features.withColumn("b", bounds(F.col("geometry")))
    return b.groupBy("source_id", "run_id").agg(F.min("b.w").alias("w"), F.min("b.s").alias("s"), F.max("b.e").alias("e"), F.max("b.n").alias("n"))


def run_status(runs: DataFrame) -> DataFrame:
    """Adds ``status``: unchanged if the hash equals that of the source's run before it (by observed_at, then
    run_id), else stored, or reversion if an earlier run had it."""
    order = W.partitionBy("source_id").orderBy("observed_at", "run_id")
    seen = F.row_number().over(W.partitionBy("source_id", "content_hash").orderBy("observed_at", "run_id")) > 1
    same = F.col("content_hash").eqNullSafe(F.lag("content_hash").over(order)) & (F.row_number().over(order) > 1)
    return runs.withColumn("status", F.when(same, "unchanged").when(seen, "reversion").otherwise("stored"))


def timeline(stored: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Observations from stored runs: previous_snapshot, is_baseline and valid_to (the next observation of the
    source). Sources in ``existing`` already have a timeline and are left out."""
    if existing is not None:
        stored = stored.join(existing.select("source_id").distinct(), "source_id", "left_anti")
    order = W.partitionBy("source_id").orderBy("observed_at", "run_id")
    out = stored.withColumn("previous_snapshot", F.lag("content_hash").over(order)).withColumn("valid_to", F.lead("observed_at").over(order))
    return out.withColumn("is_baseline", F.row_number().over(order) == 1)


def as_of(observations: DataFrame, days: DataFrame, end_of_day: Column | None = None) -> DataFrame:
    """For each source and ``day`` the last observation strictly before the day's end; content_hash is null
    where the source had none. Observations become day intervals, so days meet them in an equi-join on
    days, however many are asked."""
    end = F.date_add("day", 1).cast("timestamp") if end_of_day is None else end_of_day
    spans = observations.select("source_id", "content_hash", "observed_at", F.coalesce(F.lead("observed_at").over(W.partitionBy("source_id").orderBy("observed_at", "run_id")), F.lit("9999-12-31").cast("timestamp")).alias("until"))
    asked = days.select("day", end.alias("end"))
    limits = asked.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    # The days at whose end an observation holds: from its own to that before its successor's; at most
    # those that were asked about.
    reach = spans.join(F.broadcast(limits)).withColumn("day", F.explode(F.sequence(F.greatest(F.date_sub(F.to_date("observed_at"), 1), "a"), F.greatest(F.least(F.date_add(F.to_date("until"), 1), "z"), F.greatest(F.date_sub(F.to_date("observed_at"), 1), "a")))))
    held = reach.join(asked, "day").where((F.col("observed_at") < F.col("end")) & (F.col("until") >= F.col("end"))).select("source_id", "day", "content_hash", "observed_at")
    every = observations.select("source_id").distinct().crossJoin(F.broadcast(asked.select("day").distinct()))
    return every.join(held, ["source_id", "day"], "left")


def latest_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Each source with its latest run; nulls if it has none."""
    last = runs.groupBy("source_id").agg(F.max(F.struct("observed_at", "run_id", "content_hash")).alias("last"))
    return sources.join(last, "source_id", "left").select("source_id", "last.observed_at", "last.run_id", "last.content_hash")


def health(runs: DataFrame, now: Column) -> DataFrame:
    """Failed runs of the last 24 hours and the last successful run, overall."""
    recent = (F.col("status") == "failed") & (F.col("observed_at") >= now - F.expr("INTERVAL 24 HOURS"))
    return runs.agg(F.count_if(recent).alias("failed_24h"), F.max(F.when(F.col("status").isin("stored", "reversion", "unchanged", "not_modified"), F.col("observed_at"))).alias("last_success"))


def overdue(sources: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Sources (source_id, default_seconds, layer_seconds map) whose last run is older than three times their
    longest refresh interval and 1,200 seconds, or that never ran."""
    last = runs.groupBy("source_id").agg(F.max("observed_at").alias("last_run"))
    longest = F.array_max(F.concat(F.array("default_seconds"), F.map_values("layer_seconds")))
    out = sources.join(last, "source_id", "left").withColumn("limit_s", F.greatest(longest * 3, F.lit(1200.0)))
    age = now.cast("double") - F.col("last_run").cast("double")
    return out.select("source_id", "last_run", "limit_s", (F.col("last_run").isNull() | (age > F.col("limit_s"))).alias("overdue"))


def calendar(observations: DataFrame, events: DataFrame, retention_start: Column, today: Column) -> DataFrame:
    """A10: the selectable days: from the first observation, event or retention start (the earliest) to today."""
    first = observations.agg(F.to_date(F.min("observed_at")).alias("o")).crossJoin(events.agg(F.to_date(F.min("event_date")).alias("e")))
    return first.select(F.explode(F.sequence(F.least("o", "e", retention_start), today)).alias("day"))


def freshness(latest: DataFrame) -> DataFrame:
    """T5: adds ``state`` from (error, has_data): ok, stale (an error, but data), error, empty."""
    has, bad = F.col("has_data"), F.col("error").isNotNull()
    return latest.withColumn("state", F.when(has & ~bad, "ok").when(has, "stale").when(bad, "error").otherwise("empty"))


def verify_shadow(expected: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Per source the fields in which the expected and the stored state differ; none: no row."""
    e, s = expected.select("source_id", F.struct(*fields).alias("e")), stored.select("source_id", F.struct(*fields).alias("s"))
    both = e.join(s, "source_id", "full_outer")
    wrong = F.filter(F.array(*[F.when(~F.col(f"e.{f}").eqNullSafe(F.col(f"s.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return both.select("source_id", F.array_join(wrong, ",").alias("mismatches")).where("mismatches <> ''")
