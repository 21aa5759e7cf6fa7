"""Identities of features that share a base key, kept across a source's snapshots.

Matching neighbouring snapshots doesn't depend on the keys that come of it, so all pairs of neighbours are matched at once;
keys then run down the chains of matches by pointer jumping. No task holds more than one base's features of two
snapshots at a time, however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import stage_table, whole_unions

#: The most confidence of an identity by content, by nearness and a new one, for bases that are
#: all stable ids and for others; and from where on an id is stable.
STABLE, LOOSE = {"exact": 0.9, "near": 0.9, "new": 0.85}, {"exact": 0.65, "near": 0.55, "new": 0.45}
SURE = 0.95

GROUP = ["source_id", "base_key", "obs"]
NODE = ["source_id", "base_key", "obs", "row_id"]
PAIR = [*NODE, "old_id", "kind"]


def nearest_first(new: list[tuple], old: list[tuple]) -> list[tuple[str, str]]:
    """Pairs (row_id, old_id) of one base in two snapshots, of rows (row_id, lon, lat): the new features in their order each
    take the nearest centre that is left (squared degrees; of equals the first), until none is left."""
    if len(old) < 16:
        free, took = list(old), []
        for row_id, x, y in new[: len(old)]:
            k = min(range(len(free)), key=lambda k: (free[k][1] - x) ** 2 + (free[k][2] - y) ** 2)
            took.append((row_id, free.pop(k)[0]))
        return took
    lon, lat, far = np.array([o[1] for o in old]), np.array([o[2] for o in old]), np.zeros(len(old))
    took = []
    for row_id, x, y in new[: len(old)]:
        k = int(np.argmin((lon - x) ** 2 + (lat - y) ** 2 + far))
        far[k] = np.inf
        took.append((row_id, old[k][0]))
    return took


def near_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of features that content left over. Rows come sorted by base and snapshot, old ones first, then in order."""
    held, key = ([], []), None
    out: list[tuple] = []

    def close() -> None:
        out.extend((*key, *p, "near") for p in nearest_first(held[1], held[0]))

    for batch in batches:
        for *group, side, row_id, lon, lat in zip(*(batch[c].tolist() for c in (*GROUP, "side", "row_id", "lon", "lat")), strict=True):
            if group != key:
                if key is not None:
                    close()
                held, key = ([], []), group
            held[side].append((row_id, lon, lat))
        yield pd.DataFrame(out, columns=PAIR)
        out.clear()
    if key is not None:
        close()
        yield pd.DataFrame(out, columns=PAIR)


def matches(shared: DataFrame, features: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(source_id, base_key, obs, row_id, old_obs, old_id, kind) of features ``shared`` by a base within their snapshot, matched with
    those of the base in the snapshot before: exact by content, as often as both sides have it, in order of row_id; then
    near, the nearest that content left over."""
    nth = F.row_number().over(W.partitionBy(*GROUP, "content_hash").orderBy("row_id"))
    new = stage_table(shared.withColumn("nth", nth), "identity-new")
    old = features.withColumn("nth", nth)
    if before is None:
        old = old.withColumn("obs", F.col("obs") + 1)
    else:
        old = old.withColumnRenamed("obs", "old_obs").join(before, ["source_id", "old_obs"]).drop("old_obs")
    old = stage_table(old.join(new.select(*GROUP).distinct(), GROUP, "left_semi"), "identity-old")
    same = ["source_id", "base_key", "obs", "content_hash", "nth"]
    exact = new.join(old.select(*same, F.col("row_id").alias("old_id")), same).select(*NODE, "old_id", F.lit("exact").alias("kind"))
    some = lambda df: df.select(*NODE, "content_hash", "lon", "lat")
    rest = some(new.join(old.select(*same), same, "left_anti"))
    left = some(old.join(new.select(*same), same, "left_anti"))
    rest, left = rest.join(left.select(*GROUP).distinct(), GROUP, "left_semi"), left.join(rest.select(*GROUP).distinct(), GROUP, "left_semi")

    both = left.withColumn("side", F.lit(0)).unionByName(rest.withColumn("side", F.lit(1)))
    order = [*GROUP, "side", F.when(F.col("side") == 1, F.col("content_hash")), "row_id"]
    near = both.repartition(*GROUP).sortWithinPartitions(*order).select(*GROUP, "side", "row_id", "lon", "lat")
    near = near.mapInPandas(near_pairs, "source_id string, base_key string, obs long, row_id string, old_id string, kind string")
    found = exact.unionByName(near)
    return found.withColumn("old_obs", F.col("obs") - 1) if before is None else found.join(before, ["source_id", "obs"])


def roots(links: DataFrame) -> DataFrame:
    """(source_id, base_key, obs, row_id, root_obs, root_id) of features that are linked to one of the snapshot before: where
    their chain begins. Each round a feature's pointer jumps to where the pointer of its target points, so chains of n
    snapshots take log2(n) rounds; each is written to the shared folder, and the driver sees one number a round."""
    now = stage_table(links.select(*NODE, F.col("old_obs").alias("root_obs"), F.col("old_id").alias("root_id"), F.lit(False).alias("done")), "pointers")
    while now.where("NOT done").limit(1).count():
        to = now.select("source_id", "base_key", F.col("obs").alias("root_obs"), F.col("row_id").alias("root_id"), F.col("root_obs").alias("far_obs"), F.col("root_id").alias("far_id"))
        moved = now.where("NOT done").join(to, ["source_id", "base_key", "root_obs", "root_id"], "left")
        moved = moved.select(*NODE, F.coalesce("far_obs", "root_obs").alias("root_obs"), F.coalesce("far_id", "root_id").alias("root_id"), F.col("far_obs").isNull().alias("done"))
        now = stage_table(now.where("done").unionByName(moved), "pointers")
    return now.drop("done")


def numbered_keys(begun: DataFrame, chains: DataFrame) -> DataFrame:
    """``begun`` (features that begin a chain in a shared group: NODE, content_hash and stem) with the number of each key: the least that no
    key of the same stem in its group has yet. Keys that came down a chain are there first, then new ones in order.

    A number depends on those of chains that began earlier and share its stem and group. Few do; they are numbered again
    until nothing changes.
    """
    order = W.partitionBy(*GROUP, "stem").orderBy("content_hash", "row_id")
    begun = stage_table(begun.withColumn("nth", F.row_number().over(order).cast("long")), "identity-begun")
    # Chains with the stem of a new key that run through the group where that begins.
    origin = begun.select("source_id", "base_key", F.col("obs").alias("root_obs"), F.col("row_id").alias("root_id"), "stem")
    through = chains.join(origin, ["source_id", "base_key", "root_obs", "root_id"]).join(begun.select(*GROUP, "stem").distinct(), [*GROUP, "stem"], "left_semi")
    through = stage_table(through.select(*GROUP, "stem", "root_obs", "root_id").distinct(), "identity-through")
    now = begun.withColumn("number", F.col("nth"))
    seen = None
    while True:
        known = now.select("source_id", "base_key", "stem", F.col("obs").alias("root_obs"), F.col("row_id").alias("root_id"), "number")
        taken = through.join(known, ["source_id", "base_key", "stem", "root_obs", "root_id"]).groupBy(*GROUP, "stem").agg(F.array_sort(F.collect_set("number")).alias("taken"))  # of one group
        free = F.aggregate(F.coalesce("taken", F.array().cast("array<long>")), F.col("nth"), lambda n, x: F.when(x <= n, n + 1).otherwise(n))
        now = stage_table(begun.join(taken, [*GROUP, "stem"], "left").select(*NODE, "stem", "nth", free.alias("number")), "identity-numbers")
        total = now.agg(F.sum(F.xxhash64(*NODE, "number").cast("decimal(38,0)"))).first()[0]
        if total == seen or through.isEmpty():
            return now.drop("nth")
        seen = total


def fold_identities(features: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """logical_key and confidence for features (source_id, obs, base_key, row_id, content_hash, confidence, lon, lat);
    row_id is unique in its snapshot. A base that a snapshot has once is the key itself. Features that share a base take the
    key of the feature with equal content in the snapshot before, else of the nearest one left (see matches), else a
    new key: base#, 16 digits of the content's hash and, if the group has that key, a number.

    ``before`` (source_id, obs, old_obs) names the snapshot that came before each, where that isn't the one numbered before
    (a source may have gone back to an older one in between); snapshots that it leaves out have none before them.
    """
    whole_unions(features.sparkSession)
    n = F.count("*").over(W.partitionBy(*GROUP))
    sure = F.min("confidence").over(W.partitionBy(*GROUP)) >= SURE
    f = stage_table(features.withColumn("shared", n > 1).withColumn("sure", sure), "identity-features")
    often = f.where("shared").select("source_id", "base_key").distinct()
    plain = f.join(often, ["source_id", "base_key"], "left_anti").select(*NODE, F.col("base_key").alias("logical_key"), "confidence")
    f = stage_table(f.join(often, ["source_id", "base_key"], "left_semi"), "identity-shared")
    links = stage_table(matches(f.where("shared"), f, before), "identity-links")
    chains = stage_table(roots(links), "identity-chains")

    begun = f.where("shared").join(links.select(*NODE), NODE, "left_anti")
    begun = begun.select(*NODE, "content_hash", F.concat("base_key", F.lit("#"), F.substring("content_hash", 1, 16)).alias("stem"))
    keys = numbered_keys(begun, chains)
    keys = keys.select(*NODE, F.when(F.col("number") > 1, F.concat_ws("-", "stem", "number")).otherwise(F.col("stem")).alias("key"))
    single = f.where("NOT shared").select(*NODE, F.col("base_key").alias("key"))
    first = keys.unionByName(single)
    origin = first.select("source_id", "base_key", F.col("obs").alias("root_obs"), F.col("row_id").alias("root_id"), "key")
    came = chains.join(origin, ["source_id", "base_key", "root_obs", "root_id"]).select(*NODE, "key")
    named = first.unionByName(came)

    def most(kind: Column) -> Column:
        cap = F.lit(None).cast("double")
        for k in STABLE:
            cap = F.when(kind == k, F.when(F.col("sure"), STABLE[k]).otherwise(LOOSE[k])).otherwise(cap)
        return cap

    out = f.join(named, NODE).join(links.select(*NODE, "kind"), NODE, "left")
    kind = F.when(F.col("shared"), F.coalesce("kind", F.lit("new")))
    out = out.select(*NODE, F.col("key").alias("logical_key"), F.least("confidence", F.coalesce(most(kind), F.lit(1.0))).alias("confidence"))
    return plain.unionByName(out)
