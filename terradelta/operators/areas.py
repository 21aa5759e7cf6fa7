"""Change areas: changes of an observation that lie near each other."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import to_mercator
from ..functions.text import uuid5
from ..sources.staging import stage_table

#: Fixed value: how near, in web-map metres, changes of one area stand.
NEAR = 50_000.0
#: Fixed value: the URL namespace of name-based UUIDs, for areas' ids.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def clusters(pieces: DataFrame, near: float = NEAR) -> DataFrame:
    """Adds ``cluster`` to pieces (source_id, obs, piece, lon, lat): connected components of points within
    ``near`` metres of web map, per observation (density clustering that takes single points).

    Cells have a side of near / sqrt(2), so points of a cell are connected; cells up to two apart are
    linked if some pair of their points is near enough. Most cells are linked by their outermost points (eight at
    most), so that crowded cells are seldom compared point by point: only where those don't do. Labels then spread
    over linked cells, not points: each round takes the least neighbour label and jumps to that label's own, so
    rounds grow with the logarithm of a chain's length; each round's small table is written to the shared folder. A
    cluster's number is its least piece.
    """
    x, y = to_mercator(F.col("lon"), F.col("lat"))
    side = near / sqrt(2)
    p = pieces.withColumn("x", x).withColumn("y", y).withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    p = stage_table(p, "pieces")
    spread = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]))
    spots = stage_table(p.select("source_id", "obs", "cx", "cy", "x", "y").distinct(), "spots")
    a, b = F.struct(F.col("ax").alias("cx"), F.col("ay").alias("cy")), F.struct("cx", "cy")

    def linked(points: DataFrame, asking: DataFrame) -> DataFrame:
        """The pairs of cells (a, b) of which some point of ``asking`` (with ``d``, the way to go) is near one of ``points``."""
        ask = asking.select("source_id", "obs", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy"))
        met = ask.join(points, ["source_id", "obs", "cx", "cy"]).where(F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2) <= near * near)
        return met.select("source_id", "obs", a.alias("a"), b.alias("b")).distinct()

    ways = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    outer = spots.groupBy("source_id", "obs", "cx", "cy").agg(F.array(*[f(F.struct("x", "y"), w) for w in ways for f in (F.min_by, F.max_by)]).alias("o"))
    outer = stage_table(outer.select("source_id", "obs", "cx", "cy", F.explode(F.array_distinct("o")).alias("o")).select("source_id", "obs", "cx", "cy", "o.x", "o.y"), "outer")
    first = stage_table(linked(outer, outer.withColumn("d", spread)), "links")
    cells = outer.select("source_id", "obs", "cx", "cy").distinct()
    open_ = cells.withColumn("d", spread).withColumn("a", b).withColumn("b", F.struct((F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy")))
    open_ = open_.join(cells.select("source_id", "obs", b.alias("b")), ["source_id", "obs", "b"], "left_semi").join(first, ["source_id", "obs", "a", "b"], "left_anti")
    link = first.unionByName(linked(spots, spots.join(open_.select("source_id", "obs", "cx", "cy", "d"), ["source_id", "obs", "cx", "cy"])))
    link = stage_table(link.unionByName(link.select("source_id", "obs", F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = stage_table(p.groupBy("source_id", "obs", b.alias("cell")).agg(F.min("piece").alias("label")), "labels")
    key = ["source_id", "obs"]
    while True:
        heard = link.join(label.withColumnRenamed("cell", "b"), [*key, "b"]).groupBy(*key, F.col("a").alias("cell")).agg(F.min("label").alias("heard"))
        low = label.join(heard, [*key, "cell"], "left").select(*key, "cell", "label", F.least("label", F.coalesce("heard", "label")).alias("new"))
        jump = low.groupBy(*key, "label").agg(F.min("new").alias("to"))
        out = low.join(jump.select(*key, F.col("label").alias("new"), F.col("to").alias("far")), [*key, "new"], "left")
        out = stage_table(out.select(*key, "cell", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        moved = out.where("label <> new").limit(1).count()
        label = out.select(*key, "cell", F.col("new").alias("label"))
        if not moved:
            break
    return p.withColumn("cell", b).join(label, [*key, "cell"]).select(*pieces.columns, F.col("label").alias("cluster"))


def change_areas(clustered: DataFrame, prefix: str = "area") -> DataFrame:
    """One row a cluster: envelope, distinct (key, kind) by kind and in all, ordinal by xmin, ymin, xmax,
    ymax from 0, and a name-based id of ``prefix``, source, observation and ordinal. Pieces: (source_id, obs, cluster,
    logical_key, change_type, w, s, e, n)."""
    kinds = [F.count_distinct(F.when(F.col("change_type") == k, F.col("logical_key"))).alias(k) for k in ("added", "removed", "modified")]
    out = clustered.groupBy("source_id", "obs", "cluster").agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"), *kinds, F.count_distinct("logical_key", "change_type").alias("n_members"))
    ordinal = F.row_number().over(W.partitionBy("source_id", "obs").orderBy("w", "s", "e", "n", "cluster")) - 1
    out = out.withColumn("ordinal", ordinal)
    return out.withColumn("area_id", uuid5(NAMESPACE, F.concat_ws(":", F.lit(prefix), "source_id", "obs", "ordinal")))


def area_members(clustered: DataFrame) -> DataFrame:
    """A4: the members of change areas, a row each: (source_id, obs, cluster, logical_key, change_type)."""
    return clustered.select("source_id", "obs", "cluster", "logical_key", "change_type").distinct()


def with_style_areas(areas: DataFrame, styles: DataFrame, bounds: DataFrame) -> DataFrame:
    """A5: areas and one more, last, for each observation with restyled layers; its bounds are the new snapshot's,
    else the old one's. styles: (source_id, obs, style_count); bounds: (source_id, obs, w, s, e, n)."""
    key = ["source_id", "obs"]
    old = bounds.select("source_id", (F.col("obs") + 1).alias("obs"), *[F.col(c).alias(f"o{c}") for c in "wsen"])
    last = areas.groupBy(*key).agg(F.count("*").alias("ordinal"))
    extra = styles.where("style_count > 0").join(bounds, key, "left").join(old, key, "left").join(last, key, "left")
    extra = extra.select(*key, *[F.coalesce(c, f"o{c}").alias(c) for c in "wsen"], F.coalesce("ordinal", F.lit(0)).cast("int").alias("ordinal"), "style_count")
    return areas.withColumn("style_count", F.lit(0).cast("long")).unionByName(extra, allowMissingColumns=True)
