"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words_of, ranked, stage_table

#: Parts in which rows of one doc_id, source and size are numbered.
PARTS = 1024


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size, n): sources in code-point order, null last,
    weigh ``weights`` in turn and share all words; a target stops at ``most`` times its source's size and
    the excess is shared again by weight.

    Water-filling in closed form: with sources in order of cap/weight, source k is capped exactly when
    the level left after capping all before it lies above its own ratio. One row a source reaches the
    single-partition windows, after aggregation. Sources without words get target 0.
    """
    src = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1))
    src = src.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy().orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    src = src.withColumn("level", F.when(F.col("level") <= F.col("ratio"), F.col("level")))
    # The level after the last cap is the highest of those that cap nobody: later ones are lower.
    src = src.withColumn("final", F.max("level").over(everything))
    return src.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    Each document of a source is expected ``target / source_size`` times. Documents are ordered by size
    (largest first), then doc_id; the prefix sum of expected copies plus one random offset (drawn from
    ``seed``) crosses ``copies`` integers at a document. Ordering by size keeps the words taken within
    one largest document of the target. Reruns agree as the order and the offset are fixed.

    The prefix sum is a rank: rows are dealt by ranges of (source, size, doc_id) and numbered within them (see
    common.ranked), and a source's first rank is taken off. No task holds a source, a size or a block of ids.
    Null or empty text: size 0, emitted like others, takes no words. Null source: a source of its own,
    last. Null doc_id: sorts first within its size. Repeated rows count as rows. Empty table: no rows. Only
    doc_id, source and text are read, so other columns may have any name.
    """
    sized = docs.select("doc_id", "source", n_words_of(F.col("text")).alias("size"))
    sized = stage_table(sized, "sizes")
    sizes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    rows = ranked(sized, [F.asc_nulls_last("source"), F.desc("size"), F.asc("doc_id")], "ranks")
    starts = rows.groupBy("source").agg(F.min("rank").alias("first"))
    targets = source_targets(sizes, weights, most)
    place = starts.withColumnRenamed("source", "of").join(targets, F.col("of").eqNullSafe(targets["source"])).select("of", "first", "source_size", "target")
    rows = rows.join(place, rows["source"].eqNullSafe(F.col("of"))).select("doc_id", "source", "size", "source_size", "target", (F.col("rank") - F.col("first") + 1).alias("position"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.lit(random.Random(seed).random())
    rows = rows.withColumn("rate", rate)
    copies = F.floor(offset + F.col("rate") * F.col("position")) - F.floor(offset + F.col("rate") * (F.col("position") - 1))
    return rows.withColumn("copies", F.least(copies, F.lit(most)).cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs``, all columns as they were, as often as ``mixed`` says. Rows that share
    doc_id, source and size share out the copies of these.

    Such rows are numbered in parts by their text's hash, each part from where the one before it ends; the
    numbers that get 0, 1, 2 ... copies are ranges of counts, so no list of rows or copies is gathered, and
    rows with null doc_id spread over sizes and parts.
    """
    key = ["_id", "_no_id", "_source", "_no_source", "_size"]

    def keyed(df: DataFrame, *more: Column) -> DataFrame:
        own = (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("size"))
        return df.select(*[c.alias(k) for c, k in zip(own, key, strict=True)], *more)

    ways = keyed(mixed, F.col("copies").cast("int").alias("_copies")).groupBy(*key, "_copies").agg(F.count("*").alias("n"))
    ways = ways.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_copies", "n"))).alias("_ways"))  # an entry a number of copies
    row = F.struct(*docs.columns).alias("_row")
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS)).alias("_part")
    sized = docs.select(row, "doc_id", "source", "text", n_words_of(F.col("text")).alias("size"))
    parts = keyed(sized, part).groupBy(*key, "_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("n").join(ways, key)
    rows = keyed(sized, part, F.col("_row")).withColumn("_nth", F.row_number().over(W.partitionBy(*key, "_part").orderBy(F.lit(0))))
    rows = rows.join(parts, [*key, "_part"]).withColumn("_nth", F.col("_nth") + F.col("_before"))
    # Walk the ranges: what is left of the number after each, and the copies of the range it falls in.
    start = F.struct(F.col("_nth").cast("long").alias("left"), F.lit(0).alias("times"))
    step = lambda x, w: F.struct((x["left"] - w["n"]).alias("left"), F.when((x["left"] > 0) & (x["left"] <= w["n"]), w["_copies"]).otherwise(x["times"]).alias("times"))
    rows = rows.withColumn("_times", F.aggregate("_ways", start, step)["times"]).where("_times > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
