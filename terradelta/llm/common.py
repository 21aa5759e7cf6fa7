"""What the operators of this subpackage share: word rules, table reads, Arrow maps, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import stage_table

#: A word is a run of characters other than space and \t \n \v \f \r. ``bytes.split()`` cuts UTF-8
#: at just these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes as well as rows, so that very long texts don't add up in a worker. Spark reads these from
    the session when a plan runs; what the caller has set stays."""
    for key, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(8 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for a function from batches (dict of column lists) to batches (dict of columns)."""
    small_batches(df.sparkSession)
    like = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(like)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batch.to_pydict() for batch in batches):
            made = pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
            for at in range(0, made.num_rows, 20_000):  # an Arrow batch is one JVM buffer
                yield made.slice(at, 20_000)

    return df.mapInArrow(run, like)


def words_of(text: Column) -> Column:
    """The words of a text as an array, JVM-side; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``rank``, 0, 1, 2 … in ``order``, as a stage table. Rows are dealt by ranges of the order and numbered as they
    are written; a range's rank begins at the sum of the ranges before it (a row a range). So no task holds more than its
    range, whatever the ids are like; rows that are equal in ``order`` are told apart by where they were read."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    out = stage_table(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), name)
    out = out.withColumn("_range", F.shiftrightunsigned("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = out.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_start"))
    return out.join(starts, "_range").withColumn("rank", F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges over longs: rows (node, root), root the smallest node
    of its component, for every node that has an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014): O(log^2 n) rounds whatever the
    shape of the graph. Neighbours are only ever reduced with min(), so a hub is combined map-side; the
    join back to its edges is an ordinary equi-join, which AQE splits when one hub is hot. Each round
    is written to the shared folder; the driver sees two numbers a round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stage_table(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = stage_table(small, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
