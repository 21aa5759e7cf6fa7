"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stage_table

#: Groups that one task differences, and partial partitions that one task of a later level combines.
BUCKET = 4096
FAN_IN = 256


def difference(items: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Karmarkar-Karp over partial partitions of k sums each: the two with the largest spread are combined,
    the largest part of one with the smallest of the other, until one is left. Returns its k sums
    and, for each item, the part that each of its k parts went to."""
    k = len(items[0])
    heap, nodes = [], []
    for n, sums in enumerate(items):
        order = sorted(range(k), key=lambda j: -sums[j])
        s = [sums[j] for j in order]
        nodes.append((None, None, order))
        heap.append((s[-1] - s[0], n, s))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x, a = heapq.heappop(heap)
        _, y, b = heapq.heappop(heap)
        both = [a[j] + b[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=lambda j: -both[j])
        s = [both[j] for j in order]
        nodes.append((x, y, order))
        heapq.heappush(heap, (s[-1] - s[0], len(nodes) - 1, s))
    parts: list[list[int]] = [[] for _ in items]
    walk = [(heap[0][1], list(range(k)))]  # a node and where each of its sorted parts ends up
    while walk:
        n, to = walk.pop()
        x, y, order = nodes[n]
        place = [0] * k
        for j, o in enumerate(order):
            place[o] = to[j]
        if x is None:
            parts[n] = place
        else:
            walk += [(x, place), (y, place[::-1])]
    return heap[0][2], parts


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; law ``bytes``: the shards'
    sums of size come out near equal. Size: UTF-8 bytes of the text plus 1. Rows with equal texts (null
    counts as empty) form one group and share a shard.

    Differencing is hierarchical: groups are hashed into buckets of about 4,096, each bucket is
    differenced in its task to one partial partition of ``shards`` sums, and partial partitions are
    differenced again, 256 a task, until one is left. Only sums travel upwards and permutations
    downwards, so no task or driver holds all groups. A group larger than a shard's fair share
    can't be balanced by any method; it gets a shard to itself as far as the others allow.

    Slots run from 0 without gaps within a shard, by doc_id: rows are numbered by ranges of (shard, doc_id) (see
    common.ranked), so no task holds a shard. Null doc_id: first in its shard. Repeated rows are rows of one group. Empty table: no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = stage_table(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    buckets = max(1, -(-groups.count() // BUCKET))
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        _, parts = difference([[b] + [0] * (shards - 1) for b in pdf["bytes"].tolist()])
        return pd.DataFrame({"bucket": pdf["bucket"], "key": pdf["key"], "bytes": pdf["bytes"], "part": [p[0] for p in parts]})

    placed = stage_table(groups.groupBy("bucket").applyInPandas(first, "bucket long, key binary, bytes long, part int"), "parts")
    sums = placed.groupBy("bucket").agg(*[F.sum(F.when(F.col("part") == j, F.col("bytes")).otherwise(0)).alias(f"s{j}") for j in range(shards)])
    level = sums.select("bucket", F.array(*[f"s{j}" for j in range(shards)]).alias("sums"))
    to = None  # bucket of the level now -> parts of each first-level bucket
    while True:

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("bucket")
            total, parts = difference([list(map(int, s)) for s in pdf["sums"]])
            return pd.DataFrame({"bucket": pdf["bucket"], "up": pdf["up"], "parts": parts, "total": [total] * len(pdf)})

        met = level.withColumn("up", F.floor(F.col("bucket") / FAN_IN)).groupBy("up").applyInPandas(combine, "bucket long, up long, parts array<int>, total array<long>")
        met = stage_table(met, "level")
        step = met.select("bucket", "up", "parts")
        if to is None:
            to = step.select(F.col("bucket").alias("leaf"), "up", "parts")
        else:
            lower = to.select("leaf", F.col("up").alias("bucket"), F.col("parts").alias("below"))
            to = stage_table(lower.join(step, "bucket").select("leaf", "up", F.transform("below", lambda p: F.get("parts", p)).alias("parts")), "to")
        buckets = -(-buckets // FAN_IN)
        if buckets == 1:
            break
        level = met.groupBy(F.col("up").alias("bucket")).agg(F.first("total").alias("sums"))
    homes = placed.join(to, placed["bucket"] == to["leaf"]).select("key", F.get("parts", F.col("part")).alias("shard"))
    rows = ranked(rows.join(homes, "key").select("doc_id", "size", "text_crc32", "shard"), [F.asc("shard"), F.asc("doc_id"), F.asc("text_crc32")], "slots")
    starts = F.broadcast(rows.groupBy("shard").agg(F.min("rank").alias("first")))  # a row a shard
    return rows.join(starts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
