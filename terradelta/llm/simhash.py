"""SimHash fingerprints and their links within a Hamming radius, by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat
from operator import add

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, map_rows, stage_table

SEED = 42
CHUNK = 1 << 15


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``words``-word shingle, repeats included; a shorter text is one shingle, a
    text without words none. A-Z are lower-cased; other letters stay."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    if len(w) <= words:
        pieces = [joined]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [joined[a:b] for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash: a bit is 1 if it is set in over half of the hashes; none: 0."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):  # a very long text takes bounded memory
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row. Null text counts as empty: fingerprint 0."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "fp": [fingerprint(shingle_hashes(t or b"", words)) for t in b["text"]]}

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), run, "doc_id long, fp long")


def ball(bits: int, half: int) -> list[int]:
    """Masks of up to ``half`` of ``bits`` bits, as signed longs."""
    masks = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = 2, bits: int = 64) -> DataFrame:
    """Star edges (a, b) between the ``nodes`` (node, key) whose keys differ in at most ``radius`` of their
    low ``bits`` bits and nowhere else.

    Nodes with one key link to the least of them, which alone goes on for that key. Two keys within
    ``radius`` (even) share a variant within radius / 2 of both: each distinct key emits its half-radius
    ball, the shuffle is on the variant, and a variant that two keys reach collides. All that meet at a
    variant are within ``radius`` of each other, so linking each to the least of them connects what all pairs
    would connect. Least, greatest and number are combined as rows arrive; where more than two meet (never
    more than the ball has members, as keys differ), an equi-join on the variant gives each its edge.
    """
    if radius % 2:
        raise ValueError("the radius is met in the middle: it must be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius // 2)])
    around = lambda c: F.explode(F.transform(masks, lambda m: c.bitwiseXOR(m)))
    keys = nodes.groupBy("key").agg(F.min("node").alias("rep"))
    same = nodes.join(keys, "key").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    variants = keys.select("rep", around(F.col("key")).alias("v")).repartition("v")
    hit = variants.groupBy("v").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n")).where("a < b")
    crowded = hit.where("n > 2").select("v", "a").repartition("v")  # an own stage, so that its size is known
    others = variants.join(crowded, "v").where("a <> rep").select("a", F.col("rep").alias("b"))
    return same.unionByName(others).unionByName(hit.select("a", "b")).distinct()


def near_groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; component_id is the smallest doc_id
    reachable over links of at most ``radius`` bits.

    Copies collapse to one fingerprint before anything is linked, so a group of copies of any size costs
    one node. Null or empty text: fingerprint zero, linked like any other. Null doc_id: a row like
    others, never a component_id unless its component has no other. Repeated rows come out repeated. Empty
    table: no rows. Only doc_id and text are read, so other columns may have any name.
    """
    prints = stage_table(fingerprints(docs, words), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    met = links(classes.select(F.col("fp").alias("node"), F.col("fp").alias("key")), radius)
    linked = components(met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    labels = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = labels.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def links_of_classes(classes: DataFrame, radius: int) -> DataFrame:
    """Star edges (a, b), a < b, staged, between the ``th`` of ``classes`` (th, fp) whose fingerprints differ in at most
    ``radius`` bits: texts of one fingerprint are linked to the least of them, which alone is met by balls."""
    prints = stage_table(classes.groupBy("fp").agg(F.min("th").alias("rep")), "prints")
    same = classes.select("fp", "th").join(prints, "fp").where("th <> rep").select(F.col("rep").alias("a"), F.col("th").alias("b"))
    return stage_table(same.unionByName(links(prints.select(F.col("rep").alias("node"), F.col("fp").alias("key")), radius)), "balls")


#: Shingles seen in several of about SAMPLE texts, HOT at most, come last in the order of shingles.
SAMPLE, HOT, HOT_FROM = 4096, 16_384, 4
#: Against rounding: thresholds are fractions of set sizes.
EPS = 1e-9
#: Longs of the short parity bitmap of a set, and bits a member of the long one.
PARITY, WIDE = 8, 2


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes, sorted; a text without words has the one shingle 0."""
    x = np.unique(shingle_hashes(text, words))
    return x if len(x) else np.zeros(1, np.uint64)


def frequent_shingles(texts: DataFrame, words: int) -> list[int]:
    """The most frequent shingles in a sample of the distinct ``texts`` (th, text), most frequent last."""
    n = max(texts.count(), 1)
    part = texts.where(F.pmod(F.xxhash64("th"), F.lit(1 << 20)) < min(1 << 20, (SAMPLE << 20) // n + 1)).dropDuplicates(["th"])

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for t in b["text"]:
                yield {"s": shingle_set(t, words).view(np.int64)}

    counts = map_rows(part, read, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_FROM)
    return [r.s for r in counts.orderBy(F.desc("n"), "s").limit(HOT).collect()][::-1]


def prefix(x: np.ndarray, hot: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n shingles ``x`` (sorted) in one order for all texts: by hash, those
    in ``hot`` (sorted) after all others, by ``rank``."""
    if len(hot):
        at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
        hit = hot[at] == x
        x = np.concatenate((x[~hit], x[hit][np.argsort(rank[at[hit]])]))
    return x[: len(x) - math.ceil(similarity * len(x) - EPS) + 1]


def parity(x: np.ndarray) -> np.ndarray:
    """A bitmap of a set, as longs, WIDE bits a member and at least PARITY longs: each member flips the bit that its hash
    names. Two sets' bitmaps differ in at most as many bits as the sets differ in members, so they bound the sets'
    overlap from above."""
    longs = max(PARITY, 1 << (max(len(x) * WIDE // 64, 1) - 1).bit_length())
    bits = np.bincount((x % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(">u8").astype(np.uint64)


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """The bitmap that the same set has in fewer longs (both a power of two)."""
    return np.bitwise_xor.reduce(bits.reshape(-1, longs), axis=0)


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two bitmaps differ, in the length of the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, n) ^ folded(b, n)).sum())


def may_reach(similarity: float, a: str, b: str) -> Column:
    """Whether sizes and bitmaps (``n_…``, ``bits_…``) let two sets reach ``similarity``: neither is too small for the
    other, and |x| + |y| less the bits that differ is at least twice the overlap that they need."""
    n_a, n_b = F.col(f"n_{a}"), F.col(f"n_{b}")
    differ = reduce(add, [F.bit_count(F.get(f"bits_{a}", F.lit(k)).bitwiseXOR(F.get(f"bits_{b}", F.lit(k)))) for k in range(PARITY)])
    sized = F.least(n_a, n_b) >= F.greatest(n_a, n_b) * similarity - EPS
    return sized & ((n_a + n_b - differ) / 2 >= (n_a + n_b) * (similarity / (1 + similarity)) - EPS)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = None, print_words: int = 3) -> DataFrame:
    """(th, doc_id, component_id, keep) for each distinct (text, doc_id) of ``docs``: th the text's XXH64,
    component_id the smallest doc_id of its group, keep true for one doc_id and text a group.

    Groups are the connected components of all pairs of texts whose sets of ``words``-word shingles have a
    Jaccard similarity of at least ``similarity``; none is missed. With a ``radius``, all pairs whose SimHash
    fingerprints of ``print_words``-word shingles differ in at most so many bits are links as well: they are met by
    ball hashing, as in ``near_groups``, before anything else, so a group holds whole components of that. A pair
    that is similar but has more bits apart is met by its shingles: it shares a shingle among the
    first n - ceil(similarity * n) + 1 of each set in any one order (prefix filter), so texts meet in buckets
    by those shingles, frequent ones last. Sizes, bitmaps and the place of the shingle in both sets bound a
    pair's overlap; what can reach the threshold is verified on the whole sets.

    Buckets are settled in three rounds: each member is paired with the least, then with the member that has
    most verified links; then members of different components of a bucket are compared by their bounds inside the
    join, and only pairs that no bound rules out come out of it. So families cost a link a member, and still every
    pair that meets is verified, ruled out by a bound, or joined through verified pairs. Equal texts are one node.
    Null and empty texts are equal; all texts without words are alike. Null doc_id: the largest. Repeated rows: one.
    Empty table: no rows. Of the columns only doc_id and text are read, so others may have any name.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    order = np.array(frequent_shingles(rows.select("th", "text"), words), np.int64).view(np.uint64)
    rank = np.argsort(order)
    hot = order[rank]

    def prefixes(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b["text"]]
            wide = [parity(x) for x in sets]
            prints = [0 if radius is None else fingerprint(shingle_hashes(t, print_words)) for t in b["text"]]
            yield {"th": b["th"], "doc_id": b["doc_id"], "fp": prints, "n": [len(x) for x in sets], "bits": [folded(p, PARITY).view(np.int64) for p in wide], "wide": [p.tobytes() for p in wide], "first": [prefix(x, hot, rank, similarity).view(np.int64) for x in sets]}

    found = stage_table(map_rows(rows, prefixes, "th long, doc_id long, fp long, n long, bits array<long>, wide binary, first array<long>"), "prefixes")
    classes = stage_table(found.groupBy("th").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "n", "bits", "wide", "first")]), "classes")
    tried = links_ = docs.sparkSession.createDataFrame([], "a long, b long") if radius is None else links_of_classes(classes, radius)
    shared = classes.select("th", F.posexplode("first").alias("at", "s")).repartition("s")
    least = shared.groupBy("s").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("s", "a")
    shared = stage_table(shared.join(least, "s").select("s", "th", "at", "a"), "shared")

    def sized(n: str, *which: str) -> DataFrame:
        return classes.select(F.col("th").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("n", *which)])

    def verified(met: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs of ``met`` (a, b) that are verified now, and those that hold."""
        pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(sized("a", "bits"), "a").join(sized("b", "bits"), "b").where(may_reach(similarity, "a", "b")).select("a", "b")
        pairs = map_rows(pairs.join(sized("a", "wide"), "a").join(sized("b", "wide"), "b"), closer, "a long, b long")
        pairs = stage_table(pairs.join(before, ["a", "b"], "left_anti"), "pairs")
        asked = stage_table(pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct().join(classes.select("th", "doc_id"), "th"), "asked")
        texts = rows.join(asked, ["th", "doc_id"])
        shingles = stage_table(map_rows(texts.select("th", "text"), sets, "th long, set binary").dropDuplicates(["th"]), "sets")
        both = pairs.join(shingles.select(F.col("th").alias("a"), F.col("set").alias("x")), "a").join(shingles.select(F.col("th").alias("b"), F.col("set").alias("y")), "b")
        return pairs, stage_table(map_rows(both, verify, "a long, b long"), "links")

    def closer(batches: Iterator[dict]) -> Iterator[dict]:
        """The pairs that their long bitmaps let reach the similarity."""
        for b in batches:
            n = np.array(b["n_a"], float) + np.array(b["n_b"], float)
            far = np.array([apart(x, y) for x, y in zip(b["wide_a"], b["wide_b"], strict=True)], float)
            near = (n - far) / 2 >= n * (similarity / (1 + similarity)) - EPS
            yield {k: np.array(b[k], np.int64)[near] for k in ("a", "b")}

    def sets(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"th": b["th"], "set": [shingle_set(t, words).tobytes() for t in b["text"]]}

    def verify(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {"a": [], "b": []}
            for u, v, x, y in zip(b["a"], b["b"], b["x"], b["y"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                if same >= similarity * (len(x) + len(y) - same) - EPS:
                    out["a"].append(u)
                    out["b"].append(v)
            yield out

    def rooted(linked: DataFrame) -> DataFrame:
        return shared.select("s", "th", "at").join(linked, F.col("th") == F.col("node"), "left").select("s", "th", "at", F.coalesce("root", "th").alias("root"))

    first, more = verified(shared.where("a <> th").select("a", F.col("th").alias("b")), tried)
    tried, links_ = tried.unionByName(first), links_.unionByName(more)
    degrees = links_.select(F.explode(F.array("a", "b")).alias("th")).groupBy("th").agg(F.count("*").alias("links"))
    open_ = rooted(components(links_)).join(degrees, "th", "left").select("s", "th", "root", F.coalesce("links", F.lit(0)).alias("links"))
    lead = open_.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("links", "th", "root")).alias("lead")).where("low < high").select("s", "lead")
    again, more = verified(open_.join(lead, "s").where("root <> lead.root").select(F.col("lead.th").alias("a"), F.col("th").alias("b")), tried)
    tried, links_ = tried.unionByName(again), links_.unionByName(more)

    open_ = rooted(components(links_))
    left = open_.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s")
    open_ = stage_table(open_.join(left, "s"), "open")
    # A pair's first common shingle leaves no more than the rest of either set; every true pair passes there.
    side = lambda n: open_.select("s", F.col("th").alias(n), F.col("root").alias(f"root_{n}"), F.col("at").alias(f"at_{n}")).join(sized(n, "bits"), n)
    rest = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= (F.col("n_a") + F.col("n_b")) * (similarity / (1 + similarity)) - EPS
    x, y = stage_table(side("a"), "sides"), side("b")
    met = x.join(y, (x["s"] == y["s"]) & (F.col("root_a") < F.col("root_b")) & rest & may_reach(similarity, "a", "b"))
    links_ = links_.unionByName(verified(met.select("a", "b"), tried)[1])

    linked = components(links_)
    labels = classes.join(linked, classes["th"] == linked["node"], "left").select("th", F.col("doc_id").alias("first"), F.coalesce("root", "th").alias("root"))
    best = labels.groupBy("root").agg(F.min(F.struct("first", "th")).alias("best"))
    labels = labels.join(best, "root").select("th", "best")
    out = found.select("th", "doc_id").distinct().join(labels, "th")
    return out.select("th", "doc_id", F.col("best.first").alias("component_id"), ((F.col("doc_id") == F.col("best.first")) & (F.col("th") == F.col("best.th"))).alias("keep"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns as they were, of which one of each near-duplicate group stays: that with
    the smallest doc_id; of repeated rows one."""
    keep = near_duplicates(docs, words, similarity, radius).where("keep").select(F.col("th").alias("_th"), F.col("doc_id").alias("_id"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    rows = rows.withColumn("_th", F.xxhash64(F.coalesce("_row.text", F.lit("")))).withColumn("_id", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit((1 << 63) - 1)))
    kept = rows.join(keep, ["_th", "_id"]).withColumn("_nth", F.row_number().over(W.partitionBy("_th", "_id").orderBy(F.lit(0))))
    return kept.where("_nth = 1").select("_row.*")
