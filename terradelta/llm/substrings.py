"""Repeated word windows by prefix-partitioned suffix trees.

A window of 35 words that occurs twice has, at both places, the same least 8-word prefix hash among the 28 prefixes
in it. So the suffixes (window starts) fall into groups by that prefix, and equal windows always share a group.
Groups whose prefix occurs once hold no repeat and end there. A group of up to GROUP_BYTES becomes one suffix
subtree in one task's memory; in a larger one each suffix goes on under its own first 16, then 24, then 32 words,
until its group fits; suffixes whose first 35 words are equal are below one deep node, and are counted.

What is equal is taken apart once: of equal texts one goes on, of equal spans one is grown into the tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stage_table

WINDOW = 35
PREFIX = 8
#: Words to which the prefix of a group grows that is too large.
LONGER = (16, 24, 32)
#: Most bytes of text in one subtree.
GROUP_BYTES = 1 << 20
#: Words that a task grows into trees at once, and spans that it remembers as seen.
BATCH_WORDS, SEEN = 1 << 19, 200_000
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b >> np.uint64(31))) * MIX_A + b * MIX_B
    x ^= x >> np.uint64(29)
    return x * MIX_B ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), np.uint64, len(words))


def window_prefixes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each 8-word prefix, and for each window the least of those that lie in it."""
    g = word_hashes(words)
    for k in (1, 2, 4):
        g = _mix(g[:-k], g[k:])
    least = g
    for k in (1, 2, 4, 8):
        least = np.minimum(least[:-k], least[k:])
    far = WINDOW - PREFIX + 1 - 16
    return g, np.minimum(least[:-far], least[far:])


def prefix_runs(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one prefix: prefix, first window, number of windows, places of the prefix."""
    words = (text or b"").split()
    if len(words) < WINDOW:
        return (np.empty(0, np.int64),) * 4
    g, least = window_prefixes(words)
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    many = np.diff(np.append(start, len(least)))
    prefix = least[start]
    places = np.ones(len(start), np.int64)
    values, counts = np.unique(g, return_counts=True)
    if len(values) < len(g):
        for r in np.flatnonzero(np.isin(prefix, values[counts > 1])).tolist():
            places[r] = np.count_nonzero(g[start[r] : start[r] + many[r] + WINDOW - PREFIX] == prefix[r])
    return prefix.view(np.int64), start, many, places


def suffix_tree(words: np.ndarray, ends: np.ndarray, group: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix trees of all groups, as arrays: the ``live`` positions in order of (group, suffix), and for each the
    depth in words of the internal node that joins it to the one before (0 across groups). A suffix of position p is
    words[p:ends[p]]. Suffixes are ranked by their first 1, 2, 4 … words; the ranks kept tell depths."""
    n = len(words)
    left = ends - np.arange(n)
    ranks = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
    k, longest = 1, int(left.max(initial=0))
    while k < longest and ranks[-1].max() < n - 1:
        r = ranks[-1]
        after = np.where(left > k, r[np.minimum(np.arange(n) + k, n - 1)], -1)
        ranks.append(np.unique(r * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64))
        k *= 2
    starts = np.flatnonzero(live)
    order = starts[np.lexsort((ranks[-1][starts], group[starts]))]
    depth = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        d = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            ok = np.flatnonzero((d < left[a]) & (d < left[b]))
            same = ok[ranks[level][a[ok] + d[ok]] == ranks[level][b[ok] + d[ok]]]
            d[same] += 1 << level
        depth[1:] = np.where(group[a] == group[b], np.minimum(d, np.minimum(left[a], left[b])), 0)
    return order, depth


def deep_nodes(depth: np.ndarray, least: int = WINDOW) -> list[tuple[int, int, int]]:
    """The tree's internal nodes of depth ``least`` or more, as (depth, first, last) in the order of suffixes: the
    words on the way to each are a repeat that can't be extended to the right."""
    nodes, stack = [], []
    for at in range(1, len(depth) + 1):
        d, first = (int(depth[at]) if at < len(depth) else 0), at - 1
        while stack and stack[-1][0] > d:
            level, first = stack.pop()
            nodes.append((level, first, at - 1))
        if d >= least and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return nodes


def repeated_stretches(spans: list[list[tuple[bytes, int]]]) -> list[list[tuple[int, int]]]:
    """For groups of spans (text; its first so many suffixes count): of each span, group after group, the stretches
    (first word, end) below internal nodes at least WINDOW deep. Overlapping repeats come as one stretch."""
    flat = [s for group in spans for s in group]
    words = [text.split() for text, _ in flat]
    size = np.array([len(w) for w in words])
    ends = np.cumsum(size + 1) - 1  # a place between spans keeps their stretches apart
    begins = ends - size
    n = int(ends[-1]) + 1
    codes = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    inside[ends] = False
    codes[inside] = word_hashes([w for ws in words for w in ws])
    span = np.repeat(np.arange(len(flat)), size + 1)
    live = np.arange(n) - begins[span] < np.array([m for _, m in flat])[span]
    group = np.repeat(np.arange(len(spans)), [len(g) for g in spans])[span]
    order, depth = suffix_tree(codes, ends[span], group, live & inside)
    deepest = np.maximum(depth, np.append(depth[1:], 0))  # each suffix hangs from its deepest internal node
    deep = deepest >= WINDOW
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, order[deep], 1)
    np.add.at(cover, order[deep] + deepest[deep], -1)
    on = np.concatenate(([False], np.cumsum(cover[:-1]) > 0))
    turns = np.flatnonzero(on[1:] != on[:-1])
    if len(turns) % 2:
        turns = np.append(turns, n)
    out: list[list[tuple[int, int]]] = [[] for _ in flat]
    for a, z in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        k = int(span[a])
        out[k].append((a - int(begins[k]), z - int(begins[k])))
    return out


def grow(batches: Iterator[dict]) -> Iterator[dict]:
    """Subtrees of rows (key, sid, base, windows, span) in order of key: (sid, a, b), the repeated stretches of spans."""
    groups: list[list[tuple]] = []
    held = 0

    def flush() -> dict:
        nonlocal groups, held
        lively = [g for g in groups if len(g) > 1 or g[0][5]]
        out: dict[str, list] = {"sid": [], "a": [], "b": []}
        if lively:
            found = iter(repeated_stretches([[(row[4], row[3]) for row in g] for g in lively]))
            for row in (row for g in lively for row in g):
                for a, b in next(found):
                    for k, v in zip(out, (row[1], row[2] + a, row[2] + b), strict=True):
                        out[k].append(v)
        groups, held = [], 0
        return out

    last, seen = None, set()
    for b in batches:
        for row in zip(*(b[k] for k in ("key", "sid", "base", "windows", "span", "loops")), strict=True):
            if row[0] != last or not groups:
                if held >= BATCH_WORDS:
                    yield flush()
                if row[0] != last:
                    last, seen = row[0], set()
                groups.append([])
            if (row[1], row[2]) not in seen:  # another task may have met the span, too
                seen.add((row[1], row[2]))
                groups[-1].append(row)
                held += row[4].count(b" ") + 1
    groups = [g for g in groups if g]
    if groups:
        yield flush()


def repeats(rows: DataFrame) -> DataFrame:
    """(id, th, cuts) for texts of ``rows`` (id, th, text, …) that lose words: cuts are stretches (a, b) of words."""

    def runs_of(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            found = [prefix_runs(t) for t in b["text"]]
            yield {"id": b["id"], "th": b["th"]} | {k: [f[j] for f in found] for j, k in enumerate(("prefix", "start", "windows", "places"))}

    runs = map_rows(rows.select("id", "th", "text"), runs_of, "id long, th binary, prefix array<long>, start array<int>, windows array<int>, places array<int>")
    runs = stage_table(runs, "runs")
    copies = stage_table(runs.groupBy("th").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1").select("th", "rep"), "copies")
    ones = runs.join(copies, "th", "left").where("rep IS NULL OR id = rep")
    ones = ones.select("id", "th", F.explode(F.arrays_zip("prefix", "start", "windows", "places")).alias("r")).select("id", "th", "r.*")
    again = ones.groupBy("prefix").agg(F.sum("places").alias("n")).where("n > 1").select("prefix")
    own = ones.join(again, "prefix").groupBy("id", "th").agg(F.collect_set(F.struct("prefix", "start", "windows", "places")).alias("runs"))

    def cut(batches: Iterator[dict]) -> Iterator[dict]:
        """Places of spans (sid, id, th, start), and each different span, with how often this task met it."""
        seen: dict[bytes, list] = {}

        def told() -> dict:
            out = {"sid": list(seen), "prefix": [s[0] for s in seen.values()], "windows": [s[1] for s in seen.values()], "loops": [s[2] for s in seen.values()], "span": [s[3] for s in seen.values()], "n": [s[4] for s in seen.values()]}
            seen.clear()
            return out | dict.fromkeys(("id", "th", "start"), [None] * len(out["sid"]))

        for b in batches:
            out: dict[str, list] = {k: [] for k in ("sid", "id", "th", "start")}
            for i, th, text, runs in zip(b["id"], b["th"], b["text"], b["runs"], strict=True):
                words = text.split()
                for r in runs:
                    a, n = r["start"], r["windows"]
                    span = b" ".join(words[a : a + n + WINDOW - 1])
                    sid = xxhash.xxh3_128_digest(span)
                    kept = seen.setdefault(sid, [r["prefix"], n, r["places"] > 1, span, 0])
                    kept[4] += 1
                    for k, v in zip(out, (sid, i, th, a), strict=True):
                        out[k].append(v)
            yield out | dict.fromkeys(("prefix", "windows", "loops", "span", "n"), [None] * len(out["sid"]))
            if len(seen) > SEEN:
                yield told()
        yield told()

    met = rows.join(own, ["id", "th"]).select("id", "th", "doc_id", "text", "runs")
    spans = stage_table(map_rows(met, cut, "sid binary, id long, th binary, start int, prefix long, windows int, loops boolean, span binary, n long"), "spans")
    kinds = spans.where("span IS NOT NULL").select("sid", F.col("prefix").alias("key"), F.lit(0).alias("base"), "windows", "span", "loops", "n")
    whole = kinds.groupBy("sid", "key", "windows").agg(F.sum("n").alias("n"), F.max(F.octet_length("span")).alias("bytes"))
    large = stage_table(whole.groupBy("key").agg(F.sum("bytes").alias("bytes")).where(F.col("bytes") > GROUP_BYTES).select("key"), "large")

    def trees(of: DataFrame) -> DataFrame:
        return map_rows(of.select("key", "sid", "base", "windows", "span", "loops").repartition("key").sortWithinPartitions("key"), grow, "sid binary, a int, b int")

    deep = trees(kinds.join(large, "key", "left_anti"))
    deep = deep.unionByName(whole.where("n > 1").select("sid", F.lit(0).alias("a"), (F.col("windows") + WINDOW - 1).alias("b")))
    deep = stage_table(deep, "deep").unionByName(long_groups(kinds.join(large, "key", "left_semi"), trees))

    places = spans.where("id IS NOT NULL").select("sid", "id", "th", "start")
    cuts = places.join(stage_table(deep.distinct(), "stretches"), "sid")
    cuts = cuts.select("id", "th", F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b")).alias("cut"))
    all_words = F.struct(F.lit(0).alias("a"), F.lit((1 << 31) - 1).alias("b"))
    copied = runs.join(copies, "th").where(F.size("prefix") > 0).select("id", "th", all_words.alias("cut"))  # each copy repeats the others whole
    return cuts.unionByName(copied).groupBy("id", "th").agg(F.collect_set("cut").alias("cuts"))


def long_groups(kinds: DataFrame, trees) -> DataFrame:
    """(sid, a, b) of the spans in groups beyond GROUP_BYTES: each suffix by itself, under ever longer prefixes."""

    def suffixes(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("sid", "base", "span")}
            for sid, n, span in zip(b["sid"], b["windows"], b["span"], strict=True):
                words = span.split()
                for w in range(n):
                    for k, v in zip(out, (sid, w, b" ".join(words[w : w + WINDOW])), strict=True):
                        out[k].append(v)
            yield out

    rest = map_rows(kinds.select("sid", "windows", "span"), suffixes, "sid binary, base int, span binary").dropDuplicates(["sid", "base"])
    rest = stage_table(rest, "suffixes")
    deep = rest.select("sid", F.col("base").alias("a"), F.col("base").alias("b")).limit(0)
    if rest.isEmpty():
        return deep
    for length in LONGER:
        keyed = rest.withColumn("key", F.xxhash64(F.substring_index(F.col("span").cast("string"), " ", length)))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("span")).alias("bytes")).where("n > 1")
        sizes = stage_table(sizes.select("key", (F.col("bytes") > GROUP_BYTES).alias("large")), "sizes")
        held = keyed.join(sizes, "key")
        fit = held.where("NOT large").select("key", "sid", "base", F.lit(1).alias("windows"), "span", F.lit(False).alias("loops"))
        deep = deep.unionByName(stage_table(trees(fit), "deep"))
        rest = stage_table(held.where("large").select("sid", "base", "span"), "suffixes")
        if rest.isEmpty():
            return deep
    same = stage_table(rest.groupBy("span").agg(F.count("*").alias("n")).where("n > 1").select("span"), "equal")
    return deep.unionByName(rest.join(same, "span").select("sid", F.col("base").alias("a"), (F.col("base") + WINDOW).alias("b")))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) for every row of ``docs``: each word covered by a 35-word window
    whose words also start anywhere else, in the same text too, is removed, judged on the input. ``kept_text`` is
    the words left, joined by one space; ``removed`` the stretches (a, b) of words that go, in order.

    Null, empty and shorter texts lose nothing (kept_text of no words is empty). Equal texts and repeated rows repeat
    each other whole: all their words go, if there are 35, and one of them stands for all in the search. Null doc_id:
    a row like others. Empty table: no rows. Of the columns only doc_id and text are read, so others may have any name.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.unhex(F.md5(text)).alias("th"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.cast("binary").alias("text"),
    )

    def keep(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept_text", "removed")}
            for doc_id, text, cuts in zip(b["doc_id"], b["text"], b["cuts"], strict=True):
                words, kept, gone, at = text.split(), [], [], 0
                for a, z in sorted((c["a"], min(c["b"], len(words))) for c in cuts or ()):
                    if z <= at:
                        continue
                    kept += words[at:a]
                    if gone and a <= gone[-1]["b"]:
                        gone[-1]["b"] = z
                    else:
                        gone.append({"a": a, "b": z})
                    at = z
                kept += words[at:]
                for k, v in zip(out, (doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode(), gone), strict=True):
                    out[k].append(v)
            yield out

    # All columns of rows in both joins, so that the two shuffles of the texts are one and the same.
    joined = rows.join(repeats(rows), ["id", "th"], "left").select("id", "th", "doc_id", "text", "cuts")
    return map_rows(joined, keep, "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<a: long, b: long>>")
