"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_rows, small_batches, stage_table

#: Words that a repeated run of lines must have: the guarantee of the winnowing.
RUN_WORDS = 10
#: Lines of one part of a document, within which matches are extended.
PART = 64


def line_hashes(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Of each line with a word: its number, its hash (signed) and its number of words."""
    at, hashes, words = [], [], []
    for n, line in enumerate((text or "").encode().split(b"\n")):
        if w := len(line.split()):
            h = xxhash.xxh64_intdigest(line)
            at.append(n)
            hashes.append(h - (1 << 64) if h >> 63 else h)
            words.append(w)
    return at, hashes, words


def windows_of(hashes: list[int], words: list[int], run_words: int) -> dict[int, list[dict]]:
    """The windows of a text by their fingerprint: place of the line -> (run, first).

    Each line opens a window, the shortest run from it with at least ``run_words`` words, and closes one, the
    shortest run up to it. Every line of a repeated run with that many words lies in a window within the run:
    in the one it closes or, if that begins before the run, in the one that the run's first line opens. A window's
    fingerprint is its least line hash, the last of equals; equal windows select the same line."""
    total = [0, *accumulate(words)]
    raw = np.array(hashes, np.int64).tobytes()
    found, last, first = set(), 0, 0
    for n in range(len(hashes)):
        last = max(last, n)
        while last < len(hashes) and total[last + 1] - total[n] < run_words:
            last += 1
        if last < len(hashes):
            found.add((n, last))
        if total[n + 1] >= run_words:
            while total[n + 1] - total[first + 1] >= run_words:
                first += 1
            found.add((first, n))
    out: dict[int, list[dict]] = {}
    for a, z in sorted(found):
        least = min(range(a, z + 1), key=lambda i: (hashes[i], -i))
        h = xxhash.xxh64_intdigest(raw[8 * a : 8 * (z + 1)], seed=1)
        out.setdefault(least, []).append({"run": h - (1 << 64) if h >> 63 else h, "first": a})
    return out


def winnow(rows: DataFrame, run_words: int) -> DataFrame:
    """(id, th, n, hashes, prints): of each document its line hashes and its fingerprints, places with the windows that
    select them."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("id", "th", "n", "hashes", "prints")}
            for i, th, text in zip(b["id"], b["th"], b["text"], strict=True):
                _, hashes, words = line_hashes(text)
                prints = [{"print": hashes[at], "at": at, "windows": w} for at, w in windows_of(hashes, words, run_words).items()]
                for k, v in zip(out, (i, th, len(hashes), np.array(hashes, np.int64).tobytes(), prints), strict=True):
                    out[k].append(v)
            yield out

    return map_rows(rows.select("id", "th", "text"), run, "id long, th long, n int, hashes binary, prints array<struct<print: long, at: int, windows: array<struct<run: long, first: int>>>>")


def joined_places(found: DataFrame) -> DataFrame:
    """(id, th, part, of_id, of_th, of_part, shift, seeds): places that a fingerprint selects, joined with the first place of
    each run that selects it there. Seeds are line numbers in one part of a document whose partners are ``shift`` lines
    before them, in one part of the other (or the same) document."""
    prints = found.select("id", "th", F.explode("prints").alias("p")).select("id", "th", "p.*")
    # Fingerprints that one place selects hold no repeat.
    often = stage_table(prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print"), "often")
    met = prints.join(often, "print").select("id", "th", "at", F.explode("windows").alias("w")).select("id", "th", "at", "w.*")
    place = F.struct("id", "th", "first")
    source = met.groupBy("run").agg(F.min(place).alias("source"), F.max(place).alias("end")).where("source < end").select("run", "source")
    later = met.join(stage_table(source, "sources"), "run").where(place > F.col("source"))
    other = F.col("at") - F.col("first") + F.col("source.first")
    part = lambda c: F.floor(c / PART).cast("int")
    key = [F.col("id"), F.col("th"), part(F.col("at")).alias("part"), F.col("source.id").alias("of_id"), F.col("source.th").alias("of_th"), part(other).alias("of_part"), (F.col("at") - other).alias("shift")]
    return later.groupBy(*key).agg(F.collect_set("at").alias("seeds"))  # of one part


def parts_of(found: DataFrame, reach: int) -> DataFrame:
    """(id, th, part, start, hashes): each document's line hashes in parts of PART lines with ``reach`` more on both sides."""
    parts = found.where("n > 0").select("id", "th", "n", "hashes", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((n - 1) DIV {PART} AS INT)"))).alias("part"))
    start = F.greatest(F.col("part") * PART - reach, F.lit(0))
    own = F.expr(f"substring(hashes, 8 * start + 1, 8 * (least((part + 1) * {PART} + {reach}, n) - start))")
    cut = parts.withColumn("start", start).select("id", "th", "part", "start", own.alias("hashes"))
    return cut.groupBy("id", "th", "part").agg(F.first("start").alias("start"), F.first("hashes").alias("hashes"))  # rows of equal id and text


def extend(a: np.ndarray, a_start: int, b: np.ndarray, b_start: int, shift: int, seeds: list[int]) -> set[tuple[int, int]]:
    """The stretches (first, last) of lines of ``a`` that hold a seed and equal those of ``b`` ``shift`` lines before,
    extended both ways until lines differ or a part ends."""
    low, high = max(a_start, b_start + shift), min(a_start + len(a), b_start + shift + len(b))
    differ = np.flatnonzero(a[low - a_start : high - a_start] != b[low - shift - b_start : high - shift - b_start]) + low
    out = set()
    for seed in seeds:
        k = int(np.searchsorted(differ, seed))
        out.add((int(differ[k - 1]) + 1 if k else low, int(differ[k]) - 1 if k < len(differ) else high - 1))
    return out


def repeated_runs(rows: DataFrame, run_words: int) -> DataFrame:
    """(id, th, cuts): for each document that has any, the runs of lines (first, last) that stand earlier, too.

    A window has at most ``run_words`` lines, so a seed's windows lie within the part it is in and that many lines around
    it: extending a seed there covers all its windows, and the union over seeds all repeated runs."""
    found = stage_table(winnow(rows, run_words), "winnowed")
    pairs = stage_table(joined_places(found), "places")
    parts = parts_of(found, run_words)
    mine = parts.select("id", "th", "part", F.col("start").alias("a_start"), F.col("hashes").alias("a"))
    theirs = parts.select(F.col("id").alias("of_id"), F.col("th").alias("of_th"), F.col("part").alias("of_part"), F.col("start").alias("b_start"), F.col("hashes").alias("b"))
    both = pairs.join(mine, ["id", "th", "part"]).join(theirs, ["of_id", "of_th", "of_part"])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "th", "first", "last")}
            for i, th, shift, seeds, a_start, a, b_start, b in zip(*(batch[k] for k in ("id", "th", "shift", "seeds", "a_start", "a", "b_start", "b")), strict=True):
                for stretch in extend(np.frombuffer(a, np.int64), a_start, np.frombuffer(b, np.int64), b_start, shift, seeds):
                    for k, v in zip(out, (i, th, *stretch), strict=True):
                        out[k].append(v)
            yield out

    cuts = map_rows(both.select("id", "th", "shift", "seeds", "a_start", "a", "b_start", "b"), run, "id long, th long, first int, last int")
    return cuts.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("cuts"))


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(row, kept_text, n_lines, n_removed) for every row of ``docs`` (row: all its columns, as a struct): later
    copies of repeated runs of lines go.

    A run is consecutive lines with a word; it counts from ``run_words`` words on, and shorter ones stay. A line goes
    if it lies in such a run whose lines also stand at an earlier place (by doc_id, then line; in the same text,
    too, even if they overlap). Windows of lines select fingerprints; places of a fingerprint are joined with the
    first place of each distinct run there, and extended both ways (see repeated_runs), so a run goes as far as any
    earlier place agrees, not only that of its first lines. n_lines counts lines
    with a word; blank lines stay and don't break runs. Lines are equal if their bytes are.

    Null text: comes back null, no lines. Empty text: no lines. Null doc_id: comes last. Rows that share a doc_id: in
    order of their texts' hash. Repeated rows: one stays, the others lose every line if they have ``run_words``
    words. Empty table: no rows. Columns of any name are kept inside ``row``. A text costs two windows a line at most,
    whatever repeats in it. First places are found map-side; a line on a third of all documents is an ordinary
    skewed equi-join, against one row. What a match brings of its partner is one part of at most 84 line hashes.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("th"),
        F.struct(*docs.columns).alias("row"),
        F.col("text"),
    )
    schema = StructType([rows.schema["row"], *(StructField(n, t) for n, t in (("kept_text", StringType()), ("n_lines", LongType()), ("n_removed", LongType())))])
    cuts = repeated_runs(rows, run_words)
    joined = rows.join(cuts, ["id", "th"], "left")
    joined = joined.withColumn("nth", F.row_number().over(W.partitionBy("id", "th").orderBy(F.lit(0))))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept_text, n_lines, n_removed = [], [], []
            for text, cuts, nth in zip(*(b.column(c).to_pylist() for c in ("text", "cuts", "nth")), strict=True):
                at, _, words = line_hashes(text)
                if nth > 1 and sum(words) >= run_words:
                    gone = set(at)
                else:
                    gone = {at[n] for c in cuts or () for n in range(c["first"], c["last"] + 1)}
                kept_text.append(text if not gone else "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone))
                n_lines.append(len(at))
                n_removed.append(len(gone))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(kept_text, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], names=["row", "kept_text", "n_lines", "n_removed"])

    small_batches(docs.sparkSession)
    return joined.select("row", "text", "cuts", "nth").mapInArrow(keep, schema)


def without_repeats(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from ``text`` and n_chars, if there, counted anew."""
    out = dedup_lines(docs, run_words)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
