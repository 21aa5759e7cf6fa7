"""Phrase collocations by stripes: each prefix keys a counter of next words, merged elementwise."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_rows, stage_table

#: Bits of the filter that tells phrases which can't be frequent before they are shuffled: fixed, whatever the corpus.
#: Where it fills up it tells less and more is shuffled; counts stay exact.
FILTER_BITS = 1 << 26
#: Bytes of text that become one row of numbers, and are counted at a time.
CHARS = 8 << 20
#: Stripes that leave a task at a time.
ROWS = 8192
#: A prefix on more than one in HOT words has its stripe cut into PARTS by next word; that of no words into FIRST.
HOT, PARTS, FIRST = 2000, 64, 4096
#: Parts of a language that are ranked by themselves first.
RANKED = 64

#: A-Z become a-z, places where pieces end become line feeds, tabs spaces.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
NUMBERS = "langs array<binary>, lang binary, words binary, ids binary"
#: ``next``: words, joined by spaces.
STRIPES = "lang string, prefix string, part int, next string, n array<int>"


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes, in order."""
    h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB) ^ (a >> np.uint64(29))


@dataclass
class Words:
    """Texts as numbers: one for each word of a language, -1 where a piece ends."""

    langs: list[bytes]
    lang: np.ndarray
    words: list[bytes]
    ids: np.ndarray

    def hashes(self) -> np.ndarray:
        seeds = [xxhash.xxh32_intdigest(x) for x in self.langs]
        return np.fromiter((xxhash.xxh64_intdigest(w, seeds[n]) for n, w in zip(self.lang.tolist(), self.words, strict=True)), np.uint64, len(self.words))


def numbered(texts: dict[bytes, list[bytes]]) -> Words:
    """The texts of each language, their words numbered."""
    out = Words([], np.empty(0, np.int32), [], np.empty(0, np.int32))
    lang, ids = [], []
    for x, pieces in texts.items():
        parts = pc.split_pattern(pa.array(pieces, pa.large_binary()), pattern=b" ").flatten().dictionary_encode()
        known, at = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        real = np.array([w not in (b"", b"\n") for w in known], bool)
        to = np.where(real, len(out.words) + np.cumsum(real) - 1, [-1 if w else -2 for w in known]).astype(np.int32)
        at = to[at]
        ids.append(at[at != -2])
        out.words += [w for w, r in zip(known, real.tolist(), strict=True) if r]
        lang.append(np.full(int(real.sum()), len(out.langs), np.int32))
        out.langs.append(x)
    out.lang, out.ids = np.concatenate(lang), np.concatenate(ids)
    return out


def number_words(docs: DataFrame) -> DataFrame:
    """NUMBERS: rows of about CHARS bytes of text, in which words are numbers. Texts are cut into words this once."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        held: dict[bytes, list[bytes]] = {}
        size = 0

        def flush() -> dict:
            w = numbered(held)
            return {"langs": [w.langs], "lang": [w.lang.tobytes()], "words": [b" ".join(w.words)], "ids": [w.ids.tobytes()]}

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                held.setdefault(lang, []).append(text.translate(_TABLE).replace(b"\n", b" \n ") + b" \n ")
                size += len(text)
                if size >= CHARS:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return map_rows(docs, run, NUMBERS)


class Grown:
    """Phrases of one word more than there are filters, of which every part passes these. ``at`` has the number of the
    phrase that begins at each place, or -1; a phrase is a shorter one (``left``) and a last word (``last``)."""

    def __init__(self, held: Words, filters: list[bytes]):
        self.words = held.words
        at = held.ids
        firsts = hashes = held.hashes()
        self.left: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        for bits in filters:
            place = hashes % np.uint64(FILTER_BITS)
            byte = np.frombuffer(bits, np.uint8)[(place >> np.uint64(3)).astype(np.int64)]
            passed = (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
            at = np.where((at >= 0) & passed[at], at, -1) if len(passed) else at
            # A phrase and the one that begins a word later make one that is longer by a word.
            both = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            keys, inverse = np.unique(at[both].astype(np.int64) << 32 | at[both + 1], return_inverse=True)
            left, right = keys >> 32, keys & 0xFFFFFFFF
            last = self.last[-1][right] if self.last else right
            hashes = mix(hashes[left], firsts[last])
            at = np.full(len(at), -1, np.int32)
            at[both] = inverse
            self.left.append(left)
            self.last.append(last)
        self.at = at

    def text(self, level: int, n: int) -> bytes:
        """Phrase ``n`` of ``level`` + 1 words."""
        return self.words[n] if not level else self.text(level - 1, int(self.left[level - 1][n])) + b" " + self.words[self.last[level - 1][n]]

    def word(self, level: int, n: int) -> int:
        """Its first word."""
        while level:
            level, n = level - 1, int(self.left[level - 1][n])
        return n


def stripes(numbers: DataFrame, filters: list[bytes], hot: set[tuple[bytes, bytes]]) -> DataFrame:
    """STRIPES of prefixes as long as there are ``filters``: the words that follow a prefix and how often, as far as one
    task saw them. The stripe of no words counts single words; its empty word is the number of all."""
    given = numbers.sparkSession.sparkContext.broadcast((filters, hot))

    def first(held: Words) -> Iterator[tuple]:
        n = np.bincount(held.ids[held.ids >= 0], minlength=len(held.words))
        part = np.fromiter((xxhash.xxh32_intdigest(w) % FIRST for w in held.words), np.int64, len(held.words))
        order = np.lexsort((part, held.lang))
        key = held.lang[order].astype(np.int64) * FIRST + part[order]
        cuts = [*np.flatnonzero(np.diff(key, prepend=-1)).tolist(), len(key)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            at = order[x:y]
            yield held.langs[int(key[x]) // FIRST], b"", int(key[x]) % FIRST, b" ".join([held.words[w] for w in at.tolist()]), n[at].tolist()
        for k, lang in enumerate(held.langs):
            yield lang, b"", -1, b"", [int(n[held.lang == k].sum())]

    def grown(held: Words, filters: list[bytes], hot: set[tuple[bytes, bytes]]) -> Iterator[tuple]:
        g, level = Grown(held, filters), len(filters) - 1
        left, last, n = g.left[-1], g.last[-1], np.bincount(g.at[g.at >= 0], minlength=len(g.left[-1]))
        cuts = [*np.flatnonzero(np.diff(left, prepend=-1)).tolist(), len(left)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            prefix = g.text(level, int(left[x]))
            lang = held.langs[held.lang[g.word(level, int(left[x]))]]
            words, counts = [held.words[w] for w in last[x:y].tolist()], n[x:y].tolist()
            if (lang, prefix) not in hot:
                yield lang, prefix, 0, b" ".join(words), counts
                continue
            parts: dict[int, tuple[list, list]] = {}
            for w, k in zip(words, counts, strict=True):
                at = parts.setdefault(xxhash.xxh32_intdigest(w) % PARTS, ([], []))
                at[0].append(w)
                at[1].append(k)
            for part, (w, k) in parts.items():
                yield lang, prefix, part, b" ".join(w), k

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        filters, hot = given.value
        names = [c.split(" ")[0] for c in STRIPES.split(", ")]
        for batch in batches:
            for langs, lang, words, ids in zip(*batch.values(), strict=True):
                words = words.split(b" ") if words else []
                held = Words(langs, np.frombuffer(lang, np.int32), words, np.frombuffer(ids, np.int32))
                made = grown(held, filters, hot) if filters else first(held)
                while some := list(islice(made, ROWS)):
                    yield dict(zip(names, map(list, zip(*some, strict=True)), strict=True))

    return map_rows(numbers, run, STRIPES)


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, prefix, next, f) of stripes merged elementwise, as far as f reaches ``least``, and the numbers of all words."""
    entry = F.explode(F.arrays_zip(F.split("next", " ").alias("next"), "n")).alias("e")
    rows = stripes.repartition("lang", "prefix", "part").select("lang", "prefix", "part", entry).select("lang", "prefix", "part", "e.next", "e.n")
    return rows.groupBy("lang", "prefix", "part", "next").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | (F.col("next") == "")).select("lang", "prefix", "next", "f")


def filter_of(phrases: DataFrame) -> bytes:
    """The bit filter of phrases (lang, phrase) of equal length: FILTER_BITS bits, whatever their number."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            words = [x.encode().split(b" ") for x in b["phrase"]]
            if not words:
                continue
            langs = sorted(set(b["lang"]))
            lang = np.searchsorted(langs, b["lang"]) if langs else np.empty(0, np.int64)
            h = None
            for column in zip(*words, strict=True):
                own = Words([x.encode() for x in langs], lang, list(column), lang).hashes()
                h = own if h is None else mix(h, own)
            place = h % np.uint64(FILTER_BITS)
            yield {"word": (place >> np.uint64(6)).astype(np.int64), "bits": (np.uint64(1) << (place & np.uint64(63))).view(np.int64)}

    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in map_rows(phrases, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        bits[r.word] = r.bits
    return bits.tobytes()


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4) -> DataFrame:
    """(lang, m, phrase, f) of all phrases of up to ``longest`` words that occur ``least`` times in a language, and a row
    with m = 0 a language: the number of its words."""
    texts = docs.where("text <> ''").select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    numbers = stage_table(number_words(texts), "numbers")
    filters: list[bytes] = []
    hot: set[tuple[bytes, bytes]] = set()
    levels, total = [], 0
    for m in range(1, longest + 1):
        phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
        level = merged(stripes(numbers, filters, hot), least).select("lang", F.when(phrase == "", 0).otherwise(m).alias("m"), phrase.alias("phrase"), "f")
        level = stage_table(level, f"phrases-{m}")
        levels.append(level)
        if m == 1:
            total = level.where("m = 0").agg(F.sum("f")).first()[0] or 0
        if m < longest:
            known = level.where("m > 0").select("lang", "phrase")
            hot = {(r.lang.encode(), r.phrase.encode()) for r in level.where((F.col("m") > 0) & (F.col("f") * HOT > total)).collect()}  # fewer than HOT
            filters.append(filter_of(known))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, scale: int = 2_000_000, first: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of two to ``longest`` words.

    Stripes: each prefix keys a counter of the words that follow it. A task builds partial stripes, the shuffle is on
    the prefix, and stripes are merged elementwise. They are built one length after the other: a phrase can only be
    frequent if both its parts that are a word shorter are, which a fixed-size bit filter tells before the shuffle.
    The merged structure gives the extensions (a), the totals of all prefixes and suffixes (l, r) and, by the
    greatest count among extensions to either side, which phrases are subsumed. The stripe of a prefix that holds more
    than one in 2,000 words is cut by next word, and that of no words always.

    Scores are whole numbers, from decimals of 38 digits. Null lang: ``und``, with texts whose lang is that. Null or empty
    text: no words. A text of any length is counted whole. Repeated rows count as often as they come. Ties: by a, then
    phrase. Empty table: no rows. Only lang and text are read, so other columns may have any name.
    """
    every = frequent_phrases(docs, least, longest)
    found = every.where("m > 1").select("lang", "m", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    halves = lambda k: F.array(F.struct(F.concat(F.lit("l"), k).alias("side"), join(F.lit(1), k).alias("part")), F.struct(F.concat(F.lit("r"), k).alias("side"), join(k + 1, F.col("m") - k).alias("part")))
    parts = found.select("lang", "m", "phrase", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("m") - 1), halves))).alias("h")).select("lang", "m", "phrase", "a", "h.*")
    counts = every.where("m > 0").select("lang", F.col("phrase").alias("part"), "f")
    met = parts.join(counts, ["lang", "part"]).groupBy("lang", "m", "phrase", "a").agg(F.map_from_entries(F.collect_list(F.struct("side", "f"))).alias("of"))  # two a cut
    score = f"CAST(CAST(a AS DECIMAL(38,0)) * {scale} DIV CAST(of['l' || k] + of['r' || k] AS DECIMAL(38,0)) AS BIGINT)"
    best = F.expr(f"array_min(transform(sequence(1, m - 1), k -> struct({score} AS score, k AS k, of['l' || k] AS l, of['r' || k] AS r)))")
    scored = met.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    within = F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda at: join(at, n)))), lambda x: x.isNotNull())
    longer = found.where("m > 2").select("lang", F.explode(F.array_distinct(within)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr("longer IS NULL OR CAST(longer AS DECIMAL(38,0)) * 100 < CAST(a AS DECIMAL(38,0)) * 80")).drop("longer")

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= first)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    n = every.where("m = 0").select("lang", F.col("f").alias("n"))
    return kept.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
