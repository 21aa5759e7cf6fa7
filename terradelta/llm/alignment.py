"""Alignment of two tokenizers' tokens by bytes, with counts of linked id pairs over the corpus."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stage_table
from .packing import encoding

#: Documents and link bytes of one block: what a task holds when counts come back to their documents.
BLOCK_DOCS, BLOCK_BYTES = 8192, 32 << 20
#: Characters aligned at a time, and linked pairs counted at a time.
CHARS, PAIRS = 1 << 20, 1 << 22

LINKED = "doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys binary, times binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Tokenizers:
    """Tokenizer A (byte-level BPE) and B (sentencepiece): the byte lengths of their ids, the bytes of B's, and the
    identity map: for each id of A the id of B with the same bytes, or -1."""

    a: object
    b: sentencepiece.SentencePieceProcessor
    a_size: np.ndarray
    b_size: np.ndarray
    b_bytes: list[bytes]
    same: np.ndarray

    @property
    def wide(self) -> int:
        """A linked pair of ids is one number: id of A times this, plus id of B."""
        return len(self.b_bytes)


@functools.cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    bpe, _ = encoding(a_path)
    a_bytes = dict(zip(map(bpe.encode_single_token, words := bpe.token_byte_values()), words, strict=True))
    sp = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes, id_of = [], {}
    for n in range(sp.get_piece_size()):
        piece = sp.id_to_piece(n)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(n) else piece.replace("▁", " ").encode())
        if not sp.is_control(n) and not sp.is_unknown(n) and (b_bytes[n] not in id_of or sp.is_byte(id_of[b_bytes[n]])):
            id_of[b_bytes[n]] = n  # a whole piece rather than a fallback byte
    ids = range(max(a_bytes) + 1)
    a_size = np.array([len(a_bytes.get(n, b"")) for n in ids], np.int64)
    same = np.array([id_of.get(a_bytes.get(n), -1) for n in ids], np.int64)
    return Tokenizers(bpe, sp, a_size, np.array(list(map(len, b_bytes)), np.int64), b_bytes, same)


@functools.cache
def _decimals(n: int, after: bytes) -> np.ndarray:
    return np.array([b"%d%s" % (k, after) for k in range(n)], object)


def encode(t: Tokenizers, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Numbers of the texts that have tokens, and their ids by A and B. A reads a space and the text; B adds the space
    itself. Texts that are null or empty, or whose tokens don't give back a space and the text, have none."""
    some = [n for n, x in enumerate(texts) if x]
    kept, a, b = [], [], []
    for n, other in zip(some, t.b.encode([texts[n] for n in some], num_threads=1), strict=True):
        whole = " " + texts[n]
        raw = whole.encode()
        if b"".join(map(t.b_bytes.__getitem__, other)) == raw:
            mine = t.a.encode_to_numpy(whole, disallowed_special=()).astype(np.int64)
            if t.a_size[mine].sum() == len(raw):
                kept.append(n)
                a.append(mine)
                b.append(np.array(other, np.int64))
    return np.array(kept, np.int64), a, b


def align(t: Tokenizers, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Alignment of several texts at once: groups of each; text, pair and number of every distinct linked pair; the digests
    of the groups.

    A's and B's tokens of a text have the same bytes, so the ends of all texts' tokens lie on one line. Each stretch
    between neighbouring ends, of either side, is one link: those that end with a token of A are met at the first
    token of B that ends there or later, those that end with a token of B alone likewise.
    """
    many_a, many_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
    text_a, text_b = np.repeat(np.arange(len(a)), many_a), np.repeat(np.arange(len(b)), many_b)
    a, b = np.concatenate(a), np.concatenate(b)
    end_a, end_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    at_b, at_a = np.searchsorted(end_b, end_a), np.searchsorted(end_a, end_b)
    shut_a, shut_b = end_b[at_b] == end_a, end_a[at_a] == end_b  # tokens that close a group
    groups = np.bincount(text_a[shut_a], minlength=len(many_a))
    own = ~shut_b
    pairs = np.concatenate((a * t.wide + b[at_b], a[at_a[own]] * t.wide + b[own]))
    linked, times = np.unique(np.concatenate((text_a, text_b[own])) << 32 | pairs, return_counts=True)
    # Groups written out: A's ids, then B's; a token's place is its own number and that of the other side's before it.
    group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
    upto_a, upto_b = np.flatnonzero(shut_a) + 1, np.concatenate(([0], np.flatnonzero(shut_b) + 1))
    parts = np.empty(len(a) + len(b), object)
    n_a, n_b = len(t.a_size), t.wide
    parts[np.arange(len(a)) + upto_b[group_a]] = np.where(shut_a, _decimals(n_a, b"|")[a], _decimals(n_a, b",")[a])
    parts[np.arange(len(b)) + upto_a[group_b]] = np.where(shut_b, _decimals(n_b, b";")[b], _decimals(n_b, b",")[b])
    stops = np.cumsum(many_a + many_b).tolist()
    digests = [hashlib.sha256(b"".join(parts[x:y])[:-1]).hexdigest() for x, y in zip([0, *stops], stops, strict=False)]
    return groups, linked >> 32, linked & 0xFFFFFFFF, times, digests


def link_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """LINKED: for every row of ``docs`` its alignment, its distinct linked pairs and how often it holds each, as 32-bit
    numbers. Rows read one after the other form blocks."""

    def slices(texts: list) -> Iterator[range]:
        first, held = 0, 0
        for n, x in enumerate(texts):
            held += len(x or "")
            if held >= CHARS:
                yield range(first, n + 1)
                first, held = n + 1, 0
        if first < len(texts):
            yield range(first, len(texts))

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        t = tokenizers(a_path, b_path)
        block, docs_in, bytes_in = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            for part in slices(batch["text"]):
                n = len(part)
                out = {"doc_id": batch["doc_id"][part.start : part.stop], "block": [0] * n, "n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n, "groups_sha256": [""] * n, "keys": [b""] * n, "times": [b""] * n}
                kept, a, b = encode(t, batch["text"][part.start : part.stop])
                if len(kept):
                    groups, text, keys, times, digests = align(t, a, b)
                    keys, times = keys.astype("<u4"), times.astype("<u4")
                    cuts = np.searchsorted(text, np.arange(len(kept) + 1)).tolist()
                    for k, i in enumerate(kept.tolist()):
                        x, y = cuts[k], cuts[k + 1]
                        out["n_a"][i], out["n_b"][i], out["n_groups"][i] = len(a[k]), len(b[k]), int(groups[k])
                        out["n_links"][i] = len(a[k]) + len(b[k]) - int(groups[k])
                        out["groups_sha256"][i], out["keys"][i], out["times"][i] = digests[k], keys[x:y].tobytes(), times[x:y].tobytes()
                for i in range(n):
                    size = 2 * len(out["keys"][i])
                    if docs_in and (docs_in == BLOCK_DOCS or bytes_in + size > BLOCK_BYTES):
                        block, docs_in, bytes_in = block + 1, 0, 0
                    docs_in, bytes_in = docs_in + 1, bytes_in + size
                    out["block"][i] = block
                yield out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, LINKED)


def count_pairs(linked: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(block, key, n): how many documents of a block hold a pair linked. Pairs of the identity map are counted in a vector
    as long as A's vocabulary, one a task, and have no block; the others are summed up by block."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        t = tokenizers(a_path, b_path)
        vector, held, many = np.zeros(len(t.a_size), np.int64), {}, 0

        def flush() -> Iterator[dict]:
            for block, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield {"block": [block] * len(keys), "key": keys.tolist(), "n": n.tolist()}
            held.clear()

        for batch in batches:
            for block, blob in zip(batch["block"], batch["keys"], strict=True):
                keys = np.frombuffer(blob, "<u4").astype(np.int64)
                a = keys // t.wide
                plain = t.same[a] == keys % t.wide
                vector[a[plain]] += 1  # a pair comes once a document
                held.setdefault(block, []).append(keys[~plain])
                many += len(keys)
                if many >= PAIRS:
                    yield from flush()
                    many = 0
        yield from flush()
        used = np.flatnonzero(vector)
        yield {"block": [None] * len(used), "key": (used * t.wide + t.same[used]).tolist(), "n": vector[used].tolist()}

    return map_rows(linked.select("block", "keys"), run, "block long, key long, n long")


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    Tokens of A and B are cut into groups where both end; every A and B token that share bytes are a link. A pair's count
    is the number of documents (rows) that hold it linked. n_best counts the links whose count is the highest of
    their A id, count_sum sums the counts over links.

    A group of one A and one B token with equal bytes is a pair of the identity map: such pairs are counted in vectors,
    whose sum (a number for each id of A) the driver hands to all tasks. Only other pairs are shuffled, summed up by
    block first, and come back by block, so a document meets the counts of its own block's pairs: a pair on a third of all
    documents is one row a block. What a task holds is one block (8,192 documents, 32 MB of links) or 4 million pairs.

    Null, empty and irreversible texts: zeros, groups_sha256 ''. Null doc_id, repeated rows: rows like others (repeats
    count). Very long texts: aligned whole. Empty table: no rows. Only doc_id and text are read, so other columns may
    have any name. Names of special tokens inside a text are plain text.
    """
    spark = docs.sparkSession
    linked = stage_table(link_documents(docs, a_path, b_path), "linked")
    met = stage_table(count_pairs(linked, a_path, b_path), "met")
    other = stage_table(met.where("block IS NOT NULL").groupBy("key").agg(F.sum("n").alias("count")), "pairs")
    t = tokenizers(a_path, b_path)
    plain, best = np.zeros(len(t.a_size), np.int64), np.zeros(len(t.a_size), np.int64)
    for r in met.where("block IS NULL").groupBy("key").agg(F.sum("n").alias("n")).collect():  # a row an id of A at most
        plain[r.key // t.wide] = r.n
    for r in other.groupBy(F.expr(f"key DIV {t.wide}").alias("a")).agg(F.max("count").alias("n")).collect():  # likewise
        best[r.a] = r.n
    best = np.maximum(best, plain)
    vectors = spark.sparkContext.broadcast((plain, best))
    wanted = met.where("block IS NOT NULL").select("block", "key").distinct()
    known = wanted.join(other, "key").select("block", "key", "count")

    def answer(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        t = tokenizers(a_path, b_path)
        plain, best = vectors.value
        order = np.argsort(k := counts.column("key").to_numpy())
        k, n = k[order], counts.column("count").to_numpy()[order]
        n_best, count_sum = [], []
        for keys, times in zip(rows.column("keys").to_pylist(), rows.column("times").to_pylist(), strict=True):
            keys, times = np.frombuffer(keys, "<u4").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
            a = keys // t.wide
            found = plain[a]
            rest = t.same[a] != keys % t.wide
            found[rest] = n[np.searchsorted(k, keys[rest])]
            n_best.append(int(times[found == best[a]].sum()))
            count_sum.append(int((times * found).sum()))
        out = rows.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return out.select([c.split(" ")[0] for c in RESULT.split(", ")])

    return linked.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(answer, RESULT)
