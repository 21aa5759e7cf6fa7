"""WARC archives as Zstandard frames, one a record, with a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import shared_path, stage_table
from .common import map_rows

#: Fixed values of the format: the skippable frame that holds a dictionary, and the revisit profile.
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("00000000-0000-0000-0000-00000000da7a")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{nth}')}>"


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, nth: int, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header only."""
    clean = "".join(c if c.isprintable() and c != " " else "%{:02X}".format(ord(c) & 255) for c in url or "urn:none")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = {
        "WARC-Record-ID": record_id(page_id, nth),
        "WARC-Date": DATE,
        "WARC-Target-URI": clean,
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": page_id,
    }
    if not revisit:
        return record("response", headers, http + payload)
    return record("revisit", headers | {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to, 0), "X-Refers-To-Page-Id": refers_to}, http)


def dictionary(pages: DataFrame, n_pages: int, rows: int = 512, per_row: int = 16_384, size: int = 65_536) -> bytes:
    """A Zstandard dictionary of the records of about ``rows`` pages (chosen by hash of page_id), of each at most
    ``per_row`` bytes: the bounded sample of 8 MB comes to the driver. With too few records to train on,
    their text itself serves as the dictionary."""
    one_in = max(1, n_pages // rows)
    some = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(one_in)) == 0).select("page_id", "url", F.substring(F.col("payload"), 1, per_row).alias("payload"))
    some = sorted(some.limit(2 * rows).collect(), key=lambda r: (r.page_id is None, r.page_id, r.url or ""))
    samples = [page_record(r.page_id, 0, r.url, bytes(r.payload), None, False) for r in some]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _open(path: str, write: bool = False):
    """A stream of the bytes as they are: by default a name that ends in .zst would be compressed again."""
    system, inner = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(posixpath.dirname(inner), recursive=True)
        return system.open_output_stream(inner, compression=None)
    return system.open_input_stream(inner, compression=None)


def write_archives(rows: DataFrame, folder: str, words: bytes, level: int = 3) -> DataFrame:
    """Write rows (page_id, url, payload, nth, refers_to, revisit) as one archive a task under ``folder``,
    a path that all executors see. Returns the manifest (path, records, bytes): only attempts that ended
    well are in it, and each attempt writes a file of its own."""
    trained = zstandard.ZstdCompressionDict(words).as_bytes() if words else b""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        known = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        press = zstandard.ZstdCompressor(level=level, write_checksum=True, **known)
        task, out, n, size = TaskContext.get(), None, 0, 0
        path = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        for b in batches:
            for page_id, url, payload, nth, refers_to, revisit in zip(*(b[k] for k in ("page_id", "url", "payload", "nth", "refers_to", "revisit")), strict=True):
                if out is None:
                    out = _open(path, write=True)
                    head = DICTIONARY_FRAME + len(trained).to_bytes(4, "little") + trained
                    head += press.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(SPACE, path)}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                    out.write(head)
                    size += len(head)
                frame = press.compress(page_record(page_id, nth, url, payload, refers_to, revisit))
                out.write(frame)
                n, size = n + 1, size + len(frame)
        if out is not None:
            out.close()
            yield {"path": [path], "records": [n], "bytes": [size]}

    return stage_table(map_rows(rows, run, "path string, records long, bytes long"), "manifest")


def records_in(path: str) -> Iterator[bytes]:
    """The records of an archive, one after the other; memory holds one record."""
    with _open(path) as f:
        head = f.read(8)
        if head[:4] != DICTIONARY_FRAME:
            raise ValueError(f"{path} doesn't begin with a dictionary frame")
        words = f.read(int.from_bytes(head[4:], "little"))
        known = {"dict_data": zstandard.ZstdCompressionDict(words)} if words else {}
        reader, rest = zstandard.ZstdDecompressor(**known), b""
        while data := rest or f.read(1 << 20):
            frame, parts, rest = reader.decompressobj(), [], b""
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    rest = frame.unused_data
                    break
                data = f.read(1 << 20)
                if not data:
                    raise ValueError(f"{path} ends within a record")
            yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, tail = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or tail[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, tail[:n]


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of every page record in the
    archives of a manifest. A response's digest and length are computed from its payload and must equal
    its headers'; a record that fails this ends the job."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for path, records in zip(b["path"], b["records"], strict=True):
                out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
                n = 0
                for headers, block in map(parse, records_in(path)):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = int(http.rpartition(b"Content-Length: ")[2])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (length != len(payload) or digest != base32_sha1(payload)):
                        raise ValueError(f"{path}: a payload differs from its digest")
                    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    for k, v in zip(out, (page and int(page), length, digest, headers["WARC-Type"], refers and int(refers), headers["WARC-Target-URI"]), strict=True):
                        out[k].append(v)
                    n += 1
                    if len(out["url"]) >= 10_000:
                        yield out
                        out = {k: [] for k in out}
                if n != records:
                    raise ValueError(f"{path} holds {n} records, not {records}")
                if out["url"]:
                    yield out

    each = manifest.repartition(max(1, min(10_000, manifest.count())))
    return map_rows(each, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html) and return what the archives hold, read back.

    Payload: html in UTF-8; null counts as empty. Of rows with equal payloads (compared by SHA-256) the one
    with the largest page_id is the response, the others revisit it; of repeated rows with that page_id the
    first by url is the response. Payloads are grouped by digest alone, with max() combined map-side, so one
    payload on a third of all pages is no hot group; html is shuffled once, by page_id. Null url: target
    ``urn:none``. Null page_id: never a response while its payload has another. Empty table: no archive. Other
    columns are not read, whatever their names.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    rows = rows.withColumn("at", F.coalesce("page_id", F.lit(-(1 << 63))))
    keys = stage_table(rows.select("at", "page_id", "key"), "keys")
    best = keys.groupBy("key").agg(F.max("page_id").alias("best"))
    kinds = keys.distinct().join(best, "key").select("at", "key", "best")
    joined = rows.join(kinds, ["at", "key"])  # the one shuffle of payloads: the window below has the same keys
    nth = F.row_number().over(W.partitionBy("at", "key").orderBy("url")) - 1
    joined = joined.withColumn("nth", nth).withColumn("revisit", ~(F.col("page_id").eqNullSafe(F.col("best")) & (F.col("nth") == 0)))
    joined = joined.select("page_id", "url", "payload", "nth", F.when(F.col("revisit"), F.col("best")).alias("refers_to"), "revisit")
    folder = folder or shared_path(spark, "warc")
    return read_archives(write_archives(joined, folder, dictionary(rows, keys.count())))
