"""Versioned tables: what a version rewrites, what readers see, replays, crashes, rival writers."""

import datetime as dt
import os
import random

import pytest

from terradelta.sources import versions
from terradelta.streaming import jobs

SCHEMA = "uuid string, event_date date, source_hash string"
DAY = lambda n: dt.date(2026, 8, n)


def table(spark, rows):
    return spark.createDataFrame([(u, DAY(d) if d else None, h) for u, d, h in rows], SCHEMA)


def held(spark, root, **more):
    return sorted(((r.uuid, r.event_date and r.event_date.day, r.source_hash) for r in versions.read_version(spark, root, **more).collect()), key=str)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet") and "_manifest" not in d}


def test_only_days_that_change_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [(f"{d:02d}-{n}", d, "h") for d in range(1, 11) for n in range(5)]
    versions.write_version(table(spark, rows), root, "uuid", "event_date")
    before = files(root)
    # One row changes, one moves from day 7 to 8, one is new on day 20.
    versions.upsert_version(table(spark, [("03-1", 3, "new"), ("07-2", 8, "moved"), ("20-0", 20, "h")]), root)
    after = files(root)
    assert {f: t for f, t in after.items() if f in before} == before
    assert {f.split("event_date=")[1][:10] for f in set(after) - set(before)} == {"2026-08-03", "2026-08-07", "2026-08-08", "2026-08-20"}
    want = [r for r in rows if r[0] not in ("03-1", "07-2")] + [("03-1", 3, "new"), ("07-2", 8, "moved"), ("20-0", 20, "h")]
    assert held(spark, root) == sorted(want) and held(spark, root, version=0) == sorted(rows)
    assert held(spark, root, low="2026-08-03", high="2026-08-03") == sorted(r for r in want if r[1] == 3)
    assert {r.part[-2:]: (r.version, r.rows) for r in versions.manifest(spark, root) if r.part >= "2026-08-07"} == {"07": (1, 4), "08": (1, 6), "09": (0, 5), "10": (0, 5), "20": (1, 1)}


def test_unfinished_versions_and_rival_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    with pytest.raises(ValueError):
        versions.read_version(spark, root)
    versions.write_version(table(spark, [("a", 1, "h")]), root, "uuid", "event_date")
    table(spark, [("a", 1, "half")]).write.partitionBy("event_date").parquet(f"{root}/v=1")  # crashed before its manifest
    (tmp_path / "t" / "_manifest" / "v=2").mkdir()  # crashed within it
    assert versions.newest(spark, root) == 0 and held(spark, root) == [("a", 1, "h")]
    assert versions.upsert_version(table(spark, [("b", 1, "h")]), root) == 3
    assert held(spark, root) == [("a", 1, "h"), ("b", 1, "h")]
    numbers = versions._numbers
    monkeypatch.setattr(versions, "_numbers", lambda *a: {n: c for n, c in numbers(*a).items() if n < 3})
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # saw version 0 as the newest, and comes second
        versions.upsert_version(table(spark, [("c", 1, "h")]), root)
    monkeypatch.undo()
    assert held(spark, root) == [("a", 1, "h"), ("b", 1, "h")]


def test_replay_reconcile_expire_vacuum(spark, tmp_path):
    root = str(tmp_path / "t")
    versions.write_version(table(spark, [("a", 1, "h"), ("b", 2, "h"), ("c", 2, "h"), ("d", 3, "h"), (None, None, "h")]), root, "uuid", "event_date", "start")
    assert versions.upsert_version(table(spark, [("a", 4, "x")]), root, "job:1") == 1
    assert versions.upsert_version(table(spark, [("a", 4, "x")]), root, "job:1") == 1 and versions.tag(spark, root) == "job:1"
    assert versions.upsert_version(table(spark, []), root, "job:2") == 2
    now = [("a", 4, "x"), ("b", 2, "h"), ("c", 2, "h"), ("d", 3, "h"), (None, None, "h")]
    assert held(spark, root) == sorted(now, key=str)
    before = files(root)
    versions.keep_version(table(spark, [("b", 9, "-"), ("a", 1, "-")]), root, "2026-08-02")
    assert held(spark, root) == sorted([("a", 4, "x"), ("b", 2, "h"), (None, None, "h")], key=str)
    assert {f.split("event_date=")[1][:10] for f in set(files(root)) - set(before)} == {"2026-08-02"}
    before = files(root)
    assert versions.expire_version(spark, root, "2026-08-03") == 4 and versions.expire_version(spark, root, "2026-08-03") == 4
    assert files(root) == before and held(spark, root) == [("a", 4, "x"), (None, None, "h")]
    assert versions.vacuum(spark, root, keep=1) and held(spark, root) == [("a", 4, "x"), (None, None, "h")]
    assert len(files(root)) == 2 and versions.vacuum(spark, root, keep=1) == []
    versions.write_version(table(spark, []), root, "uuid", "event_date")
    assert held(spark, root) == []


def test_many_upserts_are_those_of_a_dictionary(spark, tmp_path):
    root, rng, want = str(tmp_path / "t"), random.Random(2), {}
    for n in range(5):
        new = {f"k{rng.randrange(40):02d}": (rng.randrange(1, 28), f"h{n}") for _ in range(12)}
        df = table(spark, [(k, *v) for k, v in new.items()])
        versions.upsert_version(df, root) if n else versions.write_version(df, root, "uuid", "event_date")
        want |= new
        assert held(spark, root) == sorted((k, *v) for k, v in want.items())


def test_sync_replays_batches_and_expires_days(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = [("a", dt.datetime(2026, 8, 1, 5), "old"), ("a", dt.datetime(2026, 8, 1, 6), "new"), ("b", dt.datetime(2026, 5, 1), "too old"), ("c", dt.datetime(2026, 8, 9), "h")]
    batch = spark.createDataFrame(rows, "uuid string, occurred_at timestamp, source_hash string").selectExpr("*", "CAST(occurred_at AS DATE) AS event_date")
    merge = jobs.merge_into(root, "job", 30, dt.date(2026, 8, 20))
    merge(batch, 0)
    assert held(spark, root) == [("a", 1, "new"), ("c", 9, "h")]
    later = spark.createDataFrame([("c", dt.datetime(2026, 8, 10), "moved")], "uuid string, occurred_at timestamp, source_hash string").selectExpr("*", "CAST(occurred_at AS DATE) AS event_date")
    merge(later, 1)
    n, seen = versions.newest(spark, root), files(root)
    merge(later, 1)
    assert versions.newest(spark, root) == n and files(root) == seen
    jobs.merge_into(root, "job", 30, dt.date(2026, 9, 5))(later, 2)
    assert held(spark, root) == [("c", 10, "moved")]
