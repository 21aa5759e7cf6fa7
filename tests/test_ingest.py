"""Ingest of landed payloads: outcomes by source, replays, crashes between writes, hashes of nested content."""

import datetime as dt
import json

from pyspark.sql import functions as F

from terradelta.functions import text
from terradelta.operators import history
from terradelta.sources import readers
from terradelta.streaming import ingest


def payload(source, day, names, **more):
    features = [{"type": "Feature", "id": n, "geometry": {"type": "Point", "coordinates": [1.0, 2]}, "properties": {"name": n}} for n in names]
    return json.dumps({"mapper_id": source, "captured_at": f"2026-08-{day:02d}T00:00:00Z", "layers": [{"id": "x", "data": {"features": features}}]} | more)


def land(tmp_path, source, name, body):
    folder = tmp_path / "landing" / f"source={source}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(body)


def run(spark, tmp_path, **more):
    ingest.ingest(ingest.landed(spark, str(tmp_path / "landing"), **more), str(tmp_path / "store"), str(tmp_path / "state")).awaitTermination()
    runs = ingest.read_runs(spark, str(tmp_path / "store")).orderBy("source_id", "observed_at", "path").collect()
    return [(r.source_id, r.path.rsplit("/", 1)[1][:-5], r.status, r.n_features) for r in runs], {r.path.rsplit("/", 1)[1][:-5]: r.error for r in runs if r.error}


def test_outcomes_by_source(spark, tmp_path):
    land(tmp_path, "a", "a1", payload("a", 1, ["p", "q"]))
    land(tmp_path, "a", "a2", payload("a", 2, ["q", "p"]))
    land(tmp_path, "b", "b1", payload("b", 1, ["p"])[:-9])
    land(tmp_path, "b", "b2", "not even JSON")
    land(tmp_path, "c", "c1", payload("c", 1, ["p"], status="stale", error="x" * 9000))
    land(tmp_path, "c", "c2", payload("B A D", 1, ["p"]))
    land(tmp_path, "c", "c3", payload("a", 1, ["p"]))
    land(tmp_path, "c", "c4", json.dumps({"mapper_id": "c", "layers": []}))
    land(tmp_path, "d", "d1", payload("d", 1, []))
    got, errors = run(spark, tmp_path)
    assert [g for g in got if g[0] in "ad"] == [("a", "a1", "stored", 2), ("a", "a2", "unchanged", 2), ("d", "d1", "stored", 0)]
    assert {g[1]: g[2] for g in got if g[0] in "bc"} == dict.fromkeys(("b1", "b2", "c1", "c2", "c3", "c4"), "failed")
    assert errors["b1"].startswith("unreadable payload: {") and errors["c1"] == "x" * 4000 and "missing or invalid" in errors["c2"] and "another source: a" in errors["c3"] and errors["c4"] == "no usable layers"
    # A failure leaves its source's state: b starts now, a goes on, and comes back to what it was.
    land(tmp_path, "a", "a3", payload("a", 3, ["p"]))
    land(tmp_path, "a", "a4", payload("a", 4, ["p", "q"]))
    land(tmp_path, "a", "a0", payload("a", 1, ["p", "q"]))  # late: compared with the latest observation
    land(tmp_path, "b", "b3", payload("b", 3, ["p"]))
    got, _ = run(spark, tmp_path)
    assert [(g[1], g[2]) for g in got if g[0] == "a"] == [("a0", "unchanged"), ("a1", "stored"), ("a2", "unchanged"), ("a3", "stored"), ("a4", "stored")]
    assert ("b", "b3", "stored", 1) in got
    kept = ingest.read_features(spark, str(tmp_path / "store")).groupBy("source_id").count().collect()
    assert {r.source_id: r["count"] for r in kept} == {"a": 3, "b": 1}  # the reversion's features are there already


def test_replayed_and_unfinished_batches_leave_nothing_twice(spark, tmp_path):
    root = str(tmp_path / "store")
    names = [c.split(" ")[0] for c in ingest.PAYLOAD.split(", ")][:3]
    rows = [(x, f"f/{x}.json", dt.datetime(2026, 8, 1), payload(x, 1, ["p", "q"])) for x in "ab"]
    batch = spark.createDataFrame(rows, "source string, path string, landed_at timestamp, text string").withColumn("p", F.from_json("text", ingest.PAYLOAD)).select("source", "path", "landed_at", "p.*", F.lit(None).cast("string").alias("broken")).drop("_corrupt_record")
    assert set(names) <= set(batch.columns)
    ingest.ingest_batch(batch, 0, root)
    first = sorted(map(str, ingest.read_runs(spark, root).collect()))
    ingest.ingest_batch(batch, 0, root)
    assert sorted(map(str, ingest.read_runs(spark, root).collect())) == first and ingest.read_features(spark, root).count() == 4
    ingest.read_features(spark, root).drop("batch").write.partitionBy("source_id").parquet(f"{root}/features/batch=1")  # crashed before its runs
    assert ingest.read_features(spark, root).count() == 4
    ingest.ingest_batch(batch, 1, root)
    assert ingest.read_features(spark, root).count() == 4
    assert sorted((r.batch, r.status) for r in ingest.read_runs(spark, root).collect()) == [(0, "stored")] * 2 + [(1, "unchanged")] * 2


def test_canonical_text_and_feature_hash(spark):
    def canonical(*texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.canonical_text(F.col("t"))).collect()]

    a, b, c, d = canonical('{"b":{"z":1,"a":[1.0,0.1234567891,{"y":"1","x":-0.0}]},"a":"q\\"1 2.50"}', '{"a": "q\\"1 2.50", "b": {"a":[1, 0.123456789, {"x":0, "y":"1"}], "z":1.000}}', '{"a":"q\\"1 2.50","b":{"a":[1,0.1234568,{"x":0,"y":1}],"z":1}}', '{"a":"q\\"1 2.50","b":{"a":[0.1234568,1,{"x":0,"y":"1"}],"z":1}}')
    assert a == b and len({a, c, d}) == 3
    assert canonical(None, '{"a": 1, "a": 2.50}', '{"a": nul', "[]") == [None, '{"a":1.0,"a":2.5}', '{"a":nul', "[]"]
    deep = "[" * 40 + "0.10" + "]" * 40
    assert canonical(deep) == ["[" * 40 + "0.1" + "]" * 40]
    shape = lambda x: json.dumps({"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [x, 2]}, {"coordinates": [[1, 2], [3, 4]], "type": "LineString"}]})
    rows = [(shape(1.00000001), '{"a":{"b":1,"c":[]}}'), (shape(1), '{"a":{"c":[],"b":1.0}}'), (shape(1.1), '{"a":{"c":[],"b":1.0}}'), (shape(1), None), (shape(1), "{}"), (None, None)]
    h = [r[0] for r in spark.createDataFrame(rows, "g string, p string").select(readers.feature_hash(F.col("g"), F.col("p"))).collect()]
    assert h[0] == h[1] and h[3] == h[4] and len({h[0], h[2], h[3], h[5]}) == 4


def test_history_from_payload_files(spark, tmp_path):
    def body(day, boxes, **more):
        ring = lambda w: [[[w, 47.0], [w + 0.1, 47.0], [w + 0.1, 47.1], [w, 47.1], [w, 47.0]]]
        features = [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": ring(w)}, "properties": {"name": name, "deep": {"n": deep}}} for name, w, deep in boxes]
        return json.dumps({"mapper_id": "m", "captured_at": f"2026-08-{day:02d}T00:00:00Z", "layers": [{"id": "x", "data": {"features": features}}]} | more)

    a = [("area", 30.0, 1), ("area", 40.0, 1), ("lone", 50.0, 1)]
    land(tmp_path, "m", "1", body(1, a))
    land(tmp_path, "m", "2", body(2, [a[1], ("area", 30.02, 1), a[2], ("new", 60.0, 1)]))  # one moves, one comes
    land(tmp_path, "m", "3", body(3, [a[2], a[0], a[1]]))  # back to the first, in another order
    land(tmp_path, "m", "4", body(4, [("area", 40.0, 2), a[0], a[2]]))  # only what isn't seen changes
    land(tmp_path, "m", "5", body(5, a)[:-5])
    got, _ = run(spark, tmp_path)
    assert [g[2] for g in got] == ["stored"] * 4 + ["failed"] or sorted(g[2] for g in got) == ["failed"] + ["stored"] * 4
    root = str(tmp_path / "store")
    runs, features = ingest.read_runs(spark, root), ingest.read_features(spark, root)
    out, changes, pieces = history.overlay_history(runs, features)
    rows = [(r.obs, r.snapshot, r.is_baseline, r.n_features, r.added, r.removed, r.modified) for r in out.orderBy("obs").collect()]
    assert rows == [(0, 0, True, 3, 0, 0, 0), (1, 1, False, 4, 1, 0, 1), (2, 0, False, 3, 0, 1, 1), (3, 2, False, 3, 0, 0, 0)]
    keys = lambda n: {r.logical_key: (r.w, r.confidence) for r in history.versions_of(history.observe(runs), features).where(f"snapshot = {n}").collect()}
    first, second, third = keys(0), keys(1), keys(2)
    assert set(first) < set(second) and set(third) == set(first) and "m:x:fallback:lone:polygon" in first
    moved = [k for k in first if first[k][0] == 30.0][0]
    assert second[moved] == (30.02, 0.55) and third[moved] == (30.0, 0.65)  # compared with what was shown before it
    assert sorted((r.obs, r.phase) for r in pieces.collect()) == sorted([(1, "after"), (1, "before"), (1, "after"), (2, "after"), (2, "before"), (2, "before")])
    assert changes.count() == 4
