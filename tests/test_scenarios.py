"""Small scenarios with known answers: hashing, identity, diffs, slivers, links, times, markets."""

import datetime as dt
import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from terradelta.functions import geo, text
from terradelta.operators import areas, diff, events, identity, markets, nearest, overlay, pieces, snapshots, tiles
from terradelta.sources import readers


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def box(w, s, e, n):
    return [[(w, s), (e, s), (e, n), (w, n)]]


def payload(features, **layer):
    return json.dumps({"mapper_id": "m", "run_id": 1, "layers": [{"data": {"type": "FeatureCollection", "features": features}} | layer]})


def point(lon, lat, name, **extra):
    return {"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": {"name": name}} | extra


def snapshot_hash(spark, tmp_path, name, body):
    (tmp_path / name).write_text(body)
    f = readers.read_overlays(spark, str(tmp_path / name))
    f = f.withColumn("feature_hash", readers.feature_hash(F.col("geometry"), F.col("properties"))).withColumn("paint", text.canonical_text(F.coalesce("paint", F.lit("{}"))))
    return snapshots.content_hashes(f).first()["content_hash"]


def test_hash_ignores_order_and_ids(spark, tmp_path):
    a, b = point(31.000000001, 48, "A"), point(32, 49, "B")
    h = [snapshot_hash(spark, tmp_path, f"{n}.json", payload(f, id="x", paint=p)) for n, (f, p) in enumerate([([a, b], {"c": "1"}), ([b, a | {"id": "new"}], {"c": "1"}), ([a, b], {"c": "2"}), ([a, point(32.1, 49, "B")], {"c": "1"}), ([point(31, 48, "A"), b], {"c": "1"})])]
    assert h[0] == h[1] == h[4] and len({h[0], h[2], h[3]}) == 3


def test_layer_defaults(spark, tmp_path):
    (tmp_path / "p.json").write_text(payload([point(1, 2, "A")]))
    r = readers.read_overlays(spark, str(tmp_path / "p.json")).first()
    assert (r.layer_key, r.label, r.geometry_type) == ("layer-0", "layer-0", "polygon")


def test_base_keys(spark):
    key = lambda fid, props: text.base_key(F.lit("s"), F.lit("area"), F.lit(fid).cast("string"), F.create_map(*[F.lit(x) for p in props.items() for x in p]), F.lit("Point"))
    r = one(spark, a=key(None, {"OBJECTID": "42", "name": "n"}), b=key(None, {"placemark_id": "front-7"}), c=key(None, {"name": "Area"}), d=key("Top 1", {"OBJECTID": "42"}))
    assert r.a.key.endswith("objectid:42") and r.a.confidence == 0.95
    assert r.b.key.endswith("placemark_id:front-7") and r.b.confidence == 1.0
    assert r.c.key.endswith("fallback:area:point") and r.c.confidence < 0.9
    assert r.d.key == "s:area:id:top-1"


def test_run_status_and_timeline(spark):
    t = [dt.datetime(2026, 8, 20, h) for h in (8, 9, 10, 11)]
    runs = spark.createDataFrame([("s", n, x, h) for n, (x, h) in enumerate(zip(t, "AABA", strict=True))], "source_id string, run_id long, observed_at timestamp, content_hash string")
    got = {r.run_id: r.status for r in snapshots.run_status(runs).collect()}
    assert got == {0: "stored", 1: "unchanged", 2: "stored", 3: "reversion"}
    line = snapshots.timeline(snapshots.run_status(runs).where("status <> 'unchanged'")).orderBy("observed_at").collect()
    assert [r.is_baseline for r in line] == [True, False, False] and [r.previous_snapshot for r in line] == [None, "A", "B"]
    assert snapshots.timeline(runs, runs).count() == 0


def test_as_of_end_of_local_day(spark):
    obs = spark.createDataFrame([("s", 1, dt.datetime(2026, 8, 20, 20, 59), "a"), ("s", 2, dt.datetime(2026, 8, 20, 21, 0), "b")], "source_id string, run_id long, observed_at timestamp, content_hash string")
    days = spark.createDataFrame([(dt.date(2026, 8, d),) for d in (1, 20, 21)], "day date")
    got = {r.day.day: r.content_hash for r in snapshots.as_of(obs, days, text.day_range(F.col("day"))[1]).collect()}
    assert got == {1: None, 20: "a", 21: "b"}


def features(rows):
    base = {"source_id": "s", "layer_key": "L", "confidence": 1.0, "props_hash": "p", "w": 35.8, "s": 47.5, "e": 35.9, "n": 47.6}
    return [base | {"feature_id": f"{r['logical_key']}@{r['obs']}", "geometry_hash": r["content_hash"]} | r for r in rows]


def changed(spark, rows):
    return sorted((r.obs, r.logical_key, r.change_type, round(r.confidence, 2)) for r in diff.changes(spark.createDataFrame(features(rows))).collect())


def test_rotated_id_is_one_change(spark):
    assert changed(spark, [{"obs": 0, "logical_key": "old", "content_hash": "a"}, {"obs": 1, "logical_key": "new", "content_hash": "b", "e": 35.901}]) == [(1, "new", "modified", 0.9)]


def test_layer_move_is_modified_and_copy_is_unchanged(spark):
    rows = [{"obs": 0, "logical_key": k, "content_hash": "a"} for k in ("x#1", "x#2")] + [{"obs": 1, "logical_key": "x#1", "content_hash": "a"}, {"obs": 1, "logical_key": "x#2", "content_hash": "a", "layer_key": "M"}]
    got = changed(spark, rows)
    assert [(o, k, t) for o, k, t, _ in got] == [(1, "x#2", "modified")]


def test_added_and_removed(spark):
    got = changed(spark, [{"obs": 0, "logical_key": "a", "content_hash": "1"}, {"obs": 1, "logical_key": "b", "content_hash": "2", "layer_key": "M"}])
    assert [(k, t) for _, k, t, _ in got] == [("a", "removed"), ("b", "added")]


def test_sliver_and_material(spark):
    old = box(35.8, 47.5, 36.0, 47.6)
    strip = overlay.difference_pieces(old, box(35.8, 47.4998, 36.0, 47.6))
    edge = overlay.difference_pieces(old, box(35.8, 47.51, 36.0, 47.6))
    assert [p["phase"] for p in strip] == ["after"] and [p["phase"] for p in edge] == ["before"]
    kept = lambda p: one(spark, m=pieces.material(F.lit(p["area"]), F.lit(p["radius"]), F.lit(p["perimeter"]), F.lit(True))).m
    assert not kept(strip[0]) and kept(edge[0])


def test_overlay_measures():
    a, b = box(30, 45, 30.2, 45.1), [[(30.1, 45), (30.3, 45), (30.3, 45.1), (30.1, 45.1)], [(30.14, 45.04), (30.16, 45.04), (30.16, 45.06), (30.14, 45.06)]]
    band = lambda s, n: (math.sin(math.radians(n)) - math.sin(math.radians(s))) * geo.EARTH**2
    pieces = {p["phase"]: [] for p in overlay.difference_pieces(a, b)}
    for p in overlay.difference_pieces(a, b):
        pieces[p["phase"]].append(p)
    assert len(pieces["before"]) == 2 and len(pieces["after"]) == 1
    assert math.isclose(sum(p["area"] for p in pieces["before"]), math.radians(0.1) * band(45, 45.1) + math.radians(0.02) * band(45.04, 45.06), rel_tol=1e-9)
    height = math.radians(0.1) * geo.EARTH
    assert abs(pieces["after"][0]["radius"] - math.radians(0.1) * geo.EARTH * math.cos(math.radians(45.05)) / 2) < 0.02 * height
    crossing = overlay.overlap_ratio([[(0, 0), (2, 0), (2, 2), (0, 2)]], [[(1, -1), (3, 1), (1, 3), (-1, 1)]])
    assert abs(crossing - 0.5) < 0.01
    assert overlay.overlap_ratio([], []) is None and overlay.difference_pieces(a, a) == []


def test_identity_exact_before_nearest(spark):
    rows = [("s", 0, "b", "r0", "h1", 0.65, 0.0, 0.0), ("s", 0, "b", "r1", "h2", 0.65, 10.0, 0.0), ("s", 1, "b", "r2", "h1", 0.65, 10.0, 0.0), ("s", 1, "b", "r3", "h2", 0.65, 0.0, 0.0), ("s", 1, "c", "r4", "h9", 0.65, 0.0, 0.0)]
    f = spark.createDataFrame(rows, "source_id string, obs long, base_key string, row_id string, content_hash string, confidence double, lon double, lat double")
    got = {r.row_id: (r.logical_key, r.confidence) for r in identity.fold_identities(f).collect()}
    assert got["r2"][0] == got["r0"][0] and got["r3"][0] == got["r1"][0] and got["r2"][1] == 0.65 and got["r4"] == ("c", 0.65)


def assign(group, base, previous):
    """The rule one feature at a time: (key, cap) for each (hash, confidence, lon, lat) of a snapshot."""
    sure = all(c >= 0.95 for _, c, _, _ in group)
    left, out = list(previous), {}
    order = sorted(range(len(group)), key=lambda n: group[n][0])
    for n in order:
        hit = [old for old in left if old[1] == group[n][0]]
        if hit:
            left.remove(hit[0])
            out[n] = hit[0][0], 0.9 if sure else 0.65
    for n in [n for n in order if n not in out]:
        digest, _, lon, lat = group[n]
        if left:
            near = min(left, key=lambda old: (old[2] - lon) ** 2 + (old[3] - lat) ** 2)
            left.remove(near)
            out[n] = near[0], 0.9 if sure else 0.55
        else:
            taken = {key for key, _ in out.values()}
            keys = [f"{base}#{digest[:16]}" + (f"-{k}" if k > 1 else "") for k in range(1, len(group) + 2)]
            out[n] = next(k for k in keys if k not in taken), 0.85 if sure else 0.45
    return [out[n] for n in range(len(group))]


def fold(rows):
    """Every source and base by itself, snapshot after snapshot."""
    out = {}
    for source, base in {(r[0], r[2]) for r in rows}:
        before, last = [], None
        for obs in sorted({r[1] for r in rows if (r[0], r[2]) == (source, base)}):
            part = sorted(r for r in rows if (r[0], r[1], r[2]) == (source, obs, base))
            group = [(r[4], r[5], r[6], r[7]) for r in part]
            keys = [(base, 1.0)] if len(part) == 1 else assign(group, base, before if last == obs - 1 else [])
            out |= {(source, obs, r[3]): (key, min(r[5], cap)) for r, (key, cap) in zip(part, keys, strict=True)}
            before, last = [(key, r[4], r[6], r[7]) for r, (key, _) in zip(part, keys, strict=True)], obs
    return out


IDENTITY = "source_id string, obs long, base_key string, row_id string, content_hash string, confidence double, lon double, lat double"


def test_identities_at_once_are_those_one_after_the_other(spark):
    rng = random.Random(12)
    rows = []
    for source in "st":
        for base in ("a", "b", "c", "d"):
            few = rng.choice([2, 6])
            for obs in range(23):
                if rng.random() < 0.1:
                    continue  # the base is away, and its keys with it
                for n in range(rng.randrange(0, few)):
                    h = f"{rng.randrange(few)}" * 20
                    rows.append((source, obs, base, f"r{n:02d}", h, rng.choice([1.0, 0.95] if base == "a" else [1.0, 0.65]), float(rng.randrange(4)), float(rng.randrange(3))))
    got = {(r.source_id, r.obs, r.row_id, r.base_key): (r.logical_key, r.confidence) for r in identity.fold_identities(spark.createDataFrame(rows, IDENTITY)).collect()}
    want = {}
    for base in "abcd":
        want |= {(*k, base): v for k, v in fold([r for r in rows if r[2] == base]).items()}
    assert got == want and len(got) == len(rows)
    assert sum("-" in key for key, _ in want.values()) > 10  # numbers behind keys occur


def test_identities_of_a_hot_base_and_a_long_chain(spark):
    rng = random.Random(13)
    rows = [("s", obs, "hot", f"r{n:05d}", f"{obs}{n:05d}" * 4, 0.65, rng.uniform(0, 9), rng.uniform(0, 9)) for obs in (0, 1) for n in range(5000)]
    rows += [("s", obs, "long", f"r{n}", f"{n}" * 20, 1.0, 0.0, 0.0) for obs in range(300) for n in (1, 2)]
    got = identity.fold_identities(spark.createDataFrame(rows, IDENTITY)).collect()
    hot = [r for r in got if r.base_key == "hot"]
    assert {r.logical_key for r in hot if r.obs == 1} == {r.logical_key for r in hot if r.obs == 0} and len({r.logical_key for r in hot}) == 5000
    assert {r.logical_key for r in got if r.base_key == "long"} == {f"long#{'1' * 16}", f"long#{'2' * 16}"}


def test_nearest_of_a_hot_base_without_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(14)
    spread = lambda n: np.stack([rng.uniform(-180, 180, n), rng.uniform(-89, 89, n)], axis=1)
    old = np.concatenate([rng.normal((37, 48), 1, (900, 2)), spread(200), np.repeat([[10.0, 10.0]], 50, axis=0), [[179.99, 1.0], [-60.0, 88.9]]])
    new = np.concatenate([rng.normal((37, 48), 1, (700, 2)), spread(60), np.repeat([[10.0, 10.0]], 9, axis=0), [[-179.99, 1.0], [120.0, 88.95]]])
    frame = lambda name, x: spark.createDataFrame([("s", 1, "b", f"{name}{n:04d}", float(p[0]), float(p[1])) for n, p in enumerate(x)], "source_id string, obs int, base_key string, id string, lon double, lat double")
    got = nearest.candidates(frame("o", old), frame("n", new)).collect()
    a, b = np.radians(old), np.radians(new)
    d = np.sin((a[:, None, 1] - b[None, :, 1]) / 2) ** 2 + np.cos(a[:, None, 1]) * np.cos(b[None, :, 1]) * np.sin((a[:, None, 0] - b[None, :, 0]) / 2) ** 2
    d = 2 * geo.EARTH * np.arcsin(np.sqrt(np.minimum(d, 1)))
    want = {(n, int(k)) for n, k in enumerate(d.argmin(axis=1))} | {(int(k), n) for n, k in enumerate(d.argmin(axis=0))}
    assert {(int(r.old_id[1:]), int(r.new_id[1:])) for r in got} == want and len(got) == len(want)
    assert all(abs(r.distance - d[int(r.old_id[1:]), int(r.new_id[1:])]) < 1e-3 for r in got)
    monkeypatch.setattr(nearest, "ALL_PAIRS", 10**9)
    assert nearest.candidates(frame("o", old[:30]), frame("n", new[:20])).count() == 600
    assert nearest.candidates(frame("o", old).limit(0), frame("n", new)).count() == 0


def test_clusters_join_chains(spark):
    step = math.degrees(40_000 / geo.MERCATOR_RADIUS)
    rows = [("s", 0, f"p{n:02d}", n * step, 0.0) for n in range(12)] + [("s", 0, "q", 90.0, 0.0), ("s", 1, "z", 0.0, 0.0)]
    got = {r.piece: r.cluster for r in areas.clusters(spark.createDataFrame(rows, "source_id string, obs long, piece string, lon double, lat double")).collect()}
    assert {got[f"p{n:02d}"] for n in range(12)} == {"p00"} and got["q"] == "q" and got["z"] == "z"


def test_links_and_times(spark):
    t = F.lit("a https://x.com/u/status/12). b https://t.me/s/chan/34, https://x.com/u/status/12). https://t.me/c/1/2")
    r = one(spark, u=text.urls(t), s=text.status_id(F.lit("https://www.twitter.com/u/status/12?x=1")), p=text.channel_post(F.lit("https://t.me/s/chan/34")), q=text.channel_post(F.lit("https://t.me/c/1")))
    assert r.u == ["https://x.com/u/status/12", "https://t.me/s/chan/34", "https://t.me/c/1/2"] and r.s == "12" and r.p == "chan/34" and r.q is None
    r = one(spark, a=text.precision(F.lit("2026-08-20T00:00:00Z")), b=text.precision(F.lit("2026-08-20T10:30:00")), c=text.parse_instant(F.lit("2026-08-20 noon")), d=text.parse_instant(F.lit("soon")), e=text.local_date(F.lit("2026-08-20 21:00:00").cast("timestamp")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("day", "minute", dt.datetime(2026, 8, 20), None, dt.date(2026, 8, 21))


def test_coordinates_and_labels(spark):
    r = one(spark, a=text.coordinates(F.lit("https://maps/@1.5,2.5 !3d48.5119856!4d37.7296144")), b=text.coordinates(F.lit("at 48.5° N, 37.7° E")), c=text.coordinates(F.lit("100.5, 45.25")), d=text.coordinates(F.lit("none")))
    assert tuple(r.a) == (48.5119856, 37.7296144) and tuple(r.b) == (48.5, 37.7) and tuple(r.c) == (45.25, 100.5) and r.d is None
    r = one(spark, a=text.target_label(F.lit("Will Russia capture the Railroad station in Pokrovsk by May?"), F.lit(""), F.lit("P")), b=text.target_label(F.lit("Will Russia capture Kupiansk by May?"), F.lit("if Russia captures the Kupiansk royal Café Alex located at 1.0"), F.lit("Kupiansk")), c=text.target_label(F.lit("Will Russia capture the Kupiansk by May?"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert (r.a, r.b, r.c) == ("Railroad station", "Royal Café Alex", "Kupiansk")


def test_market_status(spark):
    status = lambda closed, prices: text.market_status(F.lit(closed), text.settled_outcome(F.array(F.lit("Yes"), F.lit("No")), text.decode_list(F.lit(prices))))
    r = one(spark, a=status(False, "[]"), b=status(True, '["1","0"]'), c=status(True, '["0.4","0.6"]'), d=text.settled_outcome(F.array(F.lit("Yes"), F.lit("No")), F.array(F.lit("1"), F.lit("1"))), e=text.normal_city(F.lit("the city of  Chasiv  Yar (east), Donetsk once again")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("active", "resolved", "closed", "Yes", "Chasiv Yar")


def test_region_and_reconcile(spark):
    r = one(spark, a=events.near_region(F.lit("55.7558"), F.lit("37.6173")), b=events.near_region(F.lit("43.575"), F.lit("21.075")), c=events.near_region(F.lit("x"), F.lit("30")))
    assert (r.a, r.b, r.c) == (False, True, False)
    store = spark.createDataFrame([("a", dt.date(2026, 8, 1), "h"), ("b", dt.date(2026, 1, 1), "h")], "uuid string, event_date date, source_hash string")
    assert [r.uuid for r in events.reconcile(store, store.limit(0), F.lit("2026-05-25").cast("date")).collect()] == ["b"]
    new = spark.createDataFrame([("a", dt.date(2026, 8, 2), "new")], store.schema)
    assert {r.uuid: r.source_hash for r in events.upsert(store, new).collect()} == {"a": "new", "b": "h"}
    assert events.detect_changes(store, store, F.lit("2020-01-01").cast("date")).count() == 0


def test_events_csv_keeps_quoted_lines(spark, tmp_path):
    head = ";".join(f.split(" ")[0] for f in readers.EVENTS.split(", "))
    row = ';'.join(['2026-08-20', 'n', 'f', 'o', '48.5', '37.5', '', '"line one\nline; ""two"""', 'u', 'g', 'e', 'i', 'u', 'o', 'id-1'])
    (tmp_path / "e.csv").write_bytes(b"\xef\xbb\xbf" + f"{head}\n{row}\n".encode())
    r = readers.read_events_csv(spark, str(tmp_path / "e.csv")).collect()
    assert len(r) == 1 and r[0].Description == 'line one\nline; "two"' and r[0].Date == "2026-08-20" and r[0].Id == "id-1"


def test_kml(spark, tmp_path):
    (tmp_path / "k.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Style id="a"><LineStyle><color>80112233</color></LineStyle><PolyStyle><color>ff0000ff</color></PolyStyle></Style><StyleMap id="m"><Pair><key>normal</key><styleUrl>#a</styleUrl></Pair></StyleMap><Folder><name>Front</name><Placemark id="front-7"><name>x</name><Point><coordinates>30.5,48.5,0</coordinates></Point></Placemark><Placemark><name>short</name><LineString><coordinates>1,2</coordinates></LineString></Placemark></Folder><Folder><name>Other</name><Placemark><name>y</name><Point><coordinates>1,2</coordinates></Point></Placemark></Folder></Document></kml>')
    rows = readers.read_kml(spark, str(tmp_path / "k.kml"), include=["Front"]).collect()
    assert [(r.placemark_id, r.geometry_type, r.layer_key, r.label) for r in rows] == [("front-7", "point", "front", "Front")]
    assert readers.read_kml(spark, str(tmp_path / "k.kml"), include=["front"]).count() == 0 and readers.read_kml(spark, str(tmp_path / "k.kml"), exclude=["Front"]).first().name == "y"
    looks = {r.style_id: r for r in readers.read_kml_styles(spark, str(tmp_path / "k.kml")).collect()}
    assert looks["m"].fill_color == "#ff0000" and looks["m"].line_color == "#332211" and looks["m"].line_opacity == 0.502


def test_kml_as_a_tree(spark, tmp_path):
    mark = lambda n, shape, style="": f"<Placemark id='{n}'><name>{n}</name>{style and f'<styleUrl>{style}</styleUrl>'}{shape}</Placemark>"
    dot = "<Point><coordinates>1,2</coordinates></Point>"
    square = "<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0 1,1 0,0</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    deep = f"<MultiGeometry>{dot}<MultiGeometry>{dot}{square}<MultiGeometry>{dot}</MultiGeometry></MultiGeometry></MultiGeometry>"
    style = "<Style id='f'><PolyStyle><color>80112233</color></PolyStyle></Style><Style id='l'><LineStyle><color>40445566</color><width>x</width></LineStyle><PolyStyle><color>80112233</color></PolyStyle></Style><StyleMap id='m'><Pair><key>highlight</key><styleUrl>#f</styleUrl></Pair><Pair><key>normal</key><styleUrl>#l</styleUrl></Pair></StyleMap><StyleMap id='lost'><Pair><key>normal</key><styleUrl>#none</styleUrl></Pair></StyleMap>"
    top = f"<Folder><name> Top </name>{mark('a', dot, '#f')}<Folder><name>Inner</name>{mark('b', dot, '#m')}<Folder><name>Innermost</name>{mark('c', deep, '#lost')}</Folder></Folder></Folder>"
    plain = f"<Folder><name>Plain</name><Folder><name>Top</name>{mark('d', square)}</Folder></Folder>"
    (tmp_path / "t.kml").write_text(f'<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{style}{top}{plain}</Document></kml>')
    rows = readers.read_kml(spark, str(tmp_path / "t.kml")).collect()
    assert sorted((r.placemark_id, r.geometry_type, r.layer_key, r.label) for r in rows) == [("a", "point", "top-point", "Top (point)"), ("b", "point", "top-point", "Top (point)"), *[("c", "point", "top-point", "Top (point)")] * 3, ("c", "polygon", "top-polygon", "Top (polygon)"), ("d", "polygon", "plain", "Plain")]
    look = {r.placemark_id: (r.fill_color, r.fill_opacity, r.line_color, r.line_opacity, r.line_width, r.circle_color, r.circle_opacity) for r in rows}
    assert look == {"a": ("#332211", 0.502, "#332211", 0.502, 1.5, "#332211", 1.0), "b": ("#332211", 0.502, "#665544", 0.251, 1.5, "#332211", 1.0), "c": (None, None, None, 1.0, 1.5, None, 1.0), "d": (None, None, None, 1.0, 1.5, None, 1.0)}
    (tmp_path / "deep.kml").write_text(f'<kml><Document>{"<Folder><name>x</name>" * 11}{mark("e", dot)}{"</Folder>" * 11}</Document></kml>')
    try:
        readers.read_kml(spark, str(tmp_path / "deep.kml")).collect()
        raise AssertionError("deeper placemarks are lost")
    except Exception as error:
        assert "nested too deep" in str(error)


def test_search_payload_forms(spark, tmp_path):
    event = {"slug": "e", "title": "t", "markets": [{"id": "1", "outcomes": '["Yes","No"]'}, {"id": "2", "outcomes": "broken"}]}
    (tmp_path / "a.json").write_text(json.dumps([event]))
    (tmp_path / "b.json").write_text(json.dumps({"events": [event]}))
    m = markets.explode_events(readers.read_search(spark, str(tmp_path)))
    got = sorted((r.id, tuple(r.o)) for r in m.select("id", text.decode_list(F.col("outcomes")).alias("o")).collect())
    assert got == [("1", ("Yes", "No"))] * 2 + [("2", ())] * 2


def test_bodies_stored_once(spark):
    b = spark.createDataFrame([("a", "u/x.kml", None, bytearray(b"same")), ("b", "u/y", "application/json", bytearray(b"same")), ("b", "u/z", None, bytearray(b"other"))], "source_id string, url string, content_type string, body binary")
    bodies, links = readers.archive_bodies(b)
    assert bodies.count() == 2 and links.count() == 3


def test_history_and_book(spark):
    h = spark.createDataFrame([("t", "1.9", "0.5"), ("t", "x", "0.5"), ("t", "2", None)], "token string, t string, p string")
    assert [(r.t, r.p) for r in markets.clean_history(h).collect()] == [(1, 0.5)]
    cached = spark.createDataFrame([("t", 7, 0.1), ("u", 8, 0.2)], "token string, t long, p double")
    assert sorted((r.token, r.t) for r in markets.refreshed_history(cached, h).collect()) == [("t", 1), ("u", 8)]
    book = spark.createDataFrame([("t", "bid", 0.4, 10.0), ("t", "bid", 0.5, 10.0), ("t", "ask", 0.6, 5.0)], "token string, side string, price double, size double")
    d = {(r.side, r.price): (r.total, r.depth) for r in markets.depth(book).collect()}
    assert d[("bid", 0.5)] == (5.0, 5 / 9) and d[("bid", 0.4)] == (9.0, 1.0)
    assert abs(markets.spreads(book).first().spread - 0.1) < 1e-9


def test_simplify_and_tiles(spark):
    line = np.array([(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (3.0, 5.0)])
    assert len(tiles.simplify(line, 0.1, False)) == 3 and len(tiles.simplify(line, 0.0, False)) == 4
    assert math.isclose(tiles.tolerance(5), geo.WORLD / 32 / 8192) and tiles.tolerance(12) == 0.0
    ring = np.array([(0.0, 0.0), (1.0, 0.0), (1.0, 0.001), (0.0, 0.0)])
    assert len(tiles.simplify(ring, 5.0, True)) == 4


def test_empty_inputs(spark):
    f = spark.createDataFrame(features([{"obs": 0, "logical_key": "a", "content_hash": "1"}])).limit(0)
    assert diff.changes(f).count() == 0
    assert snapshots.run_status(spark.createDataFrame([], "source_id string, run_id long, observed_at timestamp, content_hash string")).count() == 0


FEATURE = "source_id string, obs long, feature_id string, logical_key string, layer_key string, content_hash string, confidence double, geometry_hash string, props_hash string, w double, s double, e double, n double"
SHAPE = "source_id string, feature_id string, kind string, rings array<array<struct<x: double, y: double>>>"


def diffed(spark, *rows):
    """rows: (obs, key, kind, rings as point lists, look) -> changes and pieces with their shapes."""
    feats, shapes = [], []
    for obs, key, kind, rings, look in rows:
        xs, ys = [x for r in rings for x, _ in r], [y for r in rings for _, y in r]
        i = f"{key}@{obs}"
        feats.append(("s", obs, i, key, "control", f"{kind}{rings}{look}", 1.0, f"{kind}{rings}", look, *map(float, (min(xs), min(ys), max(xs), max(ys)))))
        shapes.append(("s", i, kind, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]))
    changed, found = diff.material_changes(spark.createDataFrame(feats, FEATURE), spark.createDataFrame(shapes, SHAPE))
    return sorted((r.logical_key, r.change_type, round(r.confidence, 2)) for r in changed.collect()), found


def rect(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n)]


def test_rotated_polygon_id_is_one_modified_change(spark):
    changed, found = diffed(spark, (0, "old-global-id", "polygon", [rect(35.8, 47.5, 35.9, 47.6)], ""), (1, "new-global-id", "polygon", [rect(35.8, 47.5, 35.91, 47.6)], ""))
    assert changed == [("new-global-id", "modified", 0.9)]
    assert [(p.phase, round(p.w, 6), round(p.e, 6)) for p in found.collect()] == [("after", 35.9, 35.91)]
    # Boxes that overlap are not enough: a triangle covers half of its box.
    changed, _ = diffed(spark, (0, "a", "polygon", [rect(35.8, 47.5, 35.9, 47.6)], ""), (1, "b", "polygon", [[(35.8, 47.5), (35.9, 47.5), (35.8, 47.6)]], ""))
    assert [c[:2] for c in changed] == [("a", "removed"), ("b", "added")]


def test_hairline_moves_of_polygons_go_and_moves_of_points_and_lines_stay(spark):
    old = rect(35.8, 47.5, 36.0, 47.6)
    changed, found = diffed(
        spark,
        (0, "hair", "polygon", [old], ""), (1, "hair", "polygon", [rect(35.8, 47.4998, 36.0, 47.6)], "painted"),
        (0, "edge", "polygon", [rect(45.8, 47.5, 46.0, 47.6)], ""), (1, "edge", "polygon", [rect(45.8, 47.51, 46.0, 47.6)], ""),
        (0, "dot", "point", [[(1, 1), (2, 2)]], ""), (1, "dot", "point", [[(1, 1), (2, 2.0001)]], ""),
        (0, "way", "line", [[(0, 0), (1, 0), (2, 0)]], ""), (1, "way", "line", [[(0, 0), (1, 0), (1, 1)]], ""),
        (0, "back", "line", [[(5, 5), (6, 5)]], ""), (1, "back", "line", [[(6, 5), (5, 5)]], ""),
        (0, "look", "polygon", [rect(55.8, 47.5, 56.0, 47.6)], ""), (1, "look", "polygon", [rect(55.8, 47.5, 56.0, 47.6)], "painted"),
        (0, "kind", "point", [[(9, 9)]], ""), (1, "kind", "line", [[(9, 9), (9.5, 9)]], ""),
    )
    assert [c[0] for c in changed] == ["dot", "edge", "kind", "look", "way"]
    got = sorted((p.logical_key, p.phase, p.kind, round(p.w, 4), round(p.s, 4), round(p.e, 4), round(p.n, 4)) for p in found.collect())
    assert got == [
        ("dot", "after", "point", 2, 2.0001, 2, 2.0001), ("dot", "before", "point", 2, 2, 2, 2), ("edge", "before", "polygon", 45.8, 47.5, 46.0, 47.51),
        ("kind", "after", "line", 9, 9, 9.5, 9), ("kind", "before", "point", 9, 9, 9, 9), ("look", "style", "polygon", 55.8, 47.5, 56.0, 47.6),
        ("way", "after", "line", 1, 0, 1, 1), ("way", "before", "line", 1, 0, 2, 0),
    ]


def test_a_change_of_several_parts_falls_into_pieces_and_areas(spark):
    two = [rect(10, 10, 10.1, 10.1), rect(14, 10, 14.1, 10.1)]
    moved = [rect(10, 10, 10.2, 10.1), rect(14, 10, 14.2, 10.1)]
    changed, found = diffed(spark, (0, "m", "polygon", two, ""), (1, "m", "polygon", moved, ""), (1, "new", "polygon", [rect(10.2, 10.3, 10.3, 10.4), rect(20, 10, 20.1, 10.1)], ""), (0, "ring", "polygon", [rect(30, 10, 31, 11), rect(30.2, 10.2, 30.8, 10.8)], ""))
    assert [c[:2] for c in changed] == [("m", "modified"), ("new", "added"), ("ring", "removed")]
    clustered = areas.clusters(found.withColumn("piece", F.concat_ws("|", "logical_key", "phase", F.round("w", 3).cast("string"))))
    out = areas.change_areas(clustered).orderBy("ordinal").collect()
    assert [(a.added, a.removed, a.modified, a.n_members, round(a.w, 3), round(a.e, 3)) for a in out] == [(1, 0, 1, 2, 10.1, 10.3), (0, 0, 1, 1, 14.1, 14.2), (1, 0, 0, 1, 20.0, 20.1), (0, 1, 0, 1, 30.0, 31.0)]
    assert areas.area_members(clustered).count() == 5
    hole = [p for p in found.collect() if p.logical_key == "ring"][0]
    assert not (30.2 < hole.lon < 30.8 and 10.2 < hole.lat < 10.8)


def test_pieces_are_cut_to_their_area(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    assert pieces.clip_ring(rect(-5, 2, 5, 4), box, True) == [[(0.0, 2.0), (5, 2), (5, 4), (0.0, 4.0)]] or sorted(pieces.clip_ring(rect(-5, 2, 5, 4), box, True)[0]) == sorted([(0.0, 2.0), (5, 2), (5, 4), (0.0, 4.0)])
    assert pieces.clip_ring([(-5, 5), (5, 5), (5, 15), (8, 15), (8, 5)], box, False) == [[(0.0, 5.0), (5, 5), (5.0, 10.0)], [(8.0, 10.0), (8, 5)]]
    assert pieces.clip_ring([(3, 3)], box, False) == [[(3, 3)]] and pieces.clip_ring([(-3, 3)], box, False) == [] and pieces.clip_ring(rect(20, 20, 30, 30), box, True) == []


def test_crowded_cells_are_linked_as_all_pairs_would(spark):
    rng = random.Random(3)
    pts = [("s", 0, n, rng.uniform(0, 3), rng.uniform(0, 3)) for n in range(250)] + [("s", 1, n, rng.uniform(0, 6), rng.uniform(0, 6)) for n in range(60)]
    got = {(r.obs, r.piece): r.cluster for r in areas.clusters(spark.createDataFrame(pts, "source_id string, obs long, piece long, lon double, lat double")).collect()}
    flat = lambda lon, lat: (math.radians(lon) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * 6378137.0)
    parent = {(o, n): (o, n) for _, o, n, _, _ in pts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (_, o, n, x, y) in enumerate(pts):
        for _, p, m, u, v in pts[:i]:
            if o == p and math.dist(flat(x, y), flat(u, v)) <= 50_000:
                a, b = root((o, n)), root((p, m))
                parent[max(a, b)] = min(a, b)
    assert got == {k: root(k)[1] for k in parent}
