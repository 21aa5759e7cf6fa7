"""Overlays of many pairs at once against the helper that takes them one by one."""

import random

import pyarrow as pa
import pytest

from terradelta.operators import overlay

RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def batch(pairs):
    column = lambda k: pa.array([p[k] if p[k] is None else [[{"x": x, "y": y} for x, y in r] for r in p[k]] for p in pairs], RINGS)
    return pa.RecordBatch.from_arrays([pa.array([str(n) for n in range(len(pairs))]), column(0), column(1)], names=["pair_id", "old_rings", "new_rings"])


def box(w, s, e, n):
    return [[(w, s), (e, s), (e, n), (w, n)]]


def pieces(pairs):
    rows = [r for b in overlay.pieces_of(batch(pairs)) for r in b.to_pylist()]
    return sorted(rows, key=lambda r: (int(r["pair_id"]), r["phase"], r["w"], r["s"]))


def some_pairs(seed, n):
    rng = random.Random(seed)
    out = [(box(0, 0, 1, 1), box(0, 0, 1, 1)), ([], box(0, 0, 1, 1)), (None, None), (box(0, 0, 1, 0), box(0, 0, 1, 1)), (box(0, 0, 1, 1), box(1, 0, 2, 1)), (box(0, 0, 3, 3), box(1, 1, 2, 2)), (box(0, 0, 3, 3), box(1, 0, 2, 3))]
    for _ in range(n):
        at = [rng.choice((-70.0, 10.0, 47.5)) + rng.randint(0, 4) / 4 for _ in range(4)]
        a, b = (box(min(p), min(q), min(p) + rng.randint(1, 4) / 8, min(q) + rng.randint(1, 4) / 8) for p, q in ((at[:2], at[2:]), (at[2:], at[:2])))
        k = rng.randrange(4)
        b = b if k else box(a[0][0][0] + 0.125, a[0][0][1], a[0][1][0] + 0.125, a[0][2][1])
        out.append((a, [r[k:] + r[:k] for r in b]) if k < 3 else (a, [b[0] + [b[0][0]]]))
    return [*out, ([[(0, 0), (2, 0), (1, 2)]], box(0, 0, 1, 1)), (box(0, 0, 1, 1), [*box(2, 2, 3, 3), *box(4, 4, 5, 5)])]


def test_pieces_of_boxes_are_those_of_the_helper():
    """what makes a piece material (area, perimeter, radius) agrees for boxes in any place, for others, for none."""
    pairs = some_pairs(1, 120)
    mine = pieces(pairs)
    theirs = sorted(({"pair_id": str(n)} | p for n, (a, b) in enumerate(pairs) for p in overlay.difference_pieces(a or [], b or [])), key=lambda r: (int(r["pair_id"]), r["phase"], r["w"], r["s"]))
    assert [(r["pair_id"], r["phase"]) for r in mine] == [(r["pair_id"], r["phase"]) for r in theirs]
    for m, t in zip(mine, theirs, strict=True):
        assert [m[c] for c in "wsen"] == pytest.approx([t[c] for c in "wsen"], abs=2e-9)
        assert (m["area"], m["perimeter"]) == pytest.approx((t["area"], t["perimeter"]), rel=1e-5)
        assert m["radius"] == pytest.approx(t["radius"], rel=0.03)
        assert m["w"] <= m["lon"] <= m["e"] and m["s"] <= m["lat"] <= m["n"]


def test_moved_boxes_are_measured_at_once(monkeypatch):
    """no pair of boxes that are shifted gets to the helper (some 4 ms each)."""
    monkeypatch.setattr(overlay, "difference_pieces", lambda a, b: pytest.fail("one by one"))
    assert [r["phase"] for r in pieces([(box(k, 45, k + 0.1, 45.1), box(k + 0.01, 45, k + 0.11, 45.1)) for k in range(50)])] == ["after", "before"] * 50


def test_overlaid_boxes_keep_their_bounds_and_shape(monkeypatch):
    """pieces of boxes come with their bounds as given and one ring that covers them; slivers below rounding are none."""
    monkeypatch.setattr(overlay, "difference_pieces", lambda a, b: pytest.fail("one by one"))
    before, after = sorted(pieces([(box(30.05, 44.05, 30.15, 44.15), box(30.053, 44.05, 30.153, 44.15)), (box(0, 0, 1, 1), box(1e-14, 0, 1, 1))]), key=lambda r: r["w"])
    assert (before["phase"], before["w"], before["e"], before["s"], before["n"]) == ("before", 30.05, 30.053, 44.05, 44.15)
    assert (after["phase"], after["w"], after["e"]) == ("after", 30.15, 30.153)
    assert [(p["x"], p["y"]) for p in before["geometry"][0]] == box(30.05, 44.05, 30.053, 44.15)[0]


def test_overlaps_of_boxes_are_those_of_the_helper():
    """intersection over union, at once and one by one."""
    pairs = some_pairs(2, 120)
    mine = [r["overlap"] for b in overlay.overlaps_of(batch(pairs)) for r in b.to_pylist()]
    theirs = [overlay.overlap_ratio(a or [], b or []) for a, b in pairs]
    assert [m is None for m in mine] == [t is None for t in theirs]
    assert [m for m in mine if m is not None] == pytest.approx([t for t in theirs if t is not None], abs=1e-9)
