import math
import random

import numpy as np
import pytest

from cinderline.operators import overlay as O
from cinderline.operators import spatial as S

GEOM = "array<array<array<struct<x: double, y: double>>>>"


def frame(spark, polys, key="k"):
    """``{key: [part, ...]}`` with a part as a list of rings of points."""
    rows = [(k, None if g is None else [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in g]) for k, g in polys.items()]
    return spark.createDataFrame(rows, f"{key} long, geom {GEOM}")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def wobbly(rng, cx, cy, r, n):
    """A star-shaped ring; every second one runs clockwise."""
    ring = [(cx + r * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * i / n), cy + r * (0.6 + 0.4 * rng.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return ring if rng.random() < 0.5 else ring[::-1]


def crossings(ring, y):
    pts = [(a, b) for a, b in zip(ring, ring[1:] + ring[:1]) if (a[1] <= y) != (b[1] <= y)]
    return sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in pts)


def spans(geom, y):
    x = sorted(v for part in geom for ring in part for v in crossings(ring, y))
    return list(zip(x[::2], x[1::2]))


def common(a, b, y):
    return sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0])) for p in spans(a, y) for q in spans(b, y))


def brute_area(a, b):
    """Between all heights of ends and crossings the common width is linear, so its middle value times the height is exact."""
    edges = [(p, q) for g in (a, b) for part in g for r in part for p, q in zip(r, r[1:] + r[:1])]
    levels = {p[1] for p, _ in edges}
    for i, (p, q) in enumerate(edges):
        for r, s in edges[:i]:
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
                if 0 < t < 1:
                    levels.add(p[1] + t * (q[1] - p[1]))
    levels = sorted(levels)
    return sum((hi - lo) * common(a, b, (lo + hi) / 2) for lo, hi in zip(levels, levels[1:]))


def some_polygons(seed, n, extent=100.0):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        x, y, r = rng.uniform(0, extent), rng.uniform(0, extent), rng.choice([0.3, 4, 15, 40])
        part = [wobbly(rng, x, y, r, rng.randrange(3, 12))]
        if r > 10 and rng.random() < 0.6:
            part.append(wobbly(rng, x, y, r * 0.3, 5))  # inside: the outer ring keeps 0.6 of its radius at its corners only
        out[k] = [part] + ([[wobbly(rng, x + 3 * r, y, r / 2, 6)]] if rng.random() < 0.3 else [])
    return out


@pytest.mark.parametrize("tile", [7.0, 33.0, 1000.0])
def test_overlap_of_random_polygons(spark, tile):
    a, b = some_polygons(1, 25), some_polygons(2, 18)
    got = {(r.k, r.j): r.area for r in O.overlay(frame(spark, a), "k", frame(spark, b, "j"), "j", tile).collect()}
    want = {(k, j): s for k in a for j in b if (s := brute_area(a[k], b[j])) > 1e-6}
    assert got.keys() == want.keys()
    for pair, s in want.items():
        assert got[pair] == pytest.approx(s, rel=1e-9, abs=1e-7)


def test_tiny_and_touching_polygons(spark):
    """Polygons without a cell centre count; neighbours that share a border do not overlap; a layer overlaps itself by its own area."""
    a = {1: [[box(0, 0, 10, 10)]], 2: [[box(10, 0, 20, 10)]], 3: [[box(3.1, 3.1, 3.2, 3.3)]], 4: [[box(0, 10, 20, 12)]], 5: None, 6: [], 7: [[[]]]}
    df = frame(spark, a)
    for tile in (1.0, 4.0, 100.0):
        got = {(r.k, r.j): r.area for r in O.overlay(df, "k", frame(spark, a, "j"), "j", tile).collect()}
        want = {(1, 1): 100, (2, 2): 100, (3, 3): 0.02, (4, 4): 40, (1, 3): 0.02, (3, 1): 0.02}
        assert got == pytest.approx(want, rel=1e-9)


def test_two_sizes_are_both_exact(spark):
    """A 2.5 km and a 50 km square over a region with a hole, whatever the tile."""
    region = {9: [[box(0, 0, 300_000, 300_000), box(100_000, 100_000, 130_000, 130_000)]]}
    squares = {1: [[box(99_000, 99_000, 101_500, 101_500)]], 2: [[box(90_000, 90_000, 140_000, 140_000)]], 3: [[box(299_999, 5, 302_499, 2505)]]}
    for tile in (10_000.0, 200_000.0):
        got = {r.k: r.area for r in O.overlay(frame(spark, squares), "k", frame(spark, region, "j"), "j", tile).collect()}
        assert got == pytest.approx({1: 2500.0**2 - 1500.0**2, 2: 50_000.0**2 - 30_000.0**2, 3: 2500.0}, rel=1e-9)


def test_crowded_tile_is_dealt_over_tasks(spark, monkeypatch):
    a, b = some_polygons(3, 40, 20.0), some_polygons(4, 30, 20.0)
    whole = O.overlay(frame(spark, a), "k", frame(spark, b, "j"), "j", 1000.0)
    want = {(r.k, r.j): r.area for r in whole.collect()}
    monkeypatch.setattr(O, "_EDGES", 40)
    got = {(r.k, r.j): r.area for r in O.overlay(frame(spark, a), "k", frame(spark, b, "j"), "j", 1000.0).collect()}
    assert got == pytest.approx(want)


def test_covered_area_of_cells(spark):
    polys = some_polygons(5, 12)
    polys[100] = [[box(10, 10, 40, 35), box(15, 15, 20, 30)], [[(50, 50), (50, 60), (60, 50)]]]  # a hole, and a clockwise triangle
    polys[101] = [[box(-7, -7, -6.9, -6.8)]]
    size = 6.0
    got = {(r.k, r.cx, r.cy): r.area for r in O.cover_area(frame(spark, polys), "k", size, 1.0, 2.0).collect()}
    simple = {k: g for k, g in polys.items() if k >= 100 or len(g) == 1 and len(g[0]) == 1}
    for k, g in simple.items():
        pts = np.array([p for part in g for r in part for p in r])
        (cx0, cy0), (cx1, cy1) = np.floor((pts.min(0) - [1, 2]) / size).astype(int), np.floor((pts.max(0) - [1, 2]) / size).astype(int)
        for cx in range(cx0, cx1 + 1):
            for cy in range(cy0, cy1 + 1):
                want = brute_area(g, [[box(1 + cx * size, 2 + cy * size, 1 + (cx + 1) * size, 2 + (cy + 1) * size)]])
                assert got.get((k, cx, cy), 0.0) == pytest.approx(want, abs=1e-6)
    total = {r.k: r.s for r in frame(spark, polys).select("k", S.area("geom").alias("s")).collect()}
    for k in simple:
        assert sum(v for (i, _, _), v in got.items() if i == k) == pytest.approx(total[k], rel=1e-9)


def test_sweep_cuts_slabs_at_crossings():
    a = [[[(0, 0), (10, 10), (10, 0), (0, 10)]]]  # a bow tie
    b = [[[(0, 1), (10, 1), (10, 9), (0, 9)]]]
    edge = [(0, *p, *q, s) for s, g in enumerate((a, b)) for part in g for r in part for p, q in zip(r, r[1:] + r[:1])]
    cols = np.array(edge, float)
    got = O.sweep(cols[:, 0].astype(int), *cols[:, 1:5].T, cols[:, 5].astype(int), np.array([0.0]), np.array([10.0]), np.array([100.0]))
    assert got[0] == pytest.approx(brute_area(a, b))
