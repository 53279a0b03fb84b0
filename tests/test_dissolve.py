import random

from pyspark.sql import functions as F

from cinderline.operators import cells as R
from cinderline.operators import spatial as S
from cinderline.operators.dissolve import cycles, dissolve_polygons

GEOM = "array<array<array<struct<x: double, y: double>>>>"


def frame(spark, rows):
    """``(key, name, polygon)`` rows; a polygon is a list of parts, each a list of rings of points."""
    return spark.createDataFrame([(k, n, None if g is None else [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in g]) for k, n, g in rows], f"k int, name string, geom {GEOM}")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def shape(spark, rows):
    d = dissolve_polygons(frame(spark, rows), ["k"], tile=3.0, strip=4.0)
    return {r.k: r for r in d.collect()}


def signed(ring):
    return sum(a.x * b.y - b.x * a.y for a, b in zip(ring, ring[1:])) / 2


def test_ring_of_boxes_has_a_hole(spark):
    around = [(1, "a", [[box(x, y, x + 2, y + 2)]]) for x in (0, 2, 4) for y in (0, 2, 4) if (x, y) != (2, 2)]
    geom = shape(spark, around)[1].geom
    assert len(geom) == 1 and len(geom[0]) == 2
    assert [signed(r) for r in geom[0]] == [36, -4]
    assert all(r[0] == r[-1] for r in geom[0])


def test_border_with_vertices_of_one_side_only(spark):
    rows = [(1, "a", [[box(0, 0, 6, 3)]]), (1, "b", [[box(0, 3, 2, 5)]]), (1, "c", [[box(2, 3, 6, 5)[::-1]]]), (2, "d", [[box(0, 0, 1, 1)]])]
    out = shape(spark, rows)
    assert [signed(r) for p in out[1].geom for r in p] == [30]
    assert [signed(r) for p in out[2].geom for r in p] == [1]


def test_touching_in_a_point_and_island_in_a_hole(spark):
    touching = [(1, "a", [[box(0, 0, 1, 1)]]), (1, "b", [[box(1, 1, 2, 2)]])]
    nested = [(2, "c", [[box(0, 0, 10, 10), box(1, 1, 9, 9)]]), (2, "d", [[box(3, 3, 7, 7), box(4, 4, 5, 5)]])]
    out = shape(spark, touching + nested)
    assert [len(p) for p in out[1].geom] == [1, 1]
    assert sorted([signed(r) for r in p] for p in out[2].geom) == [[16, -1], [100, -64]]


def test_random_cells_keep_area_and_border(spark):
    rng = random.Random(5)
    taken = {(x, y): rng.randrange(3) for x in range(14) for y in range(14) if rng.random() < 0.9}
    rows = [(k, f"{x},{y}", [[box(x, y, x + 1, y + 1)[:: rng.choice((1, -1))]]]) for (x, y), k in taken.items()]
    out = shape(spark, rows)
    for k in range(3):
        own = {c for c, v in taken.items() if v == k}
        rings = [r for p in out[k].geom for r in p]
        assert sum(signed(r) for r in rings) == len(own)
        assert sum(abs(a.x - b.x) + abs(a.y - b.y) for r in rings for a, b in zip(r, r[1:])) == sum((x + dx, y + dy) not in own for x, y in own for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert all(signed(p[0]) > 0 and all(signed(h) < 0 for h in p[1:]) for p in out[k].geom)
        for p in out[k].geom:  # a hole's corners are within its shell's box
            xs, ys = [v.x for v in p[0]], [v.y for v in p[0]]
            assert all(min(xs) <= v.x <= max(xs) and min(ys) <= v.y <= max(ys) for h in p[1:] for v in h)


def test_null_empty_repeated_and_clashing(spark):
    rows = [(None, "a", [[box(0, 0, 1, 1)]]), (None, "b", [[box(1, 0, 2, 1)]]), (1, "c", None), (2, "d", []), (3, "e", [[box(0, 0, 1, 1)]]), (3, "f", [[box(0, 0, 1, 1)]])]
    out = shape(spark, rows)
    assert set(out) == {None, 3}
    assert [signed(r) for r in out[None].geom[0]] == [2] and [signed(r) for r in out[3].geom[0]] == [1]
    named = frame(spark, rows).withColumnsRenamed({"k": "id", "name": "x1"})
    assert dissolve_polygons(named.withColumn("g", F.lit(1)), ["id", "g"]).columns == ["id", "g", "geom"]
    assert dissolve_polygons(frame(spark, rows).limit(0), ["k"]).count() == 0


def test_cycles_of_a_permutation(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 300)
    following, where = {}, {}
    for n in (1, 2, 3, 64, 65, 165):
        ring, ids = ids[:n], ids[n:]
        first = ring.index(min(ring))
        following.update(zip(ring, ring[1:] + ring[:1]))
        where.update({v: (min(ring), (first - i) % n) for i, v in enumerate(ring)})
    got = cycles(spark.createDataFrame(list(following.items()), "id long, ptr long")).collect()
    assert {r.id: (r.cycle, r.ahead) for r in got} == where


def test_labels_of_a_long_chain_and_a_hub(spark):
    order = list(range(3000))
    random.Random(1).shuffle(order)
    chain = list(zip(order, order[1:]))
    hub = [(10_000 + i, 9_999) for i in range(2000)] + [(None, 5), (7_777, 7_777)]
    got = {r.node: r.label for r in R.label_components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert all(got[v] == 0 for v in order) and all(got[a] == 9_999 for a, _ in hub[:2000])
    assert got[7_777] == 7_777 and None not in got and len(got) == 3000 + 2001 + 1


def test_serpentine_over_many_tiles(spark):
    n = 64
    path = [(x, y) for y in range(0, n, 2) for x in range(n)] + [(n - 1 if y % 4 == 1 else 0, y) for y in range(1, n, 2)]
    cells = spark.createDataFrame([(x, y, 1) for x, y in path], "cx long, cy long, value int")
    assert R.raster_regions(cells, tile=4).select("region").distinct().count() == 1
