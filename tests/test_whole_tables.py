"""Queries on whole tables without SQL, against brute force; those with SQL are held in ``test_queries``."""

import math
from collections import Counter

import pytest

from cinderline.plans.catalog import load
from cinderline.sources import views as V

SF = "/root/testdata/sf0.001"
QUERIES = load()[0]


def test_every_road_is_measured(spark):
    size, want = 50000.0, Counter()
    for r in V.roads(spark, SF).collect():
        cuts = {0.0, 1.0}
        for a, b in ((r.x1, r.x2), (r.y1, r.y2)):
            if a != b:
                k = range(math.floor(min(a, b) / size), math.ceil(max(a, b) / size) + 1)
                cuts |= {t for t in ((i * size - a) / (b - a) for i in k) if 0 < t < 1}
        cuts = sorted(cuts)
        for s, t in zip(cuts, cuts[1:]):
            x, y = (a + (b - a) * (s + t) / 2 for a, b in ((r.x1, r.x2), (r.y1, r.y2)))
            want[math.floor(x / size), math.floor(y / size)] += math.hypot(r.x2 - r.x1, r.y2 - r.y1) * (t - s) / 1000
    got = {(r.cx, r.cy): r.km for r in QUERIES["line_length_per_cell_all"](spark, SF).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 1e-9}, abs=2e-6)


@pytest.mark.parametrize("near", [4, 8])
def test_regions_of_all_classes(spark, near):
    value = {(r.cx, r.cy): r.landcover % 4 for r in V.cells(spark, SF).collect()}
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (near == 8 or not (i and j))]
    seen, want = set(), []
    for start in sorted(value):
        if start in seen:
            continue
        seen.add(start)
        region, todo = [], [start]
        while todo:
            x, y = todo.pop()
            region.append((x, y))
            for p in ((x + i, y + j) for i, j in steps):
                if p not in seen and value.get(p) == value[start]:
                    seen.add(p)
                    todo.append(p)
        sides = sum((x + i, y + j) not in region for x, y in region for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        want.append((*start, value[start], len(region), sides))
    got = QUERIES[f"raster_regions_{near}_all"](spark, SF).select("rx", "ry", "value", "n_cells", "boundary_edges").collect()
    assert sorted(map(tuple, got)) == sorted(want)
