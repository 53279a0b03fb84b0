import numpy as np
import pytest

from cinderline.operators import cells as R


def raster(spark, grid):
    return spark.createDataFrame([(x, y, int(v)) for (x, y), v in np.ndenumerate(np.array(grid)) if v >= 0], "cx long, cy long, value int")


def flood(grid, diagonal):
    grid, seen, out = np.array(grid), {}, 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for start, v in np.ndenumerate(grid):
        if start in seen or v < 0:
            continue
        out += 1
        stack = [start]
        while stack:
            p = stack.pop()
            if p in seen:
                continue
            seen[p] = out
            stack += [q for q in ((p[0] + a, p[1] + b) for a, b in steps) if 0 <= q[0] < grid.shape[0] and 0 <= q[1] < grid.shape[1] and grid[q] == v and q not in seen]
    return seen


SPIRAL = [
    [1, 1, 1, 1, 1, 1, 1], [0, 0, 0, 0, 0, 0, 1], [1, 1, 1, 1, 1, 0, 1], [1, 0, 0, 0, 1, 0, 1],
    [1, 0, 1, 1, 1, 0, 1], [1, 0, 0, 0, 0, 0, 1], [1, 1, 1, 1, 1, 1, 1],
]
CHECKS = [[(i + j) % 2 for j in range(6)] for i in range(6)]
MIXED = np.random.default_rng(2).integers(-1, 2, (20, 17)).tolist()


@pytest.mark.parametrize("grid", [SPIRAL, CHECKS, MIXED, [[3] * 5] * 5])
@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [3, 64])
def test_regions_match_a_flood_fill(spark, grid, connectivity, tile):
    got = {(r.cx, r.cy): r.region for r in R.raster_regions(raster(spark, grid), connectivity, tile=tile).collect()}
    want = flood(grid, connectivity == 8)
    assert got.keys() == want.keys()
    assert len({(got[p], want[p]) for p in got}) == len(set(got.values())) == len(set(want.values()))


def test_mask_and_boundary(spark):
    r = R.raster_regions(raster(spark, [[1, 1], [1, 1]]), 4, mask=raster(spark, [[1, 0], [1, 1]]))
    f = R.region_features(r).first()
    assert (f.n_cells, f.boundary_edges) == (3, 8)


def test_mosaic_ignores_order(spark):
    a, b = (raster(spark, g) for g in ([[1, 2], [-1, 4]], [[5, -1], [-1, 1]]))
    blank = R.blank(raster(spark, [[0, 0], [0, 0]]))
    p, q = ({(r.cx, r.cy): r.value for r in R.mosaic(l, blank).collect()} for l in ([a, b], [b, a]))
    assert p == q == {(0, 0): 6.0, (0, 1): 2.0, (1, 0): 0.0, (1, 1): 5.0}
