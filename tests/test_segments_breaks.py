import tracemalloc
from itertools import combinations

import numpy as np
import pytest

from cinderline.operators import breaks as B
from cinderline.operators import segments as E


def sse(v):
    return float(((v - v.mean()) ** 2).sum()) if len(v) else 0.0


def best_split(y, m, h):
    n = len(y)
    return min(
        sum(sse(y[a:b]) for a, b in zip((0, *c), (*c, n))) for c in combinations(range(1, n), m)
        if all(b - a >= h for a, b in zip((0, *c), (*c, n)))
    )


def test_mean_shifts_against_all_partitions():
    rng = np.random.default_rng(4)
    for jumps in ([], [8], [7, 15]):
        y = rng.normal(0, 1, 22)
        for j in jumps:
            y[j:] += 12
        got = E.mean_shifts(y)
        assert got == [j - 1 for j in jumps]
    y = rng.normal(0, 1, 22)
    n, h = 22, 3
    bic = [n * (np.log(best_split(y, m, h)) + 1 - np.log(n) + np.log(2 * np.pi)) + np.log(n) * 2 * (m + 1) for m in range(4)]
    assert len(E.mean_shifts(y)) == int(np.argmin(bic))


@pytest.mark.parametrize("n", [0, 1, 6, 7, 13, 14, 21, 60])
def test_mean_shifts_do_not_depend_on_the_block(n):
    rng = np.random.default_rng(n)
    for y in (rng.normal(0, 1, n), rng.integers(0, 3, n).astype(float), np.repeat(rng.normal(0, 9, n // 7 + 1), 7)[:n]):
        assert E.mean_shifts(y, cells=1) == E.mean_shifts(y, cells=150) == E.mean_shifts(y)


def test_long_series_in_linear_memory():
    y = np.random.default_rng(2).normal(0, 1, 6000) + 5 * (np.arange(6000) >= 2500)
    tracemalloc.start()
    assert E.mean_shifts(y) == [2499]
    assert tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()


def test_constant_series_has_no_break():
    assert E.mean_shifts(np.full(25, 3.0)) == []


def test_peak_growth(spark):
    pix = [2] * 10 + [20] * 7 + [3] * 10
    rows = [(1, d + 1, p, int(c), 27) for d, (p, c) in enumerate(zip(pix, np.cumsum(pix)))]
    rows += [(2, d + 1, 1, d + 1, 20) for d in range(20)] + [(3, d + 1, 1, d + 1, 25) for d in range(25)]
    df = spark.createDataFrame(rows, "id int, event_day int, pixels int, cum_pixels int, duration int")
    got = E.peak_growth(df).collect()
    assert [(r.id, r.pgp_fsr, r.pgp_duration, r.pgp_ba_pix, r.pgp_start, r.pgp_end) for r in got] == [(1, 20.0, 7, 140, 10, 17)]


@pytest.mark.parametrize("bins", [20000, 12])
def test_natural_breaks(spark, bins):
    rng = np.random.default_rng(8)
    v = np.round(np.concatenate([rng.normal(m, 1, 12) for m in (0, 20, 50)]), 3)
    got = B.natural_breaks(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 3, max_bins=bins).orderBy("class").collect()
    s = np.sort(v)
    best = min(combinations(range(1, len(s)), 2), key=lambda c: sum(sse(s[a:b]) for a, b in zip((0, *c), (*c, len(s)))))
    assert [r.lo for r in got] == [s[0], s[best[0]], s[best[1]]] and sum(r.n for r in got) == len(v)


@pytest.mark.parametrize("seed", [20, 24])
def test_natural_breaks_do_not_depend_on_the_limit(spark, seed):
    rng = np.random.default_rng(seed)
    v = np.round(rng.uniform(0, 100, 60), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    small, large = (B.natural_breaks(df, "v", 4, max_bins=b).orderBy("class").collect() for b in (6, 10**6))
    assert small == large
    s = np.sort(v)
    cost = np.array([[sse(s[a:b]) if b > a else np.inf for b in range(len(s) + 1)] for a in range(len(s) + 1)])
    best = cost[0]
    for _ in range(3):
        best = np.array([(best + cost[:, b]).min() for b in range(len(s) + 1)])
    got = sum(sse(s[(s >= r.lo) & (s <= r.hi)]) for r in small)
    assert got == pytest.approx(best[-1])


def test_natural_breaks_read_their_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    values = [(float(v),) for v in np.random.default_rng(2).lognormal(3, 1, 400)]
    got = B.natural_breaks(spark.createDataFrame(values, "v double").mapInPandas(seen, "v double"), "v", 3, max_bins=40).collect()
    assert len(got) == 3 and sum(r.n for r in got) == 400
    assert read.value == 400
