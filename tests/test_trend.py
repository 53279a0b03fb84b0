from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest

from cinderline.operators import columnslopes as S
from cinderline.operators import pairslopes as P
from cinderline.operators import trend as T


def brute(x, y):
    s = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in combinations(sorted(zip(x, y)), 2) if a[0] != b[0]]
    nz = np.array([v for v in s if v != 0])
    mag = np.abs(nz)
    rank = np.array([(mag < m).sum() + ((mag == m).sum() + 1) / 2 for m in mag])
    return np.median(s), rank[nz > 0].sum()


def frame(spark, groups):
    return spark.createDataFrame([(g, float(a), float(b)) for g, (x, y) in groups.items() for a, b in zip(x, y)], "g string, x double, y double")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(5)
    years = rng.integers(2001, 2012, 160)
    return {
        "noise": (years, rng.lognormal(0, 1, 160)),
        "ties": (years, rng.integers(0, 5, 160)),
        "up": (years, years * 0.5 + rng.normal(0, 1, 160)),
        "flat": (years[:30], np.ones(30)),
        "short": ([1, 2, 3], [1.0, 5.0, 2.0]),
        "same_x": ([1, 1], [1.0, 2.0]),
    }


def test_direct_fit(spark, groups):
    got = {r.g: r for r in T.theil_sen(frame(spark, groups), ["g"], "x", "y").collect()}
    for g in ("noise", "ties", "up", "short"):
        slope, v = brute(*groups[g])
        assert (got[g].slope, got[g].v) == pytest.approx((slope, v))
    assert got["flat"].slope == 0 and got["flat"].p is None
    assert got["same_x"].slope is None and got["same_x"].n == 2
    assert got["up"].p < 1e-6


def test_large_groups_agree_with_direct(spark, groups):
    df = frame(spark, {k: groups[k] for k in ("ties", "up")})
    direct = {r.g: r for r in T.theil_sen(df, ["g"], "x", "y").collect()}
    for r in T.theil_sen(df, ["g"], "x", "y", direct_points=8, chunk=16, gather=200, p_tol=1e-3).collect():
        d = direct[r.g]
        assert (r.n, r.n_slopes, r.slope, r.intercept) == pytest.approx((d.n, d.n_slopes, d.slope, d.intercept))
        assert abs(r.p - d.p) <= r.p_error + 1e-12 and r.p_error <= 1e-3


def test_inversions_and_residuals_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 64, 100):
        r, w = rng.permutation(n), rng.integers(1, 4, n).astype(float)
        assert P.inversions(r, w) == sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if r[j] < r[i])
    x, y, t = rng.normal(2000, 10, 50), rng.normal(0, 1e-3, 50), 1 / 3
    for a, b, hi, lo in zip(x, y, *P.residual(x, y, t)):
        assert abs(Fraction(hi) + Fraction(lo) - (Fraction(b) - Fraction(t) * Fraction(a))) < 1e-28


@pytest.mark.parametrize("kind", ["continuous", "ties", "years", "line", "repeats"])
def test_slope_counts_by_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    x, y = rng.normal(0, 1, 300), rng.normal(0, 1, 300)
    if kind == "ties":
        x, y = rng.integers(0, 12, 300).astype(float), rng.integers(0, 6, 300).astype(float)
    elif kind == "years":
        x = rng.integers(2001, 2005, 300).astype(float)
    elif kind == "line":
        y = np.arange(300.0) / 10
        x = 2 * y
    elif kind == "repeats":
        x, y = np.repeat(x[:40], 7), np.repeat(y[:40], 7)
    df = frame(spark, {"g": (x, y)})
    blocks, groups = P.slope_blocks(T._points(df, ["g"], "x", "y").withColumnRenamed("g", "__g"), 16)
    s = np.array([(b[1] - a[1]) / (b[0] - a[0]) for a, b in combinations(sorted(zip(x, y)), 2) if a[0] != b[0]])
    ts = sorted({0.0, 1 / 3, -0.5, 0.5, 1e6, *np.quantile(s, [0.1, 0.5, 0.9]).tolist()})
    plan = spark.createDataFrame([("g", ts)], "__g string, ts array<double>")
    got = {r.t: (r["lt"], r["le"]) for r in P.count_slopes(blocks, groups, plan).collect()}
    close = lambda t: abs(s - t) <= 1e-14 * abs(t)
    assert got == {t: (((s < t) & ~close(t)).sum(), ((s <= t) | close(t)).sum()) for t in ts}


@pytest.mark.parametrize("gather", [50, 10**6])
def test_continuous_x_agrees_with_direct(spark, gather):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, 400)
    df = frame(spark, {"a": (x, x * 0.1 + rng.normal(0, 1, 400)), "b": (np.append(x, 1e6), np.append(rng.normal(0, 1, 400), 3.0)), "one_x": ([1] * 9, range(9))})
    direct = {r.g: r for r in T.theil_sen(df, ["g"], "x", "y").collect()}
    for r in T.theil_sen(df, ["g"], "x", "y", direct_points=5, chunk=32, gather=gather, p_tol=1e-2).collect():
        d = direct[r.g]
        assert (r.n, r.n_slopes, r.slope, r.intercept) == pytest.approx((d.n, d.n_slopes, d.slope, d.intercept))
        assert d.p is None and r.p is None or abs(r.p - d.p) <= r.p_error + 1e-12 and r.p_error <= 1e-2


def test_equivariance(spark, groups):
    x, y = groups["noise"]
    a, b = (T.theil_sen(frame(spark, {"g": (x, v)}), ["g"], "x", "y").first() for v in (y, 3 * y + 2 * x + 7))
    assert b.slope == pytest.approx(3 * a.slope + 2)


def test_repeated_medians_resist_an_outlier(spark):
    x = np.arange(9.0)
    y = 2 * x + 1
    y[4] = 500
    r = T.repeated_medians(frame(spark, {"g": (x, y)}), ["g"], "x", "y").first()
    assert (r.slope, r.intercept) == pytest.approx((2.0, 1.0))


@pytest.mark.parametrize("exact_slopes", [0, 10**6])
def test_columns_of_years_agree_with_direct(spark, groups, exact_slopes, monkeypatch):
    rng = np.random.default_rng(12)
    years, v = rng.integers(2001, 2008, 300), np.round(rng.lognormal(0, 1, 300), 2)
    z = lambda t: abs(T._fit_points(years[:60], v[:60] + t * years[:60], np.ones(60))[5])
    near = min(np.linspace(-0.2, 0.2, 200), key=z)
    cases = {k: groups[k] for k in ("noise", "ties", "up")} | {"repeats": (np.repeat(years, 3), np.repeat(v, 3)), "near": (years[:60], v[:60] + near * years[:60])}
    df = frame(spark, cases)
    direct = {r.g: r for r in T.theil_sen(df, ["g"], "x", "y").collect()}
    for work in (T.TASK_SLOPES, 1500):  # 1500: the test runs in tasks by magnitudes
        monkeypatch.setattr(T, "TASK_SLOPES", work)
        monkeypatch.setattr(T, "TASKS", 8)
        for r in T.theil_sen(df, ["g"], "x", "y", direct_points=8, exact_slopes=exact_slopes).collect():
            d = direct[r.g]
            assert (r.n, r.n_slopes, r.slope, r.intercept) == pytest.approx((d.n, d.n_slopes, d.slope, d.intercept), rel=1e-14)
            assert abs(r.p - d.p) <= r.p_error + 1e-12 and r.p_error <= 1e-8
            if exact_slopes:
                assert (r.v, r.z, r.p, r.p_error) == pytest.approx((d.v, d.z, d.p, 0), rel=1e-12)


def test_column_batches_by_brute_force():
    rng = np.random.default_rng(4)
    for y in (np.round(rng.lognormal(3, 1, 120), 2), rng.integers(-3, 4, 120).astype(float)):
        x = rng.integers(1995, 2002, 120).astype(float)
        (x, y), w = np.unique(np.stack([x, y]), axis=1, return_counts=True)
        for w in (np.ones(len(x)), w.astype(float)):
            cols, want = S.Columns(x, y, w), T._fit_points(x, y, w)
            guide = np.sort(np.abs(cols.sample()))
            for batch in (90, 1000, 10**6):
                pos, _, cross, room, ties, _ = S.exact(cols, 0.0, np.inf, guide[guide > 0], batch)
                assert (S.median(cols, batch), pos * (pos + 1) / 2 + cross, room) == pytest.approx((want[2], want[4], 0), rel=1e-14)
            parts = [T._measure(cols, 40, i, 3) for i in range(3)]
            cross, room = S.joined(parts)[2:4]
            assert 0 <= want[4] - pos * (pos + 1) / 2 - cross <= room


@pytest.mark.parametrize("cells", [1, 2, 5, 64, 3000])
def test_cells_bound_the_test_statistic(cells):
    rng = np.random.default_rng(6)
    for k in range(30):
        x = rng.choice([0.0, 1.0, 1.5, 3.0, 7.25], 60)
        y = np.round(rng.normal(0, 3, 60), k % 3)
        (x, y), w = np.unique(np.stack([x, y]), axis=1, return_counts=True)
        cols = S.Columns(x, y, w if k % 2 else np.ones(len(x)))
        pos, neg, cross, _, ties, _ = S.exact(cols, 0.0, np.inf, np.sort(np.abs(cols.sample())))
        up, down, sure, room, _, loose = S.blurred(cols, cells)
        assert (up, down) == (pos, neg) and sure <= cross <= sure + room and ties <= loose


def test_equal_magnitudes_of_both_signs():
    rng = np.random.default_rng(8)
    for digits in (0, 1, 9):
        p, q = (np.round(np.abs(rng.normal(0, 2, n)), digits) + 0.5 for n in (40, 50))
        u, d, cross, ties = S._crossings(p, None, -q, None)
        _, size = np.unique(np.concatenate((p, q)), return_counts=True)
        assert (u, d, ties) == (40, 50, (size**3 - size).sum())
        assert cross == (p[:, None] > q).sum() + (p[:, None] == q).sum() / 2


def test_clear_trends_are_settled_without_the_slopes(monkeypatch):
    """What made tests of larger groups slow: thresholds looked up for every point, and all slopes listed."""
    rng = np.random.default_rng(10)
    x = rng.integers(2001, 2008, 3000).astype(float)
    cols = S.Columns(x, rng.normal(0, 1, 3000) + 0.05 * x, np.ones(3000))
    zero = np.zeros(1)
    pos, neg = cols.total - float(cols.count(zero)[0]), float(cols.count(zero, strict=True)[0])
    *_, exact_p, _, _ = T._judge(pos, neg, cols.total, T._measure(cols, 0), 0, 1e-6)
    monkeypatch.setattr(T, "_measure", None)
    _, _, p, p_error = T._by_cells(cols, pos, neg, 1e-6)
    assert abs(p - exact_p) <= p_error <= 1e-8


def test_weighted_slopes_are_ranked_without_sorting_them_by_reference(monkeypatch):
    """What made the exact test of weighted groups slow: every batch went through ``np.unique`` with its inverse."""
    rng = np.random.default_rng(11)
    for k, draw in enumerate([lambda n: rng.random(n) + 1e-9, lambda n: rng.integers(1, 9, n) * 1.0, lambda n: 1.5 + rng.integers(1, 30, n) * 2.0**-52, lambda n: np.exp(rng.normal(0, 100, n))] * 5):
        p, q, wp, wq = draw(50 + k), draw(40), rng.integers(1, 9, 50 + k) * 1.0, rng.integers(1, 9, 40) * 1.0
        mag, at = np.unique(np.concatenate((p, q)), return_inverse=True)
        size = np.bincount(at, np.concatenate((wp, wq)))
        above = (wp[:, None] * wq * ((p[:, None] > q) + (p[:, None] == q) / 2)).sum()
        with monkeypatch.context() as m:
            m.setattr(np, "unique", None)
            assert S._crossings(p, wp, -q, wq) == (wp.sum(), wq.sum(), above, (size**3 - size).sum())


def test_trends_read_their_rows_once(spark):
    """What made trends of joined points slow: the join ran for the counts, the groups with enough rows and the fits."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    rng = np.random.default_rng(12)
    rows = [("a", int(2001 + i % 7), float(v)) for i, v in enumerate(rng.normal(0, 1, 100))] + [(None, 2001, 1.0)] * 3
    df = spark.createDataFrame(rows, "g string, x int, y double").mapInPandas(seen, "g string, x int, y double")
    got = {r.g: r for r in T.metric_trends(df, ["g"], "x", {"m": "y"}).collect()}
    assert read.value == 103 and got["a"].n == 100 and got["a"].m_trend is not None and got[None].n == 3 and got[None].m_trend is None


def test_larger_groups_have_the_exact_test_too(spark):
    """What made results change with the input's size: beyond 40 million pairs the statistic was the middle of bounds."""
    n, up = 6400, 500.5
    rows = spark.range(2 * n).selectExpr("'g' as g", "cast(id % 2 as double) as x", f"floor(id / 2) + if(id % 2 = 1, {up}, 0) as y")
    r = T.theil_sen(rows, ["g"], "x", "y").first()
    slopes, count = np.arange(1 - n, n) + up, n - np.abs(np.arange(1 - n, n))
    mag, at = np.unique(np.abs(slopes), return_inverse=True)
    size = np.bincount(at, count).astype(int)
    rank = np.cumsum(size) - size + (size + 1) / 2
    v = sum(int(2 * rank[a]) * int(c) for a, c, s in zip(at, count, slopes) if s > 0) / 2
    assert (r.n_slopes, r.slope, r.v, r.p_error) == (n * n, up, v, 0)
    assert r.z == pytest.approx(T.signed_rank_z(v, n * n, float((size**3 - size).sum())), rel=1e-12)


def test_packed_weights_are_ranked_as_by_reference(monkeypatch):
    """What made the exact test of weighted groups slow: weights were fetched by position after the sort."""
    rng = np.random.default_rng(13)
    monkeypatch.setattr(S, "PIECE", 16)
    for k, digits in enumerate((0, 1, 9, 0)):
        x, y = rng.integers(0, 5, 90) * 1.0, np.round(rng.normal(0, 3, 90), digits)
        (x, y), w = np.unique(np.stack([x, y]), axis=1, return_counts=True)
        w = (w if k == 3 else rng.integers(1, 70, len(x)) if k else np.ones(len(x))).astype(float)
        cols, want = S.Columns(x, y, w), T._fit_points(x, y, w)
        s, ww = T.pair_slopes(x, y, w)
        _, at = np.unique(np.abs(s[s != 0]), return_inverse=True)
        size = np.bincount(at, ww[s != 0])
        with monkeypatch.context() as m:
            m.setattr(S, "_ranked_weights", None)
            pos = neg = cross = ties = 0.0
            # The least magnitudes span too many bits for one key with a weight; these intervals do not.
            edges = [2.0**e * (1 + j / 8) for e in range(-60, 8) for j in range(8)]
            for lo, hi in zip(edges, edges[1:]):
                u, d, c, _, t, _ = S.exact(cols, lo, hi, np.empty(0))
                pos, neg, cross, ties = pos + u, neg + d, cross + c + u * neg, ties + t
        assert (pos * (pos + 1) / 2 + cross, ties, pos + neg) == (want[4], (size**3 - size).sum(), size.sum())


def test_groups_of_many_x_have_the_exact_test_too(spark, monkeypatch):
    """Beyond a number of points the statistic of groups whose ``x`` takes many values was the middle of bounds, too."""
    rng = np.random.default_rng(14)
    x = rng.normal(0, 1, 150)
    cases = {"free": (x, rng.normal(0, 1, 150)), "grid": (rng.integers(0, 90, 300), rng.integers(0, 4, 300)), "flat": (x, np.ones(150)), "one_x": ([1] * 9, range(9))}
    df = frame(spark, cases)
    direct = {r.g: r for r in T.theil_sen(df, ["g"], "x", "y").collect()}
    for listed, held in ((T.LISTED, T.HELD), (700, 400)):
        monkeypatch.setattr(T, "LISTED", listed)
        monkeypatch.setattr(T, "HELD", held)
        monkeypatch.setattr(T, "TASKS", 8)
        for r in T.theil_sen(df, ["g"], "x", "y", direct_points=5, chunk=32, p_tol=1e-2).collect():
            d = direct[r.g]
            assert (r.n, r.v, r.p is None, r.p_error) == (d.n, d.v, d.p is None, 0)
            assert r.p is None or (r.z, r.p) == pytest.approx((d.z, d.p), rel=1e-12)
