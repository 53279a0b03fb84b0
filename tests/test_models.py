import numpy as np
import pytest

from cinderline.operators import mixed as X
from cinderline.operators import models as M
from cinderline.operators import ranktests as K


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    rows = []
    for j, g in enumerate("abcdefgh"):
        x = rng.uniform(0, 10, 8 + 3 * j)
        y = 1 + j * 0.7 + (0.5 + 0.1 * rng.normal()) * x + rng.normal(0, 1, len(x))
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double")


def design(rows):
    levels = sorted({g for g, *_ in rows})
    g = np.array([levels.index(r[0]) for r in rows])
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    return levels, g, x, y


def test_interaction_matches_dense_least_squares(spark, data):
    rows, df = data
    levels, g, x, y = design(rows)
    d = np.column_stack([np.ones_like(x), x] + [(g == k) * 1.0 for k in range(1, len(levels))] + [(g == k) * x for k in range(1, len(levels))])
    beta, *_ = np.linalg.lstsq(d, y, rcond=None)
    rss = ((y - d @ beta) ** 2).sum()
    se = np.sqrt(np.diag(np.linalg.inv(d.T @ d)) * rss / (len(y) - d.shape[1]))
    fit = M.interaction_levels(df, [], "g", "x", "y")
    s = M.interaction_glance(fit, []).first()
    assert s.r_squared == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    assert (s.df, s.df_residual) == (d.shape[1] - 1, len(y) - d.shape[1])
    got = {r.term: r for r in M.interaction_tidy(fit, [], "g", "x").collect()}
    names = ["(Intercept)", "x"] + [f"g{l}" for l in levels[1:]] + [f"x:g{l}" for l in levels[1:]]
    for n, b, e in zip(names, beta, se):
        assert (got[n].estimate, got[n].std_error) == pytest.approx((b, e))


def test_constant_x_has_no_slope(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("b", 1.0, None)], "g string, x double, y double")
    r = M.ols(df, ["g"], "x", "y").collect()
    assert len(r) == 1 and r[0].slope is None and r[0].intercept == 3.0
    assert M.glance(M.ols(df, ["g"], "x", "y")).first().df == 0


def reml(theta, rows, slope):
    _, g, x, y = design(rows)
    xm = np.column_stack([np.ones_like(x), (x - x.mean()) / x.std(ddof=1)])
    lam = np.array([[theta[0], 0], [theta[1], theta[2]]]) if slope else np.array([[theta[0], 0], [0, 0]])
    v = np.eye(len(y))
    for k in set(g):
        i = np.flatnonzero(g == k)
        v[np.ix_(i, i)] += xm[i] @ lam @ lam.T @ xm[i].T
    vi = np.linalg.inv(v)
    a = xm.T @ vi @ xm
    beta = np.linalg.solve(a, xm.T @ vi @ y)
    r = y - xm @ beta
    left = len(y) - 2
    s2 = r @ vi @ r / left
    return left * np.log(s2) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1], s2


@pytest.mark.parametrize("slope", [False, True])
@pytest.mark.parametrize("small", [10_000, 0])
def test_mixed_model_minimises_the_dense_criterion(spark, data, slope, small):
    rows, df = data
    q = 2 if slope else 1
    levels = X.level_sums(df, "g", "x", "y")
    evaluate, tol = X._evaluator(levels, q, small)
    theta = X._search(evaluate, q, tol)
    best, s2 = reml(theta, rows, slope)
    ours, _, sigma2, _ = X._solve(evaluate(theta[None, :])[0])
    assert (ours, sigma2) == pytest.approx((best, s2))
    rng = np.random.default_rng(0)
    for _ in range(40):
        assert reml(theta + rng.normal(0, 0.05, len(theta)), rows, slope)[0] >= best - 1e-4


def test_mixed_predictions_shrink_towards_the_common_line(spark, data):
    _, df = data
    m = X.mixed_model(df, "g", "x", "y")
    fixed = {r.term: r.estimate for r in m["fixed"].collect()}
    own = {r.g: r for r in M.ols(df, ["g"], "x", "y").collect()}
    for r in m["levels"].collect():
        assert r.slope == pytest.approx(fixed["x"])
        at = own[r.g].xbar
        assert abs(r.intercept - fixed["(Intercept)"]) <= abs(own[r.g].ybar - fixed["x"] * at - fixed["(Intercept)"]) + 1e-9


def balanced(spark, levels, x_of):
    rng = np.random.default_rng(3)
    rows = []
    for j in range(levels):
        shift = rng.normal(0, 2)
        rows += [(j, float(x_of(j, i)), float(1 + 0.3 * x_of(j, i) + shift + rng.normal())) for i in range(12)]
    return spark.createDataFrame(rows, "g int, x double, y double")


def test_degrees_of_freedom_of_balanced_designs(spark):
    """There the analysis of variance gives them: within levels N - levels - 1, between levels levels - 2."""
    within = X.mixed_model(balanced(spark, 9, lambda j, i: i - 5.5), "g", "x", "y")["fixed"].collect()
    assert [r.df for r in within] == pytest.approx([8, 9 * 12 - 9 - 1], rel=1e-4)
    between = X.mixed_model(balanced(spark, 9, lambda j, i: j - 4.0), "g", "x", "y")["fixed"].collect()
    assert [r.df for r in between] == pytest.approx([7, 7], rel=1e-4)


def test_levels_without_effect_leave_the_residual_degrees_of_freedom(spark):
    rows = [(j, float(i), float(i + (-1) ** (i // 2 + i))) for j in range(6) for i in range(20)]
    fixed = X.mixed_model(spark.createDataFrame(rows, "g int, x double, y double"), "g", "x", "y")["fixed"].collect()
    assert [r.df for r in fixed] == pytest.approx([118, 118], rel=1e-4)


@pytest.mark.parametrize("slope", [False, True])
def test_degrees_of_freedom_against_the_dense_criterion(spark, data, slope):
    """The covariance of the covariance parameters from second differences of the dense deviance."""
    rows, df = data
    _, g, x, y = design(rows)
    levels = X.level_sums(df, "g", "x", "y")
    evaluate, step = X._evaluator(levels, 2 if slope else 1, 10_000)
    theta = X._search(evaluate, 2 if slope else 1, step)
    z = (x - x.mean()) / x.std(ddof=1)
    xm = np.column_stack([np.ones_like(x), z])

    def dense(p):
        lam = np.array([[p[0], 0], [p[1], p[2]]]) if slope else np.array([[p[0], 0], [0, 0]])
        v = np.eye(len(y))
        for k in set(g):
            i = np.flatnonzero(g == k)
            v[np.ix_(i, i)] += xm[i] @ lam @ lam.T @ xm[i].T
        vi = np.linalg.inv(v * p[-1] ** 2)
        a = xm.T @ vi @ xm
        r = y - xm @ np.linalg.solve(a, xm.T @ vi @ y)
        return np.linalg.slogdet(v * p[-1] ** 2)[1] + np.linalg.slogdet(a)[1] + r @ vi @ r, np.linalg.inv(a)

    p = np.append(theta, np.sqrt(reml(theta, rows, slope)[1]))
    h, n = 2e-3, len(p)
    e = np.eye(n) * h
    hess = np.array([[(dense(p + e[i] + e[j])[0] - dense(p + e[i] - e[j])[0] - dense(p - e[i] + e[j])[0] + dense(p - e[i] - e[j])[0]) / (4 * h * h)
                      for j in range(n)] for i in range(n)])
    back = np.array([[1.0, -x.mean() / x.std(ddof=1)], [0.0, 1 / x.std(ddof=1)]])
    cov = lambda q: np.diag(back @ dense(q)[1] @ back.T)
    grad = np.array([(cov(p + e[i]) - cov(p - e[i])) / (2 * h) for i in range(n)]).T
    want = [2 * c * c / (d @ (2 * X._inverse(hess)) @ d) for c, d in zip(cov(p), grad)]
    got = X.mixed_model(df, "g", "x", "y", slope)["fixed"].collect()
    assert [r.df for r in got] == pytest.approx(want, rel=5e-3)


def test_kruskal(spark):
    rows = [("a", "x", v) for v in (1.0, 2.0, 3.0)] + [("a", "y", v) for v in (4.0, 5.0, 6.0)]
    rows += [("tied", c, 1.0) for c in "xy"] + [("single", "x", 1.0), ("single", "x", 2.0)]
    got = {r.g: r for r in K.kruskal(spark.createDataFrame(rows, "g string, c string, v double"), ["g"], "c", "v").collect()}
    assert got["a"].h == pytest.approx(3.857142857) and got["a"].p == pytest.approx(0.04953461)
    assert got["tied"].h is None and got["single"].h is None


@pytest.mark.parametrize("slope", [False, True])
def test_mixed_model_does_not_depend_on_the_limit(spark, data, slope):
    few, many = ({r.component: r.value for r in X.mixed_model(data[1], "g", "x", "y", slope, small_levels=n)["variance"].collect()} for n in (5, 10**6))
    assert few == pytest.approx(many, rel=1e-5)
