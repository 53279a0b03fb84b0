"""Linear mixed models with one grouping factor, fitted by REML on per-level sums.

Spark reduces every level to six sums. The likelihood of a candidate covariance is itself a
sum over levels; it is evaluated on the driver when a count shows that the levels are few, and as a
Spark aggregate over the level table otherwise, so levels are never collected unchecked.

Fixed effects are tested by t with the degrees of freedom of Satterthwaite (1946): the variance of an estimate is a function
of the covariance parameters, whose own covariance is twice the inverse Hessian of the REML criterion. All
derivatives are difference quotients of the same sums, one batch of candidates.
"""

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.functions.tails import student_two_sided
from cinderline.operators.keys import join_keys
from cinderline.sources.tables import cut_lineage

SMALL_LEVELS = 10_000
TOLERANCE = 1e-10
#: Steps of the difference quotients: this share of a parameter, or of 1 / sqrt(rows per level) if that is more.
STEP = 0.01
NEWTON_STEPS = 20
_SUMS = ["n", "sx", "sxx", "sy", "sxy", "syy"]


def level_sums(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    a, b = F.col("__x"), F.col("__y")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull()).select(
        group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")
    )
    # Centring on the overall means keeps the sums well scaled.
    mid = rows.agg(F.avg("__x").alias("mx"), F.avg("__y").alias("my"), F.stddev_samp("__x").alias("sd"))
    c = rows.crossJoin(F.broadcast(mid)).select(
        group, "mx", "my", "sd", ((a - F.col("mx")) / F.col("sd")).alias("__x"), (b - F.col("my")).alias("__y")
    )
    return c.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(a).alias("sx"), F.sum(a * a).alias("sxx"), F.sum(b).alias("sy"),
        F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"),
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("sd").alias("sd"),
    )


def _level_terms(pdf: pd.DataFrame, theta: np.ndarray, q: int):
    """Cross products of every level and the factor that shrinks them, for one candidate."""
    n, sx, sxx, sy, sxy, syy = (pdf[c].to_numpy() for c in _SUMS)
    a = np.stack([np.stack([n, sx], -1), np.stack([sx, sxx], -1)], -2)
    c = np.stack([sy, sxy], -1)
    lam = np.array([[theta[0]]]) if q == 1 else np.array([[theta[0], 0.0], [theta[1], theta[2]]])
    m = np.eye(q) + lam.T @ a[:, :q, :q] @ lam
    return a, c, syy, lam, m


def _criterion_sums(pdf: pd.DataFrame, thetas: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((len(thetas), 8))
    for k, theta in enumerate(thetas):
        a, c, syy, lam, m = _level_terms(pdf, theta, q)
        az, cz = a[:, :, :q] @ lam, c[:, :q] @ lam
        inv = np.linalg.inv(m)
        xvx = (a - az @ inv @ np.swapaxes(az, 1, 2)).sum(0)
        xvy = (c - np.einsum("jpq,jqr,jr->jp", az, inv, cz)).sum(0)
        yvy = (syy - np.einsum("jq,jqr,jr->j", cz, inv, cz)).sum()
        out[k] = [np.log(np.linalg.det(m)).sum(), xvx[0, 0], xvx[0, 1], xvx[1, 1], xvy[0], xvy[1], yvy, a[:, 0, 0].sum()]
    return out


def _solve(s: np.ndarray):
    xvx = np.array([[s[1], s[2]], [s[2], s[3]]])
    beta = np.linalg.solve(xvx, s[4:6])
    left = s[7] - 2
    sigma2 = max((s[6] - beta @ s[4:6]) / left, 1e-300)
    reml = left * np.log(sigma2) + s[0] + np.log(np.linalg.det(xvx))
    return reml, beta, sigma2, xvx


def _evaluator(levels: DataFrame, q: int, small: int):
    """How to evaluate candidates, and the step of their difference quotients."""
    step = STEP / np.sqrt(levels.agg(F.avg("n")).first()[0])
    if levels.limit(small + 1).count() <= small:
        local = levels.select(*_SUMS).toPandas()
        return lambda thetas: _criterion_sums(local, thetas, q), step

    def spread(thetas):
        def run(batches):
            for pdf in batches:
                s = _criterion_sums(pdf, thetas, q)
                yield pd.DataFrame({"k": range(len(thetas)), **{f"s{i}": s[:, i] for i in range(8)}})
        rows = levels.select(*_SUMS).mapInPandas(run, "k int, " + ", ".join(f"s{i} double" for i in range(8)))
        got = rows.groupBy("k").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(8)]).orderBy("k").collect()
        return np.array([[r[f"s{i}"] for i in range(8)] for r in got])

    return spread, step


def _quantities(s: np.ndarray) -> np.ndarray:
    """Criterion, its log-determinants, residual sum of squares, unscaled covariance of the fixed effects (00, 01, 11)."""
    reml, _, sigma2, xvx = _solve(s)
    inv = np.linalg.inv(xvx)
    return np.array([reml, s[0] + np.log(np.linalg.det(xvx)), sigma2 * (s[7] - 2), inv[0, 0], inv[0, 1], inv[1, 1]])


def _derivatives(evaluate, theta: np.ndarray, step: float):
    """Values, first and second derivatives of the quantities at ``theta``; fourth order along each parameter."""
    d = len(theta)
    h = np.maximum(step, STEP * np.abs(theta))
    along = np.diag(h)
    pairs = list(combinations(range(d), 2))
    moves = [np.zeros(d)] + [k * along[j] for j in range(d) for k in (-2, -1, 1, 2)]
    moves += [u * along[i] + v * along[j] for i, j in pairs for u, v in ((1, 1), (1, -1), (-1, 1), (-1, -1))]
    f = np.array([_quantities(s) for s in evaluate(theta + np.array(moves))])
    first, second = np.zeros((d, f.shape[1])), np.zeros((d, d, f.shape[1]))
    for j in range(d):
        far_below, below, above, far_above = f[1 + 4 * j : 5 + 4 * j]
        first[j] = (8 * (above - below) - (far_above - far_below)) / (12 * h[j])
        second[j, j] = (16 * (above + below) - (far_above + far_below) - 30 * f[0]) / (12 * h[j] ** 2)
    for k, (i, j) in enumerate(pairs):
        both, one, other, none = f[1 + 4 * d + 4 * k : 5 + 4 * d + 4 * k]
        second[i, j] = second[j, i] = (both - one - other + none) / (4 * h[i] * h[j])
    return f[0], first, second


def _inverse(hessian: np.ndarray) -> np.ndarray:
    """Inverse over the directions of positive curvature; a covariance on the border may leave others flat."""
    diag = np.diag(hessian)
    scale = np.where(diag > 0, 1 / np.sqrt(np.where(diag > 0, diag, 1.0)), 0.0)
    w, u = np.linalg.eigh(hessian * scale[:, None] * scale)
    u = (u * scale[:, None])[:, w > 1e-6]
    return (u / w[w > 1e-6]) @ u.T


def _search(evaluate, q: int, step: float) -> np.ndarray:
    """Compass search with shrinking moves down to ``step``, then Newton steps; one batch of candidates per round."""
    moves = np.stack(np.meshgrid(*[[-1.0, 0.0, 1.0]] * (1 if q == 1 else 3), indexing="ij"), -1).reshape(-1, 1 if q == 1 else 3)
    best, size = (np.array([0.5]) if q == 1 else np.array([0.5, 0.0, 0.5])), 0.25
    while size > step:
        cand = best + size * moves
        cand[:, 0] = np.abs(cand[:, 0])
        if q == 2:
            cand[:, 2] = np.abs(cand[:, 2])
        score = [_solve(s)[0] for s in evaluate(cand)]
        k = int(np.argmin(score))
        here = score[int(np.argmin(np.abs(cand - best).sum(1)))]
        if score[k] < here - 1e-12 * abs(here):
            best, size = cand[k], size * 1.5
        else:
            size /= 2
    lowest, theta = np.inf, best
    for _ in range(NEWTON_STEPS):
        f, first, second = _derivatives(evaluate, theta, step)
        if f[0] > lowest + 1e-12 * abs(lowest):
            break
        lowest, best = f[0], theta
        move = _inverse(second[:, :, 0]) @ first[:, 0]
        theta = theta - move
        if np.abs(move).max() <= TOLERANCE:
            return theta
    return best


def _degrees(evaluate, theta: np.ndarray, step: float, sigma2: float, left: float, back: np.ndarray) -> list[float]:
    """Degrees of freedom of each fixed effect: twice the squared variance over the variance of that variance."""
    f, first, second = _derivatives(evaluate, theta, step)
    d, sigma = len(theta), np.sqrt(sigma2)
    hessian = np.empty((d + 1, d + 1))
    hessian[:d, :d] = second[:, :, 1] + second[:, :, 2] / sigma2
    hessian[:d, d] = hessian[d, :d] = -2 * first[:, 2] / sigma**3
    hessian[d, d] = 4 * left / sigma2
    inverse, out = _inverse(hessian), []
    for w0, w1 in back:
        weights = np.array([w0 * w0, 2 * w0 * w1, w1 * w1])
        unscaled = f[3:] @ weights
        slope = np.append(sigma2 * (first[:, 3:] @ weights), 2 * sigma * unscaled)
        out.append(float((sigma2 * unscaled) ** 2 / (slope @ inverse @ slope)))
    return out


def mixed_model(df: DataFrame, group: str, x: str, y: str, random_slope: bool = False, small_levels: int = SMALL_LEVELS) -> dict[str, DataFrame]:
    """``y ~ x + (1 | group)``, or ``(x | group)`` with ``random_slope``.

    Returns ``fixed`` (term, estimate, std_error, df, statistic, p_value; t with Satterthwaite's df), ``variance``
    (component, value) and ``levels`` (intercept and slope per level, fixed effect plus its deviation).
    """
    spark, q = df.sparkSession, 2 if random_slope else 1
    levels = cut_lineage(level_sums(df, group, x, y))
    evaluate, step = _evaluator(levels, q, small_levels)
    theta = _search(evaluate, q, step)
    sums = evaluate(theta[None, :])[0]
    _, beta, sigma2, xvx = _solve(sums)
    scale = levels.select("mx", "my", "sd").first()
    mx, my, sd = scale["mx"], scale["my"], scale["sd"]
    # Back to the original units: y = my + b0 + b1 * (x - mx) / sd.
    back = np.array([[1.0, -mx / sd], [0.0, 1.0 / sd]])
    est = back @ beta + np.array([my, 0.0])
    se = np.sqrt(np.diag(back @ (sigma2 * np.linalg.inv(xvx)) @ back.T))
    dfs = _degrees(evaluate, theta, step, sigma2, sums[7] - 2, back)
    fixed = [(t, float(e), float(s), d, float(e / s), student_two_sided(float(e / s), d)) for t, e, s, d in zip(("(Intercept)", x), est, se, dfs)]
    lam = np.array([[theta[0], 0.0], [0.0, 0.0]]) if q == 1 else np.array([[theta[0], 0.0], [theta[1], theta[2]]])
    cov = sigma2 * back @ lam @ lam.T @ back.T
    parts = [("intercept", float(cov[0, 0])), ("residual", float(sigma2))]
    if random_slope:
        parts += [("slope", float(cov[1, 1])), ("covariance", float(cov[0, 1]))]

    def blup(batches):
        for pdf in batches:
            a, c, _, lam_q, m = _level_terms(pdf, theta, q)
            r = (c - a @ beta)[:, :q] @ lam_q
            u = np.linalg.solve(m, r[:, :, None])[:, :, 0] @ lam_q.T
            full = np.zeros((len(pdf), 2))
            full[:, :q] = u
            line = (beta + full) @ back.T + np.array([my, 0.0])
            yield pd.DataFrame({group: pdf[group], "n": pdf["n"].astype("int64"), "intercept": line[:, 0], "slope": line[:, 1]})

    schema = f"`{group}` {levels.schema[group].dataType.simpleString()}, n long, intercept double, slope double"
    return {
        "fixed": spark.createDataFrame(fixed, "term string, estimate double, std_error double, df double, statistic double, p_value double"),
        "variance": spark.createDataFrame(parts, "component string, value double"),
        "levels": levels.select(group, *_SUMS).mapInPandas(blup, schema),
    }


def predict_mixed(df: DataFrame, model: dict[str, DataFrame], group: str, x: str, name: str = "predicted") -> DataFrame:
    c = model["levels"].select(group, F.col("intercept").alias("__a"), F.col("slope").alias("__b"))
    return join_keys(df, c, [group], "left").withColumn(name, F.col("__a") + F.col("__b") * F.col(x)).drop("__a", "__b")
