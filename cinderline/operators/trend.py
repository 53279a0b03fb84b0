"""Robust trends: median of pairwise slopes, its signed-rank test, and repeated medians.

Equal ``(x, y)`` points are merged first and carry a weight. A group with few distinct
points is fitted inside one task. A larger group with few distinct ``x`` (years) is fitted from counts between its columns of
equal ``x``, see ``columnslopes``; intervals of its test are tasks of their own. The test goes through all slopes whatever the size, unless a caller
asks for bounds of it. In other groups slopes are counted
as inversions, see ``pairslopes``:
the median slope is found by narrowing a bracket with exact counts (after Dillencourt, Mount and
Netanyahu 1992 and Matousek 1991), and bounds of the test statistic by exact counts at a ladder of slopes that is
refined until the p-value is known to within ``p_tol``. Neither needs ``x`` to take few values.
"""

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderline.functions.tails import normal_two_sided, signed_rank_two_sided
from cinderline.operators import columnslopes as S
from cinderline.operators.keys import join_keys, spread
from cinderline.operators.pairslopes import count_slopes, median_slopes, sample_slopes, slope_blocks
from cinderline.operators.ranks import cumulative_counts
from cinderline.sources.tables import cut_lineage

DIRECT_POINTS = 4096
CHUNK = 4096
GATHER = 1_000_000
#: Groups counted between columns of equal x: at most so many points and columns.
COLUMN_POINTS = 4_000_000
COLUMNS = 64
#: Fewer distinct points are fitted directly even in columns.
COLUMN_LEAST = 1024
#: Cells of slopes that bound the test: at most at first, and at most.
CELLS = 65_536
MOST_CELLS = 2_097_152
RUNGS = 64
#: Least lookups or slopes of one task where a group's test takes several, some seconds.
TASK_SLOPES = 30_000_000
TASKS = 256
#: Slopes gone through at once where ``x`` takes many values, and held before equal ones are merged.
LISTED = 10_000_000
HELD = 2_000_000

_FIT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("n_slopes", T.DoubleType()),
    T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
    T.StructField("v", T.DoubleType()), T.StructField("z", T.DoubleType()),
    T.StructField("p", T.DoubleType()), T.StructField("p_error", T.DoubleType()),
])


# --- small numeric helpers, run inside tasks ---------------------------------------------------

def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """Midpoint of the two central order statistics of values repeated by their weights."""
    order = np.argsort(values, kind="stable")
    cum = np.cumsum(weights[order])
    total = cum[-1]
    lo = values[order][np.searchsorted(cum, (total + 1) // 2)]
    hi = values[order][np.searchsorted(cum, total // 2 + 1)]
    return float(lo + (hi - lo) / 2)


def pair_slopes(x, y, w):
    """Slopes of all point pairs with different x, and the products of their weights."""
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order]
    after = np.searchsorted(x, x, side="right")
    s = [(y[k:] - y[i]) / (x[k:] - x[i]) for i, k in enumerate(after) if k < len(x)]
    ww = [w[i] * w[k:] for i, k in enumerate(after) if k < len(x)]
    return (np.concatenate(s), np.concatenate(ww)) if s else (np.empty(0), np.empty(0))


def signed_rank(values: np.ndarray, weights: np.ndarray | None = None):
    """``(V, z, p)`` of the signed-rank test: zeros dropped, average ranks, exact for < 50 untied values."""
    keep = values != 0
    zeros = not keep.all()
    s = values[keep]
    if len(s) == 0:
        return None, None, None
    if weights is None:
        mag, plus = np.sort(np.abs(s)), np.sort(s[s > 0])
        v = float((np.searchsorted(mag, plus, "left") + np.searchsorted(mag, plus, "right") + 1).sum() / 2)
        size = np.diff(np.concatenate(([0], np.flatnonzero(np.diff(mag)) + 1, [len(mag)]))).astype(float)
    else:
        w = weights[keep]
        mag, at = np.unique(np.abs(s), return_inverse=True)
        size = np.bincount(at, weights=w, minlength=len(mag))
        rank = np.cumsum(size) - size + (size + 1) / 2
        v = float((np.bincount(at, weights=np.where(s > 0, w, 0.0), minlength=len(mag)) * rank).sum())
    n = float(size.sum())
    z = signed_rank_z(v, n, float((size**3 - size).sum()))
    if n < 50 and not zeros and (size == 1).all():
        return v, z, signed_rank_two_sided(v, int(n))
    return v, z, None if z is None else normal_two_sided(z)


def signed_rank_z(v: float, n: float, ties: float):
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return None
    d = v - n * (n + 1) / 4
    return (d - math.copysign(0.5, d)) / math.sqrt(var) if d != 0 else 0.0


def _p_between(v_lo: float, v_hi: float, n: float, ties_lo: float, ties_hi: float):
    """Middle and half width of the p-values between bounds of the statistic and its ties; and the ``z`` at the bounds."""
    zs = [signed_rank_z(v, n, k) for v in (v_lo, v_hi) for k in (ties_lo, ties_hi)]
    widest = [z for z in zs if z is not None]
    far = max(map(abs, widest)) if None not in zs else math.inf
    near = 0.0 if min(widest) <= 0 <= max(widest) else min(map(abs, widest))
    p_hi, p_lo = min(1.0, normal_two_sided(near)), normal_two_sided(far)
    return (p_lo + p_hi) / 2, (p_hi - p_lo) / 2, zs


def _fit_points(x, y, w):
    n = int(w.sum())
    single = bool((w == 1).all())
    s, ww = pair_slopes(x, y, w)
    if len(s) == 0:
        return n, 0.0, None, None, None, None, None, 0.0
    slope = float(np.median(s)) if single else weighted_median(s, ww)
    intercept = weighted_median(y - slope * x, w)
    v, z, p = signed_rank(s, None if single else ww)
    return n, float(ww.sum()), slope, intercept, v, z, p, 0.0


# --- operators ------------------------------------------------------------------------------------

def _points(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return (
        df.where(f"`{x}` is not null and `{y}` is not null")
        .groupBy(*keys, F.expr(f"cast(`{x}` as double) as __x"), F.expr(f"cast(`{y}` as double) as __y"))
        .agg(F.expr("cast(count(*) as double) as __w"))
    )


def _with_fit(schema: T.StructType, keys: Sequence[str]) -> T.StructType:
    return T.StructType([schema[k] for k in keys] + _FIT.fields)


def theil_sen(
    df: DataFrame, keys: Sequence[str], x: str, y: str, direct_points: int = DIRECT_POINTS,
    chunk: int = CHUNK, gather: int = GATHER, p_tol: float = 1e-6, exact_slopes: int | None = None,
) -> DataFrame:
    """Per group: ``n, n_slopes, slope, intercept, v, z, p, p_error``.

    ``slope`` is the median over all pairs with different x, ``intercept`` the median of
    ``y - slope * x``; ``v, z, p`` test the pairwise slopes against zero. ``p_error`` is 0 where
    the test is exact, as it is in groups of any size, else a proven bound below ``p_tol``. A caller that needs ``p`` only may give ``exact_slopes``: where
    ``x`` takes few values, groups of more pairs of distinct points are then bounded if they are clear of the limit of significance, others of more than
    ``direct_points`` distinct points always. A group with no pair has NULLs.
    """
    keys = list(keys)
    pts = cut_lineage(_points(df, keys, x, y))
    per_x = pts.groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__d"), F.expr("bool_and(abs(__x) < 1e300 and abs(__y) < 1e300) as __plain"))
    size = cut_lineage(per_x.groupBy(*keys).agg(
        F.sum("__d").alias("__d"), F.expr(f"bool_and(__plain) and count(*) <= {COLUMNS} and sum(__d) <= {COLUMN_POINTS} as __columns")
    ))
    sized = join_keys(pts, size, keys, "inner")
    schema = _with_fit(pts.schema, keys)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = _fit_points(pdf["__x"].to_numpy(), pdf["__y"].to_numpy(), pdf["__w"].to_numpy())
        return pd.DataFrame([tuple(None if isinstance(k, float) and k != k else k for k in key) + row], columns=schema.names)

    columns, rest = f"__d > {min(COLUMN_LEAST, direct_points)} and __columns", f"__d > {direct_points} and not __columns"
    small = sized.where(f"not ({columns}) and not ({rest})").drop("__d", "__columns")
    out = spread(small, keys).groupBy(*keys).applyInPandas(fit, schema)
    some = size.agg(F.expr(f"count_if({columns}) as columns"), F.expr(f"coalesce(bool_or({rest}), false) as rest")).first()
    if some["columns"]:
        out = out.unionByName(_fit_columns(sized.where(columns).drop("__d", "__columns"), keys, schema, p_tol, exact_slopes, some["columns"]))
    if not some["rest"]:
        return out
    large = sized.where(rest).drop("__d", "__columns")
    return out.unionByName(_fit_large(large, keys, chunk, gather, p_tol, exact_slopes).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))


def repeated_medians(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Median over points of each point's median slope (and intercept), for one mean y per x.

    Several rows at one x are averaged first, so a group is never longer than its number of
    distinct x (years).
    """
    keys = list(keys)
    series = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        *keys, F.col(x).cast("double").alias("__x")
    ).agg(F.avg(y).cast("double").alias("__y"))
    schema = T.StructType([series.schema[k] for k in keys] + [
        T.StructField("n", T.LongType()), T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType()),
        T.StructField("v", T.DoubleType()), T.StructField("p", T.DoubleType()),
    ])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["__x"].to_numpy(), pdf["__y"].to_numpy()
        row = (len(a), None, None, None, None)
        if len(a) > 1:
            slopes, cuts = np.empty(len(a)), np.empty(len(a))
            for i in range(len(a)):
                o = a != a[i]
                slopes[i] = np.median((b[o] - b[i]) / (a[o] - a[i]))
                cuts[i] = np.median((a[o] * b[i] - a[i] * b[o]) / (a[o] - a[i]))
            v, _, p = signed_rank(slopes)
            row = (len(a), float(np.median(slopes)), float(np.median(cuts)), v, p)
        return pd.DataFrame([tuple(key) + row], columns=schema.names)

    return spread(series, keys).groupBy(*keys).applyInPandas(fit, schema)


def metric_trends(
    df: DataFrame, keys: Sequence[str], x: str, metrics: dict[str, str], min_rows: int = 10, **fit_options,
) -> DataFrame:
    """One trend and p-value per metric and group; ``metrics`` maps output prefixes to columns.

    Groups with at most ``min_rows`` rows keep their row count and have no trend.
    """
    keys = list(keys)
    df = cut_lineage(df.select(*{c: F.col(c) for c in (*keys, x, *metrics.values())}.values()))  # read three times
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    enough = join_keys(df, n.where(F.col("n") > min_rows).drop("n"), keys, "left_semi")
    pairs = ", ".join(f"struct('{a}' as metric, cast(`{c}` as double) as __v)" for a, c in metrics.items())
    long = enough.select(*keys, x, F.expr(f"inline(array({pairs}))"))
    fits = theil_sen(long, [*keys, "metric"], x, "__v", **{"exact_slopes": 0} | fit_options)  # only p is kept of the test
    wide = fits.groupBy(*keys).agg(*[
        F.expr(f"max({c}) filter (where metric = '{a}') as `{a}_{s}`") for a in metrics for c, s in (("slope", "trend"), ("p", "p"))
    ])
    return join_keys(n, wide, keys, "left")


def trend_label(slope: str, p: str, missing: str | None = None, alpha: float = 0.05, up: str = "Positive", down: str = "Negative") -> Column:
    """Direction of a significant trend, ``Not Significant``, or ``missing`` without a p-value."""
    s, p = F.col(slope), F.col(p)
    return F.when(p.isNull(), F.lit(missing)).when(p >= alpha, "Not Significant").when(s > 0, up).when(s.isNotNull(), down).otherwise(F.lit(missing))


# --- larger groups in columns of equal x --------------------------------------------------------------

def _judge(pos: float, neg: float, total: float, found: tuple, rungs: int, p_tol: float):
    """``v, z, p, p_error`` of an interval result over all magnitudes, and the rungs that settle it (None: it is; 0: all slopes)."""
    _, _, cross, room, ties, loose = found
    n, v_lo = pos + neg, pos * (pos + 1) / 2 + cross
    if rungs == 0:
        z = signed_rank_z(v_lo, n, ties)
        if n < 50 and n == total and ties == 0:
            return v_lo, z, signed_rank_two_sided(v_lo, int(n)), 0.0, None
        return v_lo, z, None if z is None else normal_two_sided(z), 0.0, None
    p, p_error, zs = _p_between(v_lo, v_lo + room, n, ties, ties + loose)
    v = v_lo + room / 2
    row = v, signed_rank_z(v, n, ties), p, p_error
    # p-values far below the tolerance are settled: to that of rounding at p_tol, so that they round as the exact one does.
    if n >= 50 and p_error <= p_tol / 100:
        return *row, None
    if None in zs or n < 50:
        return *row, 0
    half, clear = (max(zs) - min(zs)) / 2, abs(max(zs) + min(zs)) / 2 - 6.0
    return *row, math.ceil(1.25 * rungs * half / clear) if clear > 0 and rungs * half < 1e9 * clear else 0


def _work(cols: S.Columns, rungs: int) -> tuple[int, float]:
    """The rungs asked for, or 0 where going through all slopes is less work; and that work."""
    ladder, every = 2.0 * rungs * cols.lookups, _every(cols)
    return (rungs, ladder) if 0 < rungs and ladder < every else (0, every)


def _every(cols: S.Columns) -> float:
    return 1.5 * cols.pairs + 200.0 * cols.lookups


def _parts(work: float, rungs: int) -> int:
    """Tasks of a test. Every one reads the group's points, about the root of the work, so in large groups tasks are longer; more so where each is through slopes."""
    task = TASK_SLOPES * (max(1.0, math.sqrt(work) / 30_000) if rungs else max(0.5, math.sqrt(work) / 6_000))
    return min(4096, math.ceil(work / task))


def _by_cells(cols: S.Columns, pos: float, neg: float, p_tol: float):
    """``v, z, p, p_error`` where cells of slopes settle them, in no more work than all slopes; else None."""
    cells = min(CELLS, 1 << (2 * sum(map(len, cols.y))).bit_length())
    while 0 < cells <= MOST_CELLS and S.blur_work(cols, cells) < _every(cols):
        found = S.blurred(cols, cells)
        if found is None:
            return None
        *test, wanted = _judge(pos, neg, cols.total, found, cells, p_tol)
        if wanted is None:
            return test
        cells = 0 if wanted == 0 else 1 << max(cells, wanted - 1).bit_length()
    return None


def _measure(cols: S.Columns, rungs: int, part: int = 0, parts: int = 1) -> tuple:
    """One of ``parts`` intervals of magnitudes, by rungs or (0) by all slopes."""
    guide = np.abs(cols.sample())
    guide = np.sort(guide[guide > 0])
    at = lambda share: 0.0 if share <= 0 or not len(guide) else math.inf if share >= 1 else float(guide[int(share * len(guide))])
    lo, hi = at(part / parts), at((part + 1) / parts) if part + 1 < parts else math.inf
    if lo == hi:
        return 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    if rungs == 0:
        return S.exact(cols, lo, hi, guide)
    inside = [at((part + i / max(1, rungs // parts)) / parts) for i in range(1, max(1, rungs // parts))]
    return S.bounded(cols, np.unique([lo, *inside, hi]))


def _fit_columns(pts: DataFrame, keys: Sequence[str], schema: T.StructType, p_tol: float, exact_slopes: int | None, groups: int) -> DataFrame:
    """Slope, intercept and, where that is quick, the test in one task per group; else the test in tasks by magnitudes."""
    names = [f.name for f in _FIT.fields]
    state = T.StructType([*schema.fields, *(T.StructField(c, T.DoubleType()) for c in ("pos", "neg", "every")), *(T.StructField(c, T.IntegerType()) for c in ("rungs", "parts"))])
    piece = T.StructType([schema[k] for k in keys] + [T.StructField("part", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("up", "down", "cross", "room", "ties", "loose")])
    own = lambda key: tuple(None if isinstance(k, float) and k != k else k for k in key)
    columns = lambda pdf: S.Columns(*(pdf[c].to_numpy() for c in ("__x", "__y", "__w")))

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = columns(pdf)
        n, rungs, parts = int(pdf["__w"].sum()), None, None
        row = (n, 0.0, None, None, None, None, None, 0.0, 0.0, 0.0, 0.0)
        if cols.pairs:
            slope = S.median(cols)
            intercept = weighted_median(pdf["__y"].to_numpy() - slope * pdf["__x"].to_numpy(), pdf["__w"].to_numpy())
            zero = np.zeros(1)
            pos, neg = cols.total - float(cols.count(zero)[0]), float(cols.count(zero, strict=True)[0])
            test = (None, None, None, 0.0)
            if pos + neg:
                rungs, work = _work(cols, 0 if exact_slopes is None or cols.pairs <= exact_slopes else RUNGS)
                settled = _by_cells(cols, pos, neg, p_tol) if rungs else None
                if settled:
                    test, rungs = settled, None
                while rungs is not None and (work <= (TASK_SLOPES if rungs else TASK_SLOPES / 6) or rungs == RUNGS):
                    *test, rungs_next = _judge(pos, neg, cols.total, _measure(cols, rungs), rungs, p_tol)
                    rungs, work = (None, 0.0) if rungs_next is None else _work(cols, rungs_next if rungs_next > rungs else 0)
                parts = None if rungs is None else _parts(work, rungs)
            row = (n, cols.total, slope, intercept, *test, pos, neg, _every(cols))
        return pd.DataFrame([own(key) + row + (rungs, parts)], columns=state.names)

    def interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _measure(columns(pdf), int(pdf["rungs"].iloc[0]), int(key[-1]), int(pdf["parts"].iloc[0]))
        return pd.DataFrame([own(key[:-1]) + (int(key[-1]), *found)], columns=piece.names)

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        r = pdf.iloc[0]
        found = S.joined(pdf[piece.names[-6:]].itertuples(index=False, name=None))
        *test, rungs = _judge(r["pos"], r["neg"], r["n_slopes"], found, int(r["rungs"]), p_tol)
        # What the wanted rungs leave open is settled by all slopes.
        parts = None if rungs is None else _parts(r["every"], 0)
        return pd.DataFrame([own(key) + (int(r["n"]), r["n_slopes"], r["slope"], r["intercept"], *test, r["pos"], r["neg"], r["every"], None if rungs is None else 0, parts)], columns=state.names)

    # An empty task takes a tenth of a second, too.
    least = int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(TASKS, 4 * groups), least)
    done = cut_lineage(pts.repartition(tasks, *keys).groupBy(*keys).applyInPandas(first, state))
    out, todo = done.where("rungs is null"), done.where("rungs is not null")
    while parts := todo.agg(F.sum("parts")).first()[0]:
        tasks = max(min(TASKS, 4 * parts), least)
        dealt = join_keys(pts, todo.select(*keys, "rungs", "parts"), keys, "inner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        found = cut_lineage(dealt.repartition(tasks, *keys, "part").groupBy(*keys, "part").applyInPandas(interval, piece))
        done = cut_lineage(spread(join_keys(found, todo, keys, "inner"), keys).groupBy(*keys).applyInPandas(settle, state))
        out, todo = out.unionByName(done.where("rungs is null")), done.where("rungs is not null")
    return out.select(*keys, *names)


# --- large groups -----------------------------------------------------------------------------------

def _fit_large(pts: DataFrame, keys: Sequence[str], chunk: int, gather: int, p_tol: float, exact_slopes: int | None) -> DataFrame:
    named = cut_lineage(pts.withColumn("__g", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})))
    back = named.groupBy("__g").agg(*[F.first(k).alias(k) for k in keys], F.sum("__w").cast("long").alias("n"))
    blocks, groups = slope_blocks(named.select("__g", "__x", "__y", "__w"), chunk)
    slope = cut_lineage(median_slopes(blocks, groups, gather))
    resid = join_keys(named, slope.where("slope is not null").select("__g", "slope"), ["__g"], "inner").withColumn("__r", F.col("__y") - F.col("slope") * F.col("__x"))
    ranked = cumulative_counts(
        resid.groupBy("__g", F.col("__r").alias("value")).agg(F.sum("__w").cast("long").alias("n")), ["__g"]
    )
    mid = (F.col("total") + 1) / 2
    cut = ranked.where((F.floor(mid) <= F.col("cum")) & (F.ceil(mid) > F.col("cum") - F.col("n"))).groupBy("__g").agg(
        ((F.min("value") + F.max("value")) / 2).alias("intercept")
    )
    test = _listed_test(named, groups, p_tol) if exact_slopes is None else _ladder_test(blocks, groups, p_tol)
    return back.join(slope, "__g").join(cut, "__g", "left").join(test, "__g", "left").drop("__g").fillna(0.0, ["p_error"])


def _merged(mag, up, down):
    """Distinct magnitudes in order, and the weights of their positive and negative slopes."""
    mag, at = np.unique(np.concatenate(mag), return_inverse=True)
    return tuple([v] for v in (mag, *(np.bincount(at, np.concatenate(w), len(mag)) for w in (up, down))))


def _listed(x, y, w, lo: float, hi: float) -> tuple:
    """As ``columnslopes.exact`` for the magnitudes in ``(lo, hi]``, by going through all pairs of points sorted by ``x``."""
    mag, up, down, held, n = [np.empty(0)], [np.empty(0)], [np.empty(0)], 0, len(x)
    wide, step = float(y.max() - y.min()), max(1, HELD // n)
    for i in range(0, n, step):
        j = min(n, i + step)
        # Points farther off in x have smaller slopes.
        near = n if lo == 0 else int(np.searchsorted(x, x[j - 1] + 1.001 * wide / lo, "right"))
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            d = x[i:near] - x[i:j, None]
            s = (y[i:near] - y[i:j, None]) / d
        m = np.abs(s)
        at = np.nonzero((d > 0) & (m > lo) & (m <= hi))
        ww, rise = w[i:near][at[1]] * w[i:j][at[0]], s[at] > 0
        for kept, more in ((mag, m[at]), (up, ww * rise), (down, ww * ~rise)):
            kept.append(more)
        held += len(ww)
        if held > HELD:
            mag, up, down = _merged(mag, up, down)
            held = 0
    _, (up,), (down,) = _merged(mag, up, down)
    below, size = np.cumsum(down), up + down
    return float(up.sum()), float(down.sum()), float(up @ (below - down / 2)), 0.0, float((size**3 - size).sum()), 0.0


def _listed_test(named: DataFrame, groups: DataFrame, p_tol: float) -> DataFrame:
    """``__g, v, z, p, p_error``: the signed-rank test from all slopes, in tasks by magnitudes."""
    names = ["up", "down", "cross", "room", "ties", "loose"]

    def interval(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__x", "__y"])
        x, y, w = (pdf[c].to_numpy() for c in ("__x", "__y", "__w"))
        i, j = np.random.default_rng(7).integers(0, len(x), (2, S.SAMPLE))
        i, j = i[x[i] < x[j]], j[x[i] < x[j]]
        guide = np.abs((y[j] - y[i]) / (x[j] - x[i]))
        guide = np.sort(guide[guide > 0])
        cuts = int(pdf["cuts"].iloc[0])
        first, last = (int(key[1]) + k for k in (0, 1))
        edges = [0.0, *guide[(np.arange(1, cuts) * len(guide)) // cuts].tolist(), math.inf] if len(guide) else [0.0, *[math.inf] * cuts]
        parts = int(pdf["parts"].iloc[0])
        edges = np.unique(edges[first * cuts // parts:last * cuts // parts + 1])
        found = S.joined(_listed(x, y, w, lo, hi) for lo, hi in zip(edges, edges[1:]))
        return pd.DataFrame([(key[0], int(key[1]), *found)], columns=["__g", "part", *names])

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        found = S.joined(pdf.sort_values("part")[names].itertuples(index=False, name=None))
        test = _judge(found[0], found[1], float(pdf["total"].iloc[0]), found, 0, p_tol)[:4] if found[0] + found[1] else (None, None, None, 0.0)
        return pd.DataFrame([(pdf["__g"].iloc[0], *test)], columns=["__g", "v", "z", "p", "p_error"])

    cuts = named.groupBy("__g").agg(F.expr(f"cast(ceil(count(*) * (count(*) - 1) / 2 / {LISTED}) as int) as cuts"))
    cuts = cuts.where("cuts > 0").withColumn("parts", F.expr(f"least(cuts, {TASKS})"))
    dealt = named.select("__g", "__x", "__y", "__w").join(cuts.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("part")), "__g")
    piece = "__g string, part int, " + ", ".join(f"{c} double" for c in names)
    found = cut_lineage(spread(dealt, ["__g", "part"]).groupBy("__g", "part").applyInPandas(interval, piece))
    return found.join(groups.select("__g", "total"), "__g").groupBy("__g").applyInPandas(settle, "__g string, v double, z double, p double, p_error double")


def _ladder_test(blocks: DataFrame, groups: DataFrame, p_tol: float, rungs: int = 16) -> DataFrame:
    """``__g, v, z, p, p_error``: signed-rank statistic between proven bounds, refined until tight.

    Should a refinement find no new rung among the sampled slopes, the bound reached is returned in ``p_error``.
    """
    todo, done = groups.where("total > 0").select("__g", F.lit(0).alias("had")), None

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, lt, le, total = pdf["t"].to_numpy(), pdf["lt"].to_numpy(), pdf["le"].to_numpy(), float(pdf["total"].iloc[0])
        zero = int(np.searchsorted(t, 0.0))
        neg, pos = lt[zero], total - le[zero]
        n = neg + pos
        if n == 0:
            return pd.DataFrame([(pdf["__g"].iloc[0], None, None, None, 0.0)], columns=["__g", "v", "z", "p", "p_error"])
        # Magnitudes split into the rungs themselves, which are exact, and the gaps between them.
        up_lt, up_le = lt[zero + 1:], le[zero + 1:]
        dn_lt, dn_le = lt[:zero][::-1], le[:zero][::-1]
        up_at, dn_at = up_le - up_lt, dn_le - dn_lt
        up_gap = np.append(up_lt, total) - np.insert(up_le, 0, le[zero])
        dn_gap = np.insert(dn_lt, 0, neg) - np.append(dn_le, 0.0)
        base = pos * (pos + 1) / 2
        v_lo = base + float((up_gap * np.insert(neg - dn_lt, 0, 0.0)).sum() + (up_at * (neg - dn_le + dn_at / 2)).sum())
        v_hi = v_lo + float((up_gap * dn_gap).sum())
        cubes = lambda c: float((c**3 - c).sum())
        ties_lo = cubes(up_at + dn_at)
        ties_hi = ties_lo + float(((up_gap + dn_gap) ** 3 - (up_gap + dn_gap)).clip(min=0).sum())
        p, p_error, _ = _p_between(v_lo, v_hi, n, ties_lo, ties_hi)
        v = (v_lo + v_hi) / 2
        return pd.DataFrame([(pdf["__g"].iloc[0], v, signed_rank_z(v, n, ties_lo), p, p_error)],
                            columns=["__g", "v", "z", "p", "p_error"])

    while True:
        ladders = cut_lineage(todo.join(groups.select("__g", "sx", "sy"), "__g").groupBy("__g").applyInPandas(
            _ladder(rungs), "__g string, had int, ts array<double>"
        ))
        counts = count_slopes(blocks, groups, ladders.select("__g", "ts")).join(groups.select("__g", "total"), "__g")
        est = counts.groupBy("__g").applyInPandas(bounds, "__g string, v double, z double, p double, p_error double")
        est = cut_lineage(est.join(ladders.select("__g", "had", F.size("ts").alias("has")), "__g"))
        settled = est.where((F.col("p_error") <= p_tol) | (F.col("has") <= F.col("had")))
        done = settled.drop("had", "has") if done is None else done.unionByName(settled.drop("had", "has"))
        todo = cut_lineage(est.where((F.col("p_error") > p_tol) & (F.col("has") > F.col("had"))).select("__g", F.col("has").alias("had")))
        if todo.limit(1).count() == 0:
            return done
        rungs *= 8


def _ladder(rungs: int):
    """Zero and both signs of slope magnitudes: even over all sampled slopes, over distinct ones, and between these."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.asarray(pdf[c].iloc[0], float) if pdf[c].iloc[0] is not None else np.empty(0) for c in ("sx", "sy"))
        mags = np.sort(np.abs(sample_slopes(x, y)))
        mags = mags[mags > 0]
        m = np.empty(0)
        if len(mags):
            even = lambda v: v[np.linspace(0, len(v) - 1, rungs + 1).astype(int)]
            m = np.unique(np.concatenate((even(mags), even(np.unique(mags)))))
            m = np.unique(np.concatenate((m, (m[1:] + m[:-1]) / 2)))
        return pd.DataFrame({"__g": [pdf["__g"].iloc[0]], "had": [int(pdf["had"].iloc[0])], "ts": [np.concatenate((-m[::-1], [0.0], m))]})

    return place
