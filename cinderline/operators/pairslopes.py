"""Exact counts of pairwise slopes in groups of any size, and the order statistics read from them.

For points in the order of ``(x, y)`` the slope of a pair is at most ``t`` exactly when ``y - t * x`` does not rise
from the first point to the second. Counting slopes is thus counting inversions, in O(n log n) and without pairs.
Points are range-partitioned by ``(x, y)`` into blocks; each block sorts its points into cells of ``y - t * x``.
Pairs in different cells are counted from the cells' totals, pairs in one cell where the cell's points meet.
Blocks and cells both grow with the square root of a group until there are 1,024, so no task sees a whole group.

Residuals carry twice the precision of a double. Slopes within 4 units in the last place of ``t`` count as equal
to it, so slopes of tied data, which differ by rounding only, stay tied.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderline.sources.tables import cut_lineage

SAMPLE = 4096
SAMPLE_PAIRS = 1500
MOST_BLOCKS = 1024
ULPS = 4 * 2.0**-52
PART = 8
PART_POINTS = 65_536
_SPLIT = 2.0**27 + 1


# --- numeric helpers, run inside tasks ----------------------------------------------------------

def residual(x: np.ndarray, y: np.ndarray, t: float):
    """``y - t * x`` as an unevaluated sum of two doubles."""
    p = x * t
    big = x * _SPLIT
    xh = big - (big - x)
    th = t * _SPLIT - (t * _SPLIT - t)
    xl, tl = x - xh, t - th
    low = xl * tl - (((p - xh * th) - xl * th) - xh * tl)
    s = y - p
    v = s - y
    err = (y - (s - v)) - (p + v) - low
    hi = s + err
    return hi, err - (hi - s)


def ranks(hi: np.ndarray, lo: np.ndarray, strict: bool) -> np.ndarray:
    """Ranks 0, 1, ... of the residuals; the later of two equal ones ranks above if ``strict``, else below."""
    at = np.arange(len(hi))
    out = np.empty(len(hi), np.int64)
    out[np.lexsort((at if strict else -at, lo, hi))] = at
    return out


def inversions(rank: np.ndarray, w: np.ndarray) -> float:
    """Sum of weight products over pairs whose later element has the lower rank (a permutation)."""
    n, total = len(rank), 0.0
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        half = rank >> bit
        one = (half & 1) == 1
        start = (rank >> (bit + 1)) << (bit + 1)
        ones, heavy = np.concatenate(([0], np.cumsum(one))), np.concatenate(([0.0], np.cumsum(w * one)))
        before = ones[:-1] - ones[start]
        total += float((w * (heavy[:-1] - heavy[start]))[~one].sum())
        to = np.where(one, (half << bit) + before, np.arange(n) - before)
        nxt, ww = np.empty_like(rank), np.empty_like(w)
        nxt[to], ww[to] = rank, w
        rank, w = nxt, ww
    return total


def _cells(hi, lo, cuts):
    """Cell numbers that rise with the residual; cell ``4 k + 2`` holds residuals equal to cut ``k``."""
    k = np.searchsorted(cuts, hi, "left")
    same = (k < len(cuts)) & (cuts[np.minimum(k, len(cuts) - 1)] == hi) if len(cuts) else np.zeros(len(hi), bool)
    return 4 * k + np.where(same, 2 + np.sign(lo).astype(np.int64), 0)


def sample_slopes(x: np.ndarray, y: np.ndarray, most: int = SAMPLE_PAIRS) -> np.ndarray:
    x, y = x[:most], y[:most]
    i, j = np.triu_indices(len(x), 1)
    d = x[j] - x[i]
    return np.sort((y[j] - y[i])[d != 0] / d[d != 0])


def _middle(lo: float, hi: float) -> float:
    """Halfway between two doubles in the order of their bit patterns."""
    rank = lambda v: (lambda i: i if i >= 0 else -(i & 0x7FFFFFFFFFFFFFFF))(int(np.float64(v).view(np.int64)))
    m = (rank(lo) + rank(hi)) // 2
    return float(np.int64(abs(m)).view(np.float64)) * (1.0 if m >= 0 else -1.0)


# --- blocks and counts ----------------------------------------------------------------------------

def slope_blocks(pts: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of consecutive points of ``__g, __x, __y, __w``, and one row of facts and sampled points per group."""
    per_x = pts.groupBy("__g", "__x").agg(
        F.count(F.lit(1)).alias("d"), F.sum("__w").alias("w"), F.min("__y").alias("y0"), F.max("__y").alias("y1")
    )
    facts = cut_lineage(per_x.groupBy("__g").agg(
        F.sum("d").alias("d"), ((F.sum("w") * F.sum("w") - F.sum(F.col("w") * F.col("w"))) / 2).alias("total"),
        F.min("__x").alias("x0"), F.max("__x").alias("x1"), F.greatest(F.max(F.abs("y0")), F.max(F.abs("y1"))).alias("ymax"),
    ))
    each = F.greatest(F.lit(chunk), F.ceil(F.col("d") / MOST_BLOCKS)).cast("long")
    ordered = (
        pts.join(facts.select("__g", each.alias("each")), "__g").select("__g", "__x", "__y", "__w", "each")
        .repartitionByRange("__g", "__x", "__y").sortWithinPartitions("__g", "__x", "__y")
    )

    def cut(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf])
            held = None
            for g, part in pdf.groupby("__g", sort=False):
                size, last = int(part["each"].iloc[0]), g == pdf["__g"].iloc[-1]
                for i in range(0, len(part), size):
                    if last and i + size > len(part):
                        held = part.iloc[i:]
                    else:
                        yield _block(g, part.iloc[i:i + size])
        if held is not None:
            yield _block(held["__g"].iloc[0], held)

    blocks = cut_lineage(ordered.mapInPandas(cut, "__g string, x array<double>, y array<double>, w array<double>"))
    sample = pts.join(facts.select("__g", "d"), "__g").where(F.pmod(F.xxhash64("__x", "__y"), F.col("d")) < SAMPLE).groupBy("__g").agg(
        F.sort_array(F.collect_list(F.struct(F.xxhash64("__x", "__y").alias("h"), "__x", "__y"))).alias("s")
    )
    cells = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("d") / chunk)).cast("int")
    # Neighbouring cells are handed to one call until they hold about PART_POINTS points.
    span = (4 * F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.floor(PART_POINTS * cells / F.col("d"))))).cast("int")
    return blocks, cut_lineage(facts.join(sample, "__g", "left").select(
        *facts.columns, F.col("s.__x").alias("sx"), F.col("s.__y").alias("sy"),
        cells.alias("cells"), span.alias("span"),
    ))


def _block(g, part):
    return pd.DataFrame({"__g": [g], "x": [part["__x"].to_numpy()], "y": [part["__y"].to_numpy()], "w": [part["__w"].to_numpy()]})


def _points_of(r, names=("x", "y", "w")):
    return tuple(np.asarray([] if getattr(r, c) is None else getattr(r, c), float) for c in names)


def _pieces(batches):
    names = ["g", "t", "strict", "part", "cell", "bx", "by", "hi", "lo", "w", "s", "sq"]
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            x, y, w = _points_of(r)
            sx, sy = _points_of(r, ("sx", "sy"))
            for t in r.ts:
                for strict in (True, False):
                    at = t - abs(t) * ULPS if strict else t + abs(t) * ULPS
                    hi, lo = residual(x, y, at)
                    drawn = np.sort(residual(sx, sy, at)[0])
                    cuts = np.unique(drawn[np.linspace(0, len(drawn) - 1, r.cells + 1).astype(int)[1:-1]]) if len(drawn) else drawn
                    cell = _cells(hi, lo, cuts)
                    order = np.argsort(cell, kind="stable")
                    rank = np.empty(len(cell), np.int64)
                    rank[order] = np.arange(len(cell))
                    tied = cell % 4 == 2
                    head = (r.g, t, strict)
                    rows = [(*head, -1, -1, x[0], y[0], np.bincount(cell, w, 4 * r.cells), None, None, inversions(rank, w), float((w * w)[tied].sum()))]
                    ends = np.flatnonzero(np.diff(cell[order])) + 1
                    for at_cell in np.split(order, ends):
                        c = int(cell[at_cell[0]])
                        if c % 4 != 2:
                            rows.append((*head, c // r.span, c, x[0], y[0], hi[at_cell], lo[at_cell], w[at_cell], 0.0, 0.0))
                    yield pd.DataFrame(rows, columns=names)


def _falls(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    g, t, strict, part = key
    pdf = pdf.sort_values(["bx", "by"])
    n = 0.0
    if part >= 0:
        for _, same in pdf.groupby("cell"):
            hi, lo, w = (np.concatenate([np.asarray(a, float) for a in same[c]]) for c in ("hi", "lo", "w"))
            n += inversions(ranks(hi, lo, strict), w)
    else:
        per = np.vstack([np.asarray(a, float) for a in pdf["hi"]])
        before = np.cumsum(per, axis=0) - per
        above = before.sum(axis=1, keepdims=True) - np.cumsum(before, axis=1)
        n = float((per * above).sum()) + float(pdf["s"].sum())
        if not strict:
            n += float((per.sum(axis=0)[2::4] ** 2).sum() - pdf["sq"].sum()) / 2
    return pd.DataFrame({"g": [g], "t": [t], "strict": [strict], "n": [n]})


def count_slopes(blocks: DataFrame, groups: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Exact weighted counts ``__g, t, lt, le`` of slopes below and up to every threshold in ``thresholds.ts``."""
    plan = thresholds.join(groups.select("__g", "sx", "sy", "cells", "span"), "__g").select(
        "__g", "sx", "sy", "cells", "span", F.posexplode("ts").alias("i", "t")
    ).groupBy("__g", F.floor(F.col("i") / PART).alias("part")).agg(
        F.first("sx").alias("sx"), F.first("sy").alias("sy"), F.first("cells").alias("cells"), F.first("span").alias("span"), F.collect_list("t").alias("ts")
    ).drop("part")
    pieces = blocks.join(plan, "__g").withColumnRenamed("__g", "g").mapInPandas(
        _pieces, "g string, t double, strict boolean, part int, cell int, bx double, by double, hi array<double>, lo array<double>, "
                 "w array<double>, s double, sq double"
    )
    falls = pieces.groupBy("g", "t", "strict", "part").applyInPandas(_falls, "g string, t double, strict boolean, n double")
    return falls.groupBy(F.col("g").alias("__g"), "t").agg(F.expr("sum(n) filter (where strict) as lt"), F.expr("sum(n) filter (where not strict) as le"))


# --- the median ------------------------------------------------------------------------------------

def _place(pdf: pd.DataFrame) -> pd.DataFrame:
    """Thresholds around the wanted positions: by sampled slopes while the bracket holds some, then by interpolation."""
    sx, sy = _points_of(next(pdf.itertuples(index=False)), ("sx", "sy"))
    s, out = sample_slopes(sx, sy), {0.0}
    for r in pdf.itertuples(index=False):
        inside = s[np.searchsorted(s, r.b_lo, "right"):np.searchsorted(s, r.b_hi, "left")]
        aim = (r.k - r.le_lo) / max(r.le_hi - r.le_lo, 1.0)
        drawn = len(inside) >= 50
        step = np.array([0.0, 0.01, 0.05, 0.2] if drawn else [0.0, 0.003, 0.03, 0.2])
        aims = np.clip(np.concatenate((aim - step, aim + step)), 0.0, 1.0)
        out.add(_middle(r.b_lo, r.b_hi))
        if drawn:
            out.update(inside[np.rint(aims * (len(inside) - 1)).astype(int)].tolist())
        elif np.isfinite(r.b_lo) and np.isfinite(r.b_hi):
            out.update((r.b_lo + (r.b_hi - r.b_lo) * aims).tolist())
    keep = sorted(t for t in out if ((pdf["b_lo"] < t) & (t < pdf["b_hi"])).any())
    return pd.DataFrame({"__g": [pdf["__g"].iloc[0]], "ts": [keep]})


def median_slopes(blocks: DataFrame, groups: DataFrame, gather: int) -> DataFrame:
    """``__g, n_slopes, slope``: brackets around the two central slopes narrow until few pairs are left inside."""
    inf = float("inf")
    q = F.explode(F.array(
        F.struct(F.lit(0).alias("q"), F.floor((F.col("total") + 1) / 2).cast("double").alias("k")),
        F.struct(F.lit(1).alias("q"), (F.floor(F.col("total") / 2) + 1).cast("double").alias("k")),
    ))
    state = cut_lineage(groups.where("total > 0").withColumn("__q", q).select(
        "__g", "__q.q", "__q.k", "total", F.lit(-inf).alias("b_lo"), F.lit(inf).alias("b_hi"),
        F.lit(0.0).alias("le_lo"), F.col("total").alias("le_hi"), F.lit(None).cast("double").alias("value"),
    ))
    # A bracket open to one side reaches over all points, so it is narrowed even if few slopes are left in it.
    wide = f"value is null and (le_hi - le_lo > {gather} or (total > {gather} and (b_lo = double('-infinity') or b_hi = double('infinity'))))"
    while True:
        busy = state.where(wide)
        if busy.limit(1).count() == 0:
            break
        ts = cut_lineage(busy.join(groups.select("__g", "sx", "sy"), "__g").groupBy("__g").applyInPandas(_place, "__g string, ts array<double>"))
        c = state.where("value is null").join(count_slopes(blocks, groups, ts), "__g")
        moved = c.groupBy("__g", "q").agg(
            F.expr("max_by(struct(t, le), case when le < k then t end) as d"),
            F.expr("min_by(struct(t, le, lt), case when le >= k then t end) as u"),
        )
        # Slopes within a few units in the last place of each other are one value.
        state = cut_lineage(state.join(moved, ["__g", "q"], "left").selectExpr(
            "__g", "q", "k", "total",
            "case when d.t > b_lo then d.t else b_lo end as b_lo", "case when u.t < b_hi then u.t else b_hi end as b_hi",
            "case when d.t > b_lo then d.le else le_lo end as le_lo", "case when u.t < b_hi then u.le else le_hi end as le_hi",
            "coalesce(value, case when u.lt < k and u.t <= b_hi then u.t end) as value",
        ).withColumn("value", F.expr("coalesce(value, case when b_hi - b_lo <= 1e-14 * greatest(abs(b_lo), abs(b_hi)) then b_hi end)")))
    few = _few(blocks, groups, state.where("value is null").select("__g", "q", "b_lo", "b_hi"))
    run = Window.partitionBy("__g", "q").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        few.groupBy("__g", "q", "s").agg(F.sum("w").alias("w")).join(state.select("__g", "q", "k", "le_lo"), ["__g", "q"])
        .withColumn("cum", F.col("le_lo") + F.sum("w").over(run)).where(F.col("cum") >= F.col("k"))
        .groupBy("__g", "q").agg(F.min("s").alias("s"))
    )
    ends = state.join(picked, ["__g", "q"], "left").select("__g", "q", F.coalesce("value", "s", "b_hi").alias("s"))
    lo, hi = (F.max(F.when(F.col("q") == i, F.col("s"))) for i in (0, 1))
    return groups.select("__g", F.col("total").alias("n_slopes")).join(ends.groupBy("__g").agg((lo + (hi - lo) / 2).alias("slope")), "__g", "left")


def _at(x, y, t):
    t = t + abs(t) * ULPS
    return residual(x, y, t) if np.isfinite(t) else (x * -np.sign(t), -y * np.sign(t))


def _few(blocks: DataFrame, groups: DataFrame, brackets: DataFrame) -> DataFrame:
    """Slopes inside brackets known to hold few: a band join on the residuals at the lower end."""
    # Two points whose order changes inside the bracket are no further apart than its width over the range of x.
    size = "greatest(abs(b_lo), abs(b_hi))"
    reach = F.expr(f"(x1 - x0) * (b_hi - b_lo + 1e-14 * {size}) + 1e-12 * (ymax + {size} * greatest(abs(x0), abs(x1)))")
    plan = brackets.join(groups.select("__g", "x0", "x1", "ymax"), "__g").select("__g", "q", "b_lo", "b_hi", reach.alias("reach"))

    def bands(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, y, w = _points_of(r)
                band = np.floor(residual(x, y, r.b_lo)[0] / r.reach) if np.isfinite(r.reach) else np.zeros(len(x))
                for home in (True, False) if np.isfinite(r.reach) else (True,):
                    yield pd.DataFrame({"g": r.g, "q": r.q, "b_lo": r.b_lo, "b_hi": r.b_hi, "reach": r.reach,
                                        "band": band + (0.0 if home else 1.0), "home": home, "x": x, "y": y, "w": w})

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        x, y, w, home = (pdf[c].to_numpy() for c in ("x", "y", "w", "home"))
        (h0, l0), (h1, l1) = _at(x, y, first.b_lo), _at(x, y, first.b_hi)
        up = np.flatnonzero(home)
        up = up[np.argsort(h0[up], kind="stable")]
        if np.isfinite(first.reach):
            s = np.searchsorted(h0[up], h0, "left")
            n = np.searchsorted(h0[up], h0 + 1.001 * first.reach, "right") - s
        else:
            s, n = np.zeros(len(x), np.int64), np.full(len(x), len(up))
        out, ends = [], np.cumsum(n)
        i0 = 0
        while i0 < len(x):
            i1 = max(i0 + 1, int(np.searchsorted(ends, (ends[i0 - 1] if i0 else 0) + 1_000_000)))
            m = n[i0:i1]
            i = np.repeat(np.arange(i0, i1), m)
            j = up[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(s[i0:i1], m)]
            rises = (h0[j] > h0[i]) | ((h0[j] == h0[i]) & (l0[j] > l0[i]))
            falls = (h1[j] < h1[i]) | ((h1[j] == h1[i]) & (l1[j] <= l1[i]))
            ok = (x[j] > x[i]) & (rises | np.isinf(first.b_lo)) & (falls | np.isinf(first.b_hi))
            i, j = i[ok], j[ok]
            if len(i):
                v, at = np.unique((y[j] - y[i]) / (x[j] - x[i]), return_inverse=True)
                out.append(pd.DataFrame({"__g": first.g, "q": first.q, "s": v, "w": np.bincount(at, w[i] * w[j])}))
            i0 = i1
        return pd.concat(out) if out else pd.DataFrame({"__g": [], "q": [], "s": [], "w": []}).astype({"__g": str, "q": "int32"})

    near = blocks.join(plan, "__g").withColumnRenamed("__g", "g").mapInPandas(
        bands, "g string, q int, b_lo double, b_hi double, reach double, band double, home boolean, x double, y double, w double"
    )
    return near.groupBy("g", "q", "band").applyInPandas(pairs, "__g string, q int, s double, w double")
