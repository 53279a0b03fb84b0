"""Natural and fixed class breaks of one numeric column."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.functions.columns import interval_index
from cinderline.sources.tables import cut_lineage


def fixed_class_counts(df: DataFrame, col: str, breaks) -> DataFrame:
    """Rows per ``[b[i], b[i+1])``, the last interval closed."""
    c = df.select(interval_index(col, breaks).alias("class")).where(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    lo = F.element_at(F.array(*[F.lit(float(b)) for b in breaks]), F.col("class"))
    hi = F.element_at(F.array(*[F.lit(float(b)) for b in breaks]), F.col("class") + 1)
    return c.select("class", lo.alias("lo"), hi.alias("hi"), "n")


def _partition(n, s1, s2, k):
    """First bin of every class of the least-squares partition of ordered weighted bins."""
    cn, c1, c2 = (np.concatenate(([0.0], np.cumsum(a))) for a in (n, s1, s2))
    m = len(n)

    def cost(i, j):
        w = cn[j + 1] - cn[i]
        return (c2[j + 1] - c2[i]) - (c1[j + 1] - c1[i]) ** 2 / w

    best, backs = cost(np.zeros(m, dtype=int), np.arange(m)), []
    for level in range(1, k):
        nxt, back = np.full(m, np.inf), np.zeros(m, dtype=int)
        # The best split moves right with the end, so each end searches between its neighbours' splits.
        stack = [(level, m - 1, level, m - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid, b) + 1)
            c = best[i - 1] + cost(i, np.full(len(i), mid))
            p = int(c.argmin())
            nxt[mid], back[mid] = c[p], i[p]
            stack += [(lo, mid - 1, a, int(i[p])), (mid + 1, hi, int(i[p]), b)]
        best = nxt
        backs.append(back)
    starts, end = [], m - 1
    for back in reversed(backs):
        starts.append(int(back[end]))
        end = starts[-1] - 1
    return starts[::-1]


def _dropped(n, s1, s2, k):
    """Per number of classes from 1 to ``k - 1``: least cost before a break in each bin, bins that hold a break not counted.

    A class costs at least what its whole bins cost, so this bounds the cost of all partitions with cuts inside bins.
    """
    cn, c1, c2 = (np.concatenate(([0.0], np.cumsum(a))) for a in (n, s1, s2))
    m = len(n)

    def cost(i, j):  # bins i to j - 1
        j = np.maximum(i, j)
        w = cn[j] - cn[i]
        return np.where(w > 0, (c2[j] - c2[i]) - (c1[j] - c1[i]) ** 2 / np.where(w > 0, w, 1), 0)

    out = [cost(np.zeros(m, dtype=int), np.arange(m))]
    for _ in range(2, k):
        best, nxt = out[-1], np.full(m, np.inf)
        stack = [(0, m - 1, 0, m - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid, b) + 1)
            c = best[i] + cost(np.minimum(i + 1, mid), np.full(len(i), mid))
            p = int(c.argmin())
            nxt[mid] = c[p]
            stack += [(lo, mid - 1, a, int(i[p])), (mid + 1, hi, int(i[p]), b)]
        out.append(nxt)
    return out


def _may_break(n, s1, s2, starts, k):
    """Bins that can hold a break of a partition as good as the one with classes from ``starts``."""
    if k < 2:
        return np.zeros(len(n), dtype=bool)
    edges = [0, *starts, len(n)]
    upper = sum(s2[a:b].sum() - s1[a:b].sum() ** 2 / n[a:b].sum() for a, b in zip(edges, edges[1:]))
    before, after = _dropped(n, s1, s2, k), [g[::-1] for g in _dropped(n[::-1], s1[::-1], s2[::-1], k)]
    lower = np.min([before[t] + after[k - 2 - t] for t in range(k - 1)], axis=0)
    return lower <= upper + 1e-9 * s2.sum()


def natural_breaks(df: DataFrame, col: str, k: int = 5, max_bins: int = 20000) -> DataFrame:
    """``k`` classes of least within-class variance: ``class, lo, hi, n``.

    Distinct values are counted by Spark and written once. Up to ``max_bins`` of them are solved exactly. Beyond
    that, values are gathered into that many bins, and every bin that can hold a break of an optimal partition (by a
    lower bound of the cost) is split again until these bins are single values, so the result is the same; where many
    partitions are nearly as good, more than ``max_bins`` bins come to the driver.
    """
    data = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    counts = cut_lineage(data.groupBy("v").agg(F.count(F.lit(1)).alias("n")))  # read several times
    mid = counts.agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"), F.min("v").alias("lo")).first()
    if mid["lo"] is None:
        return df.sparkSession.createDataFrame([], "class int, lo double, hi double, n long")
    d = F.col("v") - F.lit(mid["m"])
    sums = [F.sum("n").alias("n"), F.sum(F.col("n") * d).alias("s1"), F.sum(F.col("n") * d * d).alias("s2"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("distinct")]
    if counts.limit(max_bins + 1).count() <= max_bins:
        bins = counts.groupBy("v").agg(*sums).orderBy("lo").toPandas()
    else:
        probs = [i / max_bins for i in range(1, max_bins)]
        cuts = np.unique(counts.agg(F.percentile_approx("v", probs, 10 * max_bins).alias("c")).first()["c"])
        bins = _binned(counts, cuts, sums)
    k = min(k, int(bins["distinct"].sum()))
    while True:
        parts = [bins[c].to_numpy(float) for c in ("n", "s1", "s2")]
        starts = _partition(*parts, k) if len(bins) >= k else []
        open_ = _may_break(*parts, starts, k) if len(bins) >= k else np.ones(len(bins), dtype=bool)
        wide = np.flatnonzero(open_ & (bins["distinct"].to_numpy() > 1))
        if not len(wide):
            break
        # Keep every bin edge and split only the bins that can hold a break.
        extra = max(2, max_bins // len(wide))
        edges = bins["hi"].to_numpy()[:-1]
        fine = _placed(counts, edges, wide).groupBy("bin").agg(
            F.percentile_approx("v", [i / extra for i in range(1, extra)], 10 * extra).alias("c")
        ).collect()
        inner = np.concatenate([np.array(r["c"]) for r in fine])
        bins = _binned(counts, np.unique(np.concatenate((edges, inner))), sums)
    starts = [0, *starts, len(bins)]
    rows = [
        (i + 1, float(bins["lo"].iloc[a]), float(bins["hi"].iloc[b - 1]), int(bins["n"].iloc[a:b].sum()))
        for i, (a, b) in enumerate(zip(starts, starts[1:]))
    ]
    return df.sparkSession.createDataFrame(rows, "class int, lo double, hi double, n long")


def _placed(counts: DataFrame, cuts: np.ndarray, only: np.ndarray | None = None) -> DataFrame:
    """``v, n, bin``: the interval between cuts (upper edge included) of each value, of the bins ``only`` if given."""
    def place(batches):
        for pdf in batches:
            pdf["bin"] = np.searchsorted(cuts, pdf["v"].to_numpy(), side="left")
            yield pdf if only is None else pdf[pdf["bin"].isin(only)]

    return counts.mapInPandas(place, "v double, n long, bin long")


def _binned(counts: DataFrame, cuts: np.ndarray, sums):
    """One row per non-empty interval between cuts (upper edge included)."""
    return _placed(counts, cuts).groupBy("bin").agg(*sums).orderBy("lo").toPandas()
