"""Mean-shift segmentation of daily series and the fastest growth period it shows."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderline.operators.grouping import consecutive_rate
from cinderline.operators.keys import spread


#: Breaks and ends looked at together; a series needs memory for its length and this many numbers.
CELLS = 200_000


def mean_shifts(y: np.ndarray, trim: float = 0.15, cells: int = CELLS) -> list[int]:
    """Last positions (0-based) of all segments but the last.

    Least-squares partition by dynamic programming, every segment at least ``trim`` of the series, number of
    breaks by BIC. Ties go to the earlier break and to fewer breaks. Costs come from running sums, for a few
    segment ends at a time, so memory grows with the length and not with its square.
    """
    n = len(y)
    h = int(np.floor(trim * n))
    most = int(np.ceil(n / h)) - 2 if h >= 1 else 0
    if most < 1:
        return []
    s1, s2 = np.concatenate(([0.0], np.cumsum(y))), np.concatenate(([0.0], np.cumsum(y * y)))

    def cost(i, j):
        c = (s2[j + 1] - s2[i]) - (s1[j + 1] - s1[i]) ** 2 / np.maximum(j - i + 1, 1)
        return np.round(np.maximum(c, 0.0), 6)

    best = np.full(n, np.inf)
    best[h - 1:] = cost(0, np.arange(h - 1, n))
    backs, rss, width = [], [best[n - 1]], max(1, cells // n)
    for _ in range(most):
        following, back = np.full(n, np.inf), np.zeros(n, np.int64)
        for j in range(2 * h - 1, n, width):
            # The segment before ends at i, the next runs from i + 1 to j.
            j = np.arange(j, min(j + width, n))
            i = np.arange(h - 1, j[-1] - h + 1)[:, None]
            step = np.where(j - i >= h, np.round(best[i] + cost(i + 1, j), 6), np.inf)
            back[j] = i[step.argmin(0), 0]
            following[j] = step.min(0)
        backs.append(back)
        best = following
        rss.append(best[n - 1])
    with np.errstate(divide="ignore"):
        bic = [n * (np.log(r) + 1 - np.log(n) + np.log(2 * np.pi)) + np.log(n) * 2 * (m + 1) for m, r in enumerate(rss)]
    m = int(np.argmin(bic))
    breaks, end = [], n - 1
    for back in reversed(backs[:m]):
        end = int(back[end])
        breaks.append(end)
    return breaks[::-1]


def growth_periods(daily: DataFrame, id: str, day: str, value: str, cum: str, min_rows: int) -> DataFrame:
    """``id, day, cum`` at the origin, at every break and at the end of series longer than ``min_rows``.

    Rows are summed per day first, so a series is never longer than its calendar. A series
    without a break gives no rows.
    """
    series = daily.groupBy(id, day).agg(F.sum(value).cast("double").alias("__y"), F.max(cum).alias(cum))
    schema = T.StructType([series.schema[id], series.schema[day], series.schema[cum]])

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        days, y, total = (pdf[c].to_numpy() for c in (day, "__y", cum))
        order = np.argsort(days)
        at = mean_shifts(y[order]) if len(order) > min_rows else []
        if not at:
            return pdf[[id, day, cum]].iloc[:0]
        days, total = days[order], total[order]
        return pd.DataFrame({
            id: pdf[id].iloc[0], day: np.concatenate(([0], days[at], [days.max()])), cum: np.concatenate(([0], total[at], [total.max()])),
        })

    return spread(series, [id]).groupBy(id).applyInPandas(split, schema)


def peak_growth(daily: DataFrame, id: str = "id", day: str = "event_day", value: str = "pixels", cum: str = "cum_pixels", min_duration: int = 20) -> DataFrame:
    """Fastest period between breaks per event: rate, length, pixels, first and last day.

    Only events longer than ``min_duration`` days with at least one break appear; the earliest of
    equally fast periods counts.
    """
    ends = growth_periods(daily.where(F.col("duration") > min_duration), id, day, value, cum, min_duration)
    r = consecutive_rate(ends, id, day, cum).where(F.col("rate").isNotNull())
    first = F.max_by(F.struct("rate", "span", "gain", f"prior_{day}", day), F.struct("rate", -F.col(day)))
    return r.groupBy(id).agg(first.alias("__b")).select(
        id, F.col("__b.rate").alias("pgp_fsr"), F.col("__b.span").alias("pgp_duration"), F.col("__b.gain").alias("pgp_ba_pix"),
        F.greatest(F.col(f"__b.prior_{day}"), F.lit(1)).alias("pgp_start"), F.col(f"__b.{day}").alias("pgp_end"),
    )
