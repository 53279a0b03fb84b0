"""Upper tails of the usual test statistics, applied to summary rows only.

Published series: incomplete beta by continued fraction, incomplete gamma by series or
continued fraction, signed-rank by the subset-sum recurrence.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 1e-16


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _lentz(term, b0: float) -> float:
    """Continued fraction b0 + a1/(b1 + a2/(b2 + ...)); ``term(i)`` gives ``(a_i, b_i)``."""
    f = b0 or _TINY
    c, d = f, 0.0
    for i in range(1, 2000):
        a, b = term(i)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        f *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return f


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)

    def term(i):
        if i == 1:
            return 1.0, 1.0
        m = (i - 1) // 2
        if i % 2 == 0:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _lentz(term, 0.0) / a


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        total = term = 1.0 / s
        k = s
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    return front * _lentz(lambda i: (1.0, x + 1.0 - s) if i == 1 else (-(i - 1) * (i - 1 - s), x + 2 * i - 1.0 - s), 0.0)


def student_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def signed_rank_two_sided(v: float, n: int) -> float:
    """Exact two-sided tail of the signed-rank statistic for ``n`` untied, nonzero differences."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for k in range(1, n + 1):
        ways[k:] += ways[:-k].copy()
    cdf = np.cumsum(ways) / 2.0**n
    v = int(round(v))
    tail = 1.0 - cdf[v - 1] if v > n * (n + 1) / 4 else cdf[v]
    return min(1.0, 2.0 * tail)


def _vector(fn):
    def apply(*cols: pd.Series) -> pd.Series:
        return pd.Series([
            None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*cols)
        ], dtype="float64")
    return apply


def normal_p(z) -> Column:
    def tail(a: pd.Series) -> pd.Series:
        return _vector(normal_two_sided)(a)
    return F.pandas_udf(tail, "double")(z)


def student_p(t, df) -> Column:
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return _vector(lambda u, d: student_two_sided(u, d) if d > 0 else None)(a, b)
    return F.pandas_udf(tail, "double")(t, df)


def f_p(f, d1, d2) -> Column:
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _vector(lambda u, p, q: f_upper(u, p, q) if p > 0 and q > 0 and u >= 0 else None)(a, b, c)
    return F.pandas_udf(tail, "double")(f, d1, d2)


def chi2_p(x, df) -> Column:
    def tail(a: pd.Series, b: pd.Series) -> pd.Series:
        return _vector(lambda u, d: chi2_upper(u, d) if d > 0 else None)(a, b)
    return F.pandas_udf(tail, "double")(x, df)
