"""Least-squares lines by group from sums, their summaries, predictions and factor interactions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.functions.tails import f_p, student_p
from cinderline.operators.keys import join_keys


def _moments(y: Column, x: Column) -> list[Column]:
    return [
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("xbar"), F.regr_avgy(y, x).alias("ybar"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"),
    ]


def ols(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``keys, n, xbar, ybar, sxx, sxy, syy, slope, intercept, rss``; rows with a missing value leave the fit."""
    s = df.groupBy(*keys).agg(*_moments(F.col(y).cast("double"), F.col(x).cast("double"))).where(F.col("n") > 0)
    slope = F.when(F.col("sxx") > 0, F.try_divide("sxy", "sxx"))
    return s.withColumn("slope", slope).withColumns({
        "intercept": F.when(F.col("slope").isNull(), F.col("ybar")).otherwise(F.col("ybar") - F.col("slope") * F.col("xbar")),
        "rss": F.greatest(F.col("syy") - F.coalesce(F.col("slope") * F.col("sxy"), F.lit(0.0)), F.lit(0.0)),
    })


def _summary(df: DataFrame, n: Column, rank: Column, rss: Column, tss: Column) -> DataFrame:
    left = n - rank
    r2 = 1 - F.try_divide(rss, tss)
    f = F.try_divide(F.try_divide(tss - rss, rank - 1), F.try_divide(rss, left))
    t = df.select(
        "*", r2.alias("r_squared"),
        (1 - (1 - r2) * F.try_divide(n - 1, left)).alias("adj_r_squared"),
        F.sqrt(F.try_divide(rss, left)).alias("sigma"), f.alias("statistic"),
        (rank - 1).cast("int").alias("df"), left.cast("int").alias("df_residual"),
    )
    return t.withColumn("p_value", f_p(F.col("statistic"), F.col("df").cast("double"), F.col("df_residual").cast("double")))


def glance(fit: DataFrame) -> DataFrame:
    """Model summary per group of :func:`ols`."""
    rank = F.when(F.col("slope").isNotNull(), 2).otherwise(1)
    return _summary(fit, F.col("n"), rank, F.col("rss"), F.col("syy"))


def interaction_levels(df: DataFrame, keys: Sequence[str], factor: str, x: str, y: str) -> DataFrame:
    """One line per factor level: the fit of ``y ~ x * factor``."""
    return ols(df.where(F.col(factor).isNotNull()), [*keys, factor], x, y)


def interaction_glance(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled summary of the interaction fit; a level with one distinct x adds one to the rank."""
    grand = levels.groupBy(*keys).agg((F.sum(F.col("n") * F.col("ybar")) / F.sum("n")).alias("__g"))
    pooled = join_keys(levels, grand, keys, "inner").groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("rss").alias("rss"),
        F.sum(F.col("syy") + F.col("n") * (F.col("ybar") - F.col("__g")) * (F.col("ybar") - F.col("__g"))).alias("tss"),
        F.sum(F.when(F.col("slope").isNotNull(), 2).otherwise(1)).alias("rank"),
    )
    return _summary(pooled, F.col("n"), F.col("rank"), F.col("rss"), F.col("tss")).drop("rank")


def _with_t(rows: DataFrame) -> DataFrame:
    t = rows.withColumn("statistic", F.try_divide("estimate", "std_error"))
    return t.withColumn("p_value", student_p(F.col("statistic"), F.col("__df").cast("double"))).drop("__df")


def tidy(fit: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Coefficient table per group: ``term, estimate, std_error, statistic, p_value``."""
    s = F.sqrt(F.try_divide(F.col("rss"), F.col("n") - 2))
    terms = F.array(
        F.struct(F.lit("(Intercept)").alias("term"), F.col("intercept").alias("estimate"),
                 (s * F.sqrt(1 / F.col("n") + F.try_divide(F.col("xbar") * F.col("xbar"), F.col("sxx")))).alias("std_error")),
        F.struct(F.lit(x).alias("term"), F.col("slope").alias("estimate"), F.try_divide(s, F.sqrt("sxx")).alias("std_error")),
    )
    return _with_t(fit.select(*keys, (F.col("n") - 2).alias("__df"), F.explode(terms).alias("__t")).select(*keys, "__df", "__t.*"))


def interaction_tidy(levels: DataFrame, keys: Sequence[str], factor: str, x: str) -> DataFrame:
    """Treatment-contrast coefficients: the first level is the base, others are differences from it."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    rank = F.when(F.col("slope").isNotNull(), 2).otherwise(1)
    base = lambda c: F.first(c).over(w.orderBy(factor).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    va = 1 / F.col("n") + F.try_divide(F.col("xbar") * F.col("xbar"), F.col("sxx"))
    vb = F.try_divide(F.lit(1.0), F.col("sxx"))
    m = levels.withColumns({"va": va, "vb": vb}).withColumns({
        "__df": F.sum(F.col("n") - rank).over(w), "__rss": F.sum("rss").over(w), "__base": base(factor),
        "a0": base("intercept"), "b0": base("slope"), "va0": base("va"), "vb0": base("vb"),
    })
    s = F.sqrt(F.try_divide("__rss", "__df"))
    is_base = F.col(factor) == F.col("__base")
    first = lambda own, diff: F.when(is_base, own).otherwise(diff)
    a, b, va, vb = F.col("intercept"), F.col("slope"), F.col("va"), F.col("vb")
    terms = F.array(
        F.struct(first(F.lit("(Intercept)"), F.concat(F.lit(factor), F.col(factor))).alias("term"),
                 first(a, a - F.col("a0")).alias("estimate"), (s * F.sqrt(first(va, va + F.col("va0")))).alias("std_error")),
        F.struct(first(F.lit(x), F.concat(F.lit(f"{x}:{factor}"), F.col(factor))).alias("term"),
                 first(b, b - F.col("b0")).alias("estimate"), (s * F.sqrt(first(vb, vb + F.col("vb0")))).alias("std_error")),
    )
    return _with_t(m.select(*keys, "__df", F.explode(terms).alias("__t")).select(*keys, "__df", "__t.*"))


def augment(df: DataFrame, fit: DataFrame, keys: Sequence[str], x: str, y: str | None = None, z: float = 1.96) -> DataFrame:
    """Rows with ``fitted, se_fit, lower, upper`` (and ``resid`` given ``y``) from the group's line."""
    cols = ["n", "xbar", "sxx", "slope", "intercept", "rss"]
    c = fit.select(*keys, *[F.col(k).alias(f"__{k}") for k in cols])
    j = join_keys(df, c, keys, "inner")
    s = F.sqrt(F.try_divide(F.col("__rss"), F.col("__n") - 2))
    d = F.col(x) - F.col("__xbar")
    out = j.withColumns({
        "fitted": F.col("__intercept") + F.coalesce(F.col("__slope") * F.col(x), F.lit(0.0)),
        "se_fit": s * F.sqrt(1 / F.col("__n") + F.try_divide(d * d, F.col("__sxx"))),
    }).withColumns({"lower": F.col("fitted") - z * F.col("se_fit"), "upper": F.col("fitted") + z * F.col("se_fit")})
    if y is not None:
        out = out.withColumn("resid", F.col(y) - F.col("fitted"))
    return out.drop(*[f"__{k}" for k in cols])


def predict(df: DataFrame, coefs: DataFrame, keys: Sequence[str], x: str, name: str = "predicted") -> DataFrame:
    """``intercept + slope * x`` on new rows; rows of an unknown group have no prediction."""
    c = coefs.select(*keys, F.col("intercept").alias("__a"), F.col("slope").alias("__b"))
    return join_keys(df, c, keys, "left").withColumn(name, F.col("__a") + F.col("__b") * F.col(x)).drop("__a", "__b")


def correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``n, r, r_squared, t, p`` per group; a constant column has no correlation."""
    s = df.groupBy(*keys).agg(*_moments(F.col(y).cast("double"), F.col(x).cast("double")))
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    t = s.withColumn("r", r).withColumn("r_squared", F.col("r") * F.col("r")).withColumn(
        "t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2.0), F.sqrt(1 - F.col("r_squared")))
    )
    return t.where(F.col("n") > 2).withColumn("p", student_p(F.col("t"), (F.col("n") - 2).cast("double"))).select(*keys, "n", "r", "r_squared", "t", "p")


def smooth_lines(df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 80) -> DataFrame:
    """Fitted line and band of each group on an even grid over its x range."""
    fit = ols(df, keys, x, y)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    span = df.where(both).groupBy(*keys).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    grid = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        x, F.col("__lo") + F.col("i") * (F.col("__hi") - F.col("__lo")) / (points - 1)
    ).drop("__lo", "__hi")
    return augment(grid, fit, keys, x)
