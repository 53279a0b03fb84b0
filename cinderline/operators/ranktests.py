"""Rank tests by group."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.functions.tails import chi2_p
from cinderline.operators.keys import join_keys
from cinderline.operators.ranks import cumulative_counts, value_counts


def kruskal(df: DataFrame, keys: Sequence[str], cls: str, value: str) -> DataFrame:
    """Kruskal-Wallis per group: ``n, classes, h, df, p``; average ranks and the tie correction."""
    keys = list(keys)
    rows = df.where(F.col(cls).isNotNull())
    ranks = cumulative_counts(value_counts(rows, keys, value), keys).withColumn(
        "rank", F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
    )
    by_class = value_counts(rows, [*keys, cls], value).withColumnRenamed("n", "m")
    n = F.col("n").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(n * n * n - n).alias("ties"), F.first("total").cast("double").alias("total"))
    sums = join_keys(by_class, ranks.select(*keys, "value", "rank"), [*keys, "value"], "inner").groupBy(*keys, cls).agg(
        F.sum(F.col("m") * F.col("rank")).alias("r"), F.sum("m").alias("nc")
    )
    core = sums.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("nc")).alias("core"), F.count(F.lit(1)).alias("classes"))
    t = F.col("total")
    h = (12 / (t * (t + 1)) * F.col("core") - 3 * (t + 1))
    return join_keys(core, ties, keys, "inner").select(
        *keys, t.cast("long").alias("n"), "classes",
        F.when(F.col("classes") > 1, F.try_divide(h, 1 - F.try_divide(F.col("ties"), t * t * t - t))).alias("h"),
        (F.col("classes") - 1).cast("int").alias("df"),
    ).withColumn("p", chi2_p(F.col("h"), F.col("df").cast("double")))
