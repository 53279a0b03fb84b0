"""Joins on keys that may be missing: NULL matches NULL."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join; the key columns of ``left`` survive. Spark chooses the physical join."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.expr(" and ".join(f"`{k}` <=> `__r_{k}`" for k in keys))
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two tables share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError(f"no shared column: {left.columns} and {right.columns}")
    return join_keys(left, right, shared, "left")


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("__k")), F.col(left_key).eqNullSafe(F.col("__k")), "left_semi")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by key for Python work per group.

    The number of partitions is explicit, so small but slow groups are not merged into few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
