"""Grouped reducers, modes, ordinals and distributions."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.operators.keys import join_keys
from cinderline.operators.ranks import bracket_aggs, bracketed_quantiles, multi_quantiles, value_counts
from cinderline.sources.tables import cut_lineage


# --- reducers ---------------------------------------------------------------------------

def strict(agg: Column, col) -> Column:
    """An aggregate that is NULL as soon as one input is; the built-ins skip NULL."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(col) == F.count(F.lit(1)), agg)


def strict_sum(col: str) -> Column:
    return strict(F.sum(col), col)


def strict_mean(col: str) -> Column:
    return strict(F.avg(col), col)


def strict_max(col: str) -> Column:
    return strict(F.max(col), col)


def date_sd(col: str) -> Column:
    """Sample standard deviation of a date, in days."""
    return F.stddev_samp(F.unix_date(F.col(col)))


def share_percent(cond: Column) -> Column:
    return F.count_if(cond) / F.count(F.lit(1)) * 100


def cell_area(cond: Column, size_km: float) -> Column:
    return F.count_if(cond) * size_km * size_km


def with_medians(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], meds: dict[str, str]) -> DataFrame:
    """Ordinary aggregates plus exact medians of named columns."""
    wanted = {a: (c, 0.5) for a, c in meds.items()}
    brackets = bracket_aggs({c: [0.5] for c in meds.values()})
    base = df.groupBy(*keys).agg(*[c.alias(a) for a, c in {**aggs, **brackets}.items()])
    return join_keys(base, bracketed_quantiles(df, base, keys, wanted), keys, "left").drop(*brackets)


#: Rows of one task where small groups are dealt by key; a group of more rows is counted by value before it meets.
MODE_ROWS = 200_000


def group_mode(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str | None = None) -> DataFrame:
    """Most frequent value per group and column; NULL counts as a value.

    Ties go to the value seen first by ``order``, or to the smallest value without one. Rows are written once and dealt by
    key over as many tasks as they fill, so a task's memory does not grow with the input. Groups larger than a task are counted by value.
    """
    keys, cols = list(keys), list(cols)
    seen = F.col(order) if order else F.lit(0)
    rows = cut_lineage(df.select(*keys, *cols, seen.alias("__order")))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // MODE_ROWS))
    large = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > MODE_ROWS).drop("__rows"))
    if large.limit(1).count() == 0:
        return _modes(rows.repartition(parts, *keys), keys, cols)
    small = join_keys(rows, large, keys, "left_anti").repartition(parts, *keys)
    return _modes(small, keys, cols).unionByName(_modes(join_keys(rows, large, keys, "left_semi"), keys, cols))


def _modes(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    # Counting whole combinations first shrinks the input once, for all columns.
    combos = rows.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("__n"), F.min("__order").alias("__seen"))
    names = [f"__v{i}" for i in range(len(cols))]
    value = lambda i, j: F.col(cols[j]) if i == j else F.lit(None).cast(rows.schema[cols[j]].dataType)
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), *[value(i, j).alias(v) for j, v in enumerate(names)]) for i in range(len(cols))]))
    per_value = combos.select(*keys, "__n", "__seen", each).groupBy(*keys, "__i", *names).agg(F.sum("__n").alias("__n"), F.min("__seen").alias("__seen"))
    best = lambda i, v: F.min(F.when(F.col("__i") == i, F.struct(-F.col("__n"), "__seen", F.col(v).isNull(), v))).getField(v)
    return per_value.groupBy(*keys).agg(*[best(i, v).alias(c) for i, (c, v) in enumerate(zip(cols, names))])


def first_by(col: str, order: str) -> Column:
    return F.min_by(F.col(col), F.col(order))


def change_over(y: str, order: str) -> Column:
    """Last value minus first value by ``order``."""
    return F.max_by(F.col(y), F.col(order)) - F.min_by(F.col(y), F.col(order))


def yearly_stats(df: DataFrame, group: str, var: str, year: str = "year") -> DataFrame:
    keys = [group, year]
    return with_medians(
        df.where(F.col(group).isNotNull()), keys,
        {"n": F.count(var), "mean": F.avg(var), "sd": F.stddev_samp(var), "min": F.min(var), "max": F.max(var)},
        {"median": var},
    ).select(*keys, "n", "mean", "sd", "min", "median", "max")


BLOCK_BYTES = 64_000_000


def nest(df: DataFrame, keys: Sequence[str], name: str = "data", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of each group as arrays, one per block; ``<name>_block`` counts a group's blocks from 0.

    A group of up to ``block_bytes`` (as JSON text) is one block. A larger one is dealt evenly over as many blocks as it fills, so
    no row and no task holds a whole large group. Rows have no order inside a block; missing keys form a group.
    """
    keys, rest = list(keys), [c for c in df.columns if c not in keys]
    # Rows are numbered in a written table, so that a repeated task deals them the same way.
    rows = cut_lineage(df.withColumn("__id", F.monotonically_increasing_id()))
    size = F.sum(F.length(F.to_json(F.struct(*rest))).cast("long"))
    blocks = rows.groupBy(*keys).agg(F.ceil(size / block_bytes).alias("__blocks"))
    dealt = join_keys(rows, blocks, keys, "inner").withColumn(f"{name}_block", F.pmod(F.xxhash64("__id"), F.greatest("__blocks", F.lit(1))).cast("int"))
    return dealt.groupBy(*keys, f"{name}_block").agg(F.collect_list(F.struct(*rest)).alias(name))


def unnest(df: DataFrame, name: str = "data") -> DataFrame:
    keep = [c for c in df.columns if c not in (name, f"{name}_block")]
    return df.select(*keep, F.inline(name))


# --- values spread back to rows -----------------------------------------------------------

def with_group_max(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Group maximum on every row. Aggregate, then join: a hot group stays spread out."""
    return join_keys(df, df.groupBy(*keys).agg(F.max(col).alias(name)), keys, "left")


def z_score(df: DataFrame, col: str, name: str) -> DataFrame:
    """Global z-score through a one-row aggregate."""
    s = df.agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s"))
    return df.crossJoin(F.broadcast(s)).withColumn(name, F.try_divide(F.col(col) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def dense_id(df: DataFrame, key: str, name: str) -> DataFrame:
    """1-based ordinal of ``key`` among its sorted distinct values.

    Each distinct key is range-partitioned; a key's ordinal is its position inside the range
    plus the number of keys in earlier ranges, so no task sees all keys.
    """
    distinct = df.select(key).where(F.col(key).isNotNull()).distinct()
    return join_keys(df, _ordinal(distinct, [key], name), [key], "left")


def row_ordinal(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """1-based row number over a total order, without a global single-task window."""
    return _ordinal(df, list(order), name)


_PARTITION_BITS = 33


def _ordinal(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Rows are range-partitioned over the whole order, sorted and numbered inside their partition, and written once.

    Splitters come from Spark's sample of all columns of the order, so keys that begin alike still spread. Only the counts of
    the partitions are cumulated in one task.
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", _PARTITION_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__before") + F.col("__id") - F.shiftleft("__part", _PARTITION_BITS) + 1).drop("__part", "__id", "__before")
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*df.columns)


def top_rows(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Every row that attains its group's maximum, ties included."""
    best = df.groupBy(*keys).agg(F.max(col).alias("__best"))
    return join_keys(df, best, keys, "inner").where(F.col(col) == F.col("__best")).drop("__best")


def consecutive_rate(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Gain, span and rate against the previous row of a series with one row per ``(key, order)``."""
    w = Window.partitionBy(key).orderBy(order)
    return (
        df.withColumns({f"prior_{value}": F.lag(value).over(w), f"prior_{order}": F.lag(order).over(w)})
        .withColumns({"gain": F.col(value) - F.col(f"prior_{value}"), "span": F.col(order) - F.col(f"prior_{order}")})
        .withColumn("rate", F.try_divide(F.col("gain"), F.col("span")))
    )


# --- distributions ------------------------------------------------------------------------

def histogram(df: DataFrame, keys: Sequence[str], col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over each group's own range; the upper edge belongs to the last bin."""
    keys = list(keys)
    data = df.where(F.col(col).isNotNull())
    span = data.groupBy(*keys).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    step = F.col("hi") - F.col("lo")
    raw = F.floor(F.try_divide((F.col(col) - F.col("lo")) * bins, step)) + 1
    return (
        join_keys(data.select(*keys, col), span, keys, "inner")
        .withColumn("bin", F.least(F.coalesce(raw, F.lit(1)), F.lit(bins)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        .select(
            *keys, "bin", "n",
            (F.col("lo") + (F.col("bin") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_lo"),
            (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"),
        )
    )


def density(df: DataFrame, keys: Sequence[str], col: str, points: int = 64, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on an even grid.

    Bandwidth 0.9 * min(sd, IQR / 1.34) * n^(-1/5); the grid runs ``cut`` bandwidths past the
    data. Equal values are merged first, so work follows the number of distinct values.
    """
    keys = list(keys)
    data = df.where(F.col(col).isNotNull())
    q = multi_quantiles(data, keys, {"__q1": (col, 0.25), "__q3": (col, 0.75)})
    s = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.stddev_samp(col).alias("__sd"), F.min(col).alias("__lo"), F.max(col).alias("__hi"),
    )
    iqr = (F.col("__q3") - F.col("__q1")) / 1.34
    spread = F.when(iqr > 0, F.least("__sd", iqr)).otherwise(F.col("__sd"))
    h = join_keys(s, q, keys, "inner").withColumn("__h", spread * 0.9 * F.pow(F.col("__n"), F.lit(-0.2))).where(F.col("__h") > 0)
    rows = join_keys(value_counts(data, keys, col), h, keys, "inner").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    start, stop = F.col("__lo") - cut * F.col("__h"), F.col("__hi") + cut * F.col("__h")
    x = start + F.col("i") * (stop - start) / (points - 1)
    z = (F.col("x") - F.col("value")) / F.col("__h")
    return (
        rows.withColumn("x", x)
        .groupBy(*keys, "i", "x")
        .agg((F.sum(F.col("n") * F.exp(-z * z / 2)) / F.first(F.col("__n") * F.col("__h") * 2.5066282746310002)).alias("density"))
    )
