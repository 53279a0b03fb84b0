"""Exact ranks and quantiles that never sort one whole group in one task.

Quantiles: an approximate quantile sketch, built map-side, brackets each wanted position. A second pass
counts every row outside the brackets without keeping its value and counts the few values
inside them one by one, so the exact order statistic is read from a small table. Should a
bracket ever miss its position the query fails rather than return a wrong value.

Ranks: values are counted per ``(keys, value)``, which spreads a hot group over the cluster
by value. Approximate quantiles cut each group's axis into buckets; they only decide where
the cuts fall. Running totals over buckets and inside each bucket give exact cumulative counts.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderline.operators.keys import join_keys

BUCKETS = 64


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, extra=None) -> DataFrame:
    """``keys, value, n`` for non-missing values; ``extra`` adds further sums per value."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.where(f"`{value}` is not null")
        .groupBy(*keys, F.expr(f"`{value}` as value"))
        .agg(n.alias("n"), *[c.alias(a) for a, c in (extra or {}).items()])
    )


def _search(lo: int, hi: int) -> str:
    """How many of the sorted ``__cuts[lo:hi]`` are below ``value``, as a binary decision tree."""
    if lo == hi:
        return str(lo)
    mid = (lo + hi) // 2
    return f"case when value > get(__cuts, {mid}) then {_search(mid + 1, hi)} else {_search(lo, mid)} end"


def bucketed(counts: DataFrame, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    probs = [i / buckets for i in range(1, buckets)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("value", probs, 1000).alias("__cuts"))
    bucket = F.expr(_search(0, buckets - 1))
    return join_keys(counts, cuts, keys, "inner").withColumn("__bucket", bucket).drop("__cuts")


def bucket_totals(b: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Per bucket: ``__before`` (count in earlier buckets), ``__in`` and the group's ``total``."""
    part = "partition by " + ", ".join(f"`{k}`" for k in keys) if keys else ""
    before = lambda e: f"sum(`__in{e}`) over ({part} order by __bucket rows between unbounded preceding and current row) - `__in{e}` as `__before{e}`"
    return (
        b.groupBy(*keys, "__bucket").agg(F.expr("sum(n) as __in"), *[F.expr(f"sum(`{e}`) as `__in_{e}`") for e in extra])
        .selectExpr(
            *[f"`{k}`" for k in keys], "__bucket", "__in", before(""), f"sum(__in) over ({part}) as total",
            *[before(f"_{e}") for e in extra],
        )
    )


def cumulative_counts(counts: DataFrame, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Add ``cum`` (rows at or below the value) and ``total``, plus ``cum_<e>`` for summed extras."""
    b = bucketed(counts, keys)
    t = bucket_totals(b, keys, extra).drop("__in")
    run = Window.partitionBy(*keys, "__bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return (
        join_keys(b, t, [*keys, "__bucket"], "inner")
        .withColumns({
            "cum": F.col("__before") + F.sum("n").over(run),
            **{f"cum_{e}": F.col(f"__before_{e}") + F.sum(e).over(run) for e in extra},
        })
        .drop("__bucket", "__before", *[f"__before_{e}" for e in extra])
    )


ACCURACY = 50_000
MARGIN = 2e-4
WHOLE = 20_000


def bracket_aggs(cols: dict[str, Sequence[float]]) -> dict[str, Column]:
    """Aggregates (count and bracket ends per column) that :func:`bracketed_quantiles` needs."""
    out = {}
    for c, probs in cols.items():
        ends = [min(1.0, max(0.0, q)) for p in sorted(probs) for q in (p - MARGIN, p + MARGIN)]
        listed = ", ".join(f"{e!r}D" for e in ends)
        out[f"__n_{c}"] = F.expr(f"count(`{c}`)")
        out[f"__cuts_{c}"] = F.expr(f"percentile_approx(cast(`{c}` as double), array({listed}), {ACCURACY})")
    return out


def bracketed_quantiles(df: DataFrame, stats: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact interpolated quantiles; ``wanted`` maps output names to (column, probability)."""
    keys = list(keys)
    cols = {c: sorted(p for q, p in wanted.values() if q == c) for c, _ in wanted.values()}
    s = stats.select(*keys, *[f"__{k}_{c}" for c in cols for k in ("n", "cuts")])
    size = max(2 * len(p) for p in cols.values())
    entries = ", ".join(
        f"struct('{c}' as col, cast(`{c}` as double) as v, `__n_{c}` as total, `__cuts_{c}` as cuts)" for c in cols
    )
    long = join_keys(df.select(*keys, *cols), s, keys, "inner").select(*keys, F.expr(f"inline(array({entries}))")).where("v is not null")
    # Shorter cut lists end in NULL, which no value exceeds.
    side = " + ".join(f"cast(coalesce(v > get(cuts, {i}), false) as int)" for i in range(size))
    table = (
        long.withColumn("side", F.expr(f"case when total <= {WHOLE} then 0 else {side} end"))
        .groupBy(*keys, "col", "total", "side", F.expr(
            f"case when total <= {WHOLE} or side % 2 = 1 or array_contains(cuts, v) then v end as v"
        )).agg(F.expr("count(*) as n"))
    )
    by = ", ".join(f"`{k}`" for k in (*keys, "col"))
    cum = table.withColumn("cum", F.expr(
        f"sum(n) over (partition by {by} order by side, v asc nulls first rows between unbounded preceding and current row)"
    ))
    out = []
    for a, (c, p) in wanted.items():
        pos = f"({p!r}D * (total - 1) + 1)"
        hit = f"(col = '{c}' and floor({pos}) <= cum and ceil({pos}) > cum - n)"
        v = f"case when {hit} then coalesce(v, cast(raise_error('quantile bracket missed its position') as double)) end"
        frac = f"max(case when col = '{c}' then {pos} - floor({pos}) end)"
        out.append(F.expr(f"min({v}) + (max({v}) - min({v})) * {frac} as `{a}`"))
    return cum.groupBy(*keys).agg(*out)


def multi_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact interpolated quantiles of several columns, two passes over the input."""
    cols = {c: [p for q, p in wanted.values() if q == c] for c, _ in wanted.values()}
    stats = df.groupBy(*keys).agg(*[e.alias(a) for a, e in bracket_aggs(cols).items()])
    return bracketed_quantiles(df, stats, keys, wanted)


def medians(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Exact medians of several columns: ``cols`` maps output names to input columns."""
    return multi_quantiles(df, keys, {a: (c, 0.5) for a, c in cols.items()})
