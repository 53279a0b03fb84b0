"""Fire-study tables derived from the benchmark tables, with the same expressions in both engines.

Each view has a Spark form (DataFrame) and a SQL text used as a common table expression
by the comparison queries.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIRE_EXPRS = {
    "fire_id": "o_orderkey",
    "ignition_date": "cast(o_orderdate as date)",
    "ignition_year": "year(o_orderdate)",
    "ignition_month": "month(o_orderdate)",
    "ignition_doy": "dayofyear(o_orderdate)",
    "l1_eco": "case when o_orderkey % 97 = 0 then null else cast(r_regionkey + 5 as varchar(3)) end",
    "l1_ecoregion": "case when o_orderkey % 97 = 0 then null else r_name end",
    "us_l3name": "n_name",
    "lc_name": "case when o_orderkey % 89 = 0 then null else o_orderpriority end",
    "fsr_ha_per_day": "o_totalprice / 1000",
    "fsr_km2_per_day": "o_totalprice / 100000",
    "fsr_acres_per_day": "o_totalprice / 404.686",
    "max_growth_ha": "case when r_name = 'ASIA' and o_orderpriority = '2-HIGH' then m else coalesce(m, 2500.0) end / 10",
    "max_growth_km2": "case when r_name = 'ASIA' and o_orderpriority = '2-HIGH' then m else coalesce(m, 2500.0) end / 1000",
    "total_area_ha": "case when r_name = 'ASIA' and o_orderpriority = '2-HIGH' then s else coalesce(s, 2500.0) end / 10",
    "total_area_km2": "case when r_name = 'ASIA' and o_orderpriority = '2-HIGH' then s else coalesce(s, 2500.0) end / 1000",
    "duration": "cast(case when r_name = 'ASIA' and o_orderpriority = '2-HIGH' then lines else coalesce(lines, 1) end as int)",
    "x": "cast((o_orderkey * 7919 + o_custkey * 104729) % 4600000 - 2300000 as double)",
    "y": "cast((o_orderkey * 15485863 + o_custkey * 31) % 2900000 - 2100000 as double)",
}
_CELL_EXPRS = {
    "cx": "p_partkey % 50",
    "cy": "cast(floor(p_partkey / 50) as bigint)",
    "home_density": "p_retailprice / 100",
    "road_density": "case when p_size % 10 = 0 then 0.0e0 else cast(p_size as double) end",
    "landcover": "p_size % 17",
    "year": "cast(2001 + p_partkey % 3 as int)",
}
_ROAD_EXPRS = {
    "line_id": "p_partkey",
    "x1": "cast((p_partkey * 7919) % 4000000 - 2000000 as double)",
    "y1": "cast((p_partkey * 104729) % 2500000 - 1900000 as double)",
    "x2": "cast((p_partkey * 7919) % 4000000 - 2000000 + (p_partkey % 7 - 3) * 35000 as double)",
    "y2": "cast((p_partkey * 104729) % 2500000 - 1900000 + (p_partkey % 5 - 2) * 35000 as double)",
}


def _list(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} as {a}" for a, e in exprs.items())


_SQL = {
    "fires": f"""fires as (select {_list(_FIRE_EXPRS)} from orders
 join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 join region on n_regionkey = r_regionkey
 left join (select l_orderkey as k, count(*) as lines, sum(l_extendedprice) as s,
  max(l_extendedprice) as m from lineitem group by l_orderkey) l on o_orderkey = k)""",
    "daily": """daily0 as (select user_id as id, cast(ts as date) as d, count(*) as pixels,
 min(event_type) as lc_name from events group by user_id, cast(ts as date)),
daily as (select id, cast(d as varchar) as date, cast(day(d) as int) as event_day, pixels,
 cast(sum(pixels) over w as bigint) as cum_pixels, sum(pixels) over w * 0.25e0 as cum_area_km2,
 cast(max(day(d)) over (partition by id) - min(day(d)) over (partition by id) + 1 as int) as duration,
 lc_name, r_name as l1_ecoregion from daily0 join region on r_regionkey = id % 5
 window w as (partition by id order by d))""",
    "cells": f"cells as (select {_list(_CELL_EXPRS)} from part)",
    "roads": f"roads as (select {_list(_ROAD_EXPRS)} from part)",
    "blocks": """blocks as (select n_nationkey as zone, n_name as us_l3name, r_name as na_l1name,
 n_nationkey % 2 = 0 as holed, -2300000.0e0 + 920000 * (n_nationkey % 5) as x0,
 -2100000.0e0 + 580000 * cast(floor(n_nationkey / 5) as int) as y0
 from nation join region on n_regionkey = r_regionkey)""",
}
# A point is in a zone when it is in the block and not in the block's hole or notch.
IN_ZONE = """(x >= x0 and x < x0 + 920000 and y >= y0 and y < y0 + 580000
 and not (holed and x >= x0 + 230000 and x < x0 + 460000 and y >= y0 + 145000 and y < y0 + 290000)
 and not (not holed and x >= x0 + 690000 and y >= y0 + 435000))"""


def _overlap(a, b):
    side = lambda i: f"greatest(0e0, least(({a[i]}) + ({a[i + 2]}), ({b[i]}) + ({b[i + 2]})) - greatest({a[i]}, {b[i]}))"
    return f"({side(0)} * {side(1)})"


def zone_area(*box: str, block: str = "") -> str:
    """SQL for the area that the rectangle ``x, y, width, height`` shares with a zone: with its block less its hole or notch."""
    x0, y0, holed = (f"{block}{c}" for c in ("x0", "y0", "holed"))
    cut = f"case when {holed} then {x0} + 230000 else {x0} + 690000 end", f"case when {holed} then {y0} + 145000 else {y0} + 435000 end", "230000", "145000"
    return f"({_overlap(box, (x0, y0, '920000', '580000'))} - {_overlap(box, cut)})"


def sql(views: str, body: str) -> str:
    """``WITH`` the named views, then ``body`` (which may itself start with further CTEs after a comma)."""
    head = "with recursive " + ",\n".join(_SQL[v] for v in views.split())
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exprs(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(a) for a, e in exprs.items()])


def fires(spark: SparkSession, sf_dir: str, task_rows: int | None = None) -> DataFrame:
    """With ``task_rows``, joins are dealt by key over tasks of about so many lines where these are more than the shuffle partitions."""
    t = lambda n: table(spark, sf_dir, n)
    lineitem, orders, customer = t("lineitem"), t("orders"), t("customer")
    parts = -(-lineitem.count() // task_rows) if task_rows else 0
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lineitem, orders, customer = lineitem.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_custkey"), customer.repartition(parts, "c_custkey")
    lines = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("s"), F.max("l_extendedprice").alias("m"),
    )
    joined = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(lines, F.col("o_orderkey") == F.col("k"), "left")
    )
    return _exprs(joined, _FIRE_EXPRS)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One row per id and day first, so the windows below see at most one row per calendar day.
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("pixels"), F.min("event_type").alias("lc_name")
    )
    region = table(spark, sf_dir, "region")
    w, whole = Window.partitionBy("id").orderBy("d"), Window.partitionBy("id")
    day = F.day("d")
    return days.select(
        "id", F.col("d").cast("string").alias("date"), day.cast("int").alias("event_day"), "pixels",
        F.sum("pixels").over(w).alias("cum_pixels"), (F.sum("pixels").over(w) * 0.25).alias("cum_area_km2"),
        (F.max(day).over(whole) - F.min(day).over(whole) + 1).cast("int").alias("duration"), "lc_name",
    ).join(region, F.col("r_regionkey") == F.col("id") % 5).drop("r_regionkey").withColumnRenamed("r_name", "l1_ecoregion")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exprs(table(spark, sf_dir, "part"), _CELL_EXPRS)


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exprs(table(spark, sf_dir, "part"), _ROAD_EXPRS)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One polygon per nation: a block with a hole (even keys) or without a corner (odd keys)."""
    b = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("zone"), F.col("n_name").alias("us_l3name"), F.col("r_name").alias("na_l1name"),
        (F.col("n_nationkey") % 2 == 0).alias("holed"),
        (F.lit(-2300000.0) + 920000 * (F.col("n_nationkey") % 5)).alias("x0"),
        (F.lit(-2100000.0) + 580000 * F.floor(F.col("n_nationkey") / 5)).alias("y0"),
    )

    def ring(*corners):
        pts = [F.struct((F.col("x0") + dx).alias("x"), (F.col("y0") + dy).alias("y")) for dx, dy in corners]
        return F.array(*pts, pts[0])

    block = ring((0, 0), (920000, 0), (920000, 580000), (0, 580000))
    hole = ring((230000, 145000), (230000, 290000), (460000, 290000), (460000, 145000))
    notched = ring((0, 0), (920000, 0), (920000, 435000), (690000, 435000), (690000, 580000), (0, 580000))
    geom = F.when(F.col("holed"), F.array(F.array(block, hole))).otherwise(F.array(F.array(notched)))
    return b.select("zone", "us_l3name", "na_l1name", geom.alias("geom"))
