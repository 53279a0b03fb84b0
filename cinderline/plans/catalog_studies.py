"""Registered queries: grid maps, trends, exposure, burned area and raster studies."""

from pyspark.sql import functions as F

from cinderline.functions import columns as C
from cinderline.operators import breaks as B
from cinderline.operators import cells as R
from cinderline.operators import grouping as G
from cinderline.operators import mixed as X
from cinderline.operators import models as M
from cinderline.operators import ranktests as K
from cinderline.operators import segments as E
from cinderline.operators import spatial as S
from cinderline.operators import trend as T
from cinderline.operators.keys import join_keys
from cinderline.plans import oracle as O
from cinderline.plans import studies as P
from cinderline.plans import tables as PT
from cinderline.plans.registry import query, rounded
from cinderline.sources import views as V

BOX = (-2300000.0, -2100000.0, 2300000.0, 800000.0)
X0, Y0 = BOX[:2]
CELL = 50000.0

# --- grid maps -------------------------------------------------------------------------------

_GRID = f"""grid as (select cell_id, cx, cy, x, y, round(sum(land) / 1e6, 6) as land_km2 from (select g.*, {V.zone_area('x - 25000', 'y - 25000', '50000', '50000')} as land
 from (select 92 * iy + ix + 1 as cell_id, ix as cx, iy as cy, {X0}e0 + (ix + 0.5e0) * 50000 as x, {Y0}e0 + (iy + 0.5e0) * 50000 as y
 from range(0, 92) a(ix), range(0, 58) b(iy)) g join blocks on x - 25000 < x0 + 920000 and x + 25000 > x0 and y - 25000 < y0 + 580000 and y + 25000 > y0) where land > 0 group by all),
summ as (select g.*, s.* exclude (cx, cy),
 case when fsr_ha < 15 then '< 15' when fsr_ha < 40 then '15 - 40' when fsr_ha < 100 then '40 - 100' when fsr_ha < 400 then '100 - 400' when fsr_ha is not null then '> 400' end as class_fsr,
 case when freq <= 25 then '1 - 25' when freq < 100 then '25 - 100' when freq < 250 then '100 - 250' when freq < 500 then '250 - 500' else '> 500' end as class_freq,
 case when mean_max_growth < 100 then '< 100' when mean_max_growth < 200 then '100 - 200' when mean_max_growth < 500 then '200 - 500' when mean_max_growth < 2000 then '500 - 2000' when mean_max_growth is not null then '> 2000' end as class_max_fsr,
 case when max_max_growth < 200 then '< 200' when max_max_growth < 500 then '200 - 500' when max_max_growth < 2000 then '500 - 2,000' when max_max_growth < 10000 then '2,000 - 10,000' when max_max_growth is not null then '> 10,000' end as class_max_max_fsr
 from (select floor((x + 2300000) / 50000) as cx, floor((y + 2100000) / 50000) as cy, count(*) as freq,
  avg(fsr_ha_per_day) as fsr_ha, case when count(max_growth_ha) = count(*) then avg(max_growth_ha) end as mean_max_growth,
  case when count(max_growth_ha) = count(*) then max(max_growth_ha) end as max_max_growth from fires join blocks on {V.IN_ZONE} group by 1, 2) s
 join grid g on g.cx = s.cx and g.cy = s.cy)"""


def _grid(spark, sf):
    return P.land_cells(spark, V.zones(spark, sf), "zone", BOX, CELL)


def _summary(spark, sf):
    grid, zones = _grid(spark, sf), V.zones(spark, sf)
    return P.cell_summary(P.land_points(V.fires(spark, sf), grid, zones, "zone", CELL, X0, Y0), grid, CELL, X0, Y0)


@query("q08_cell_summary", V.sql("fires blocks", f", {_GRID} select * replace (round(fsr_ha, 8) as fsr_ha, round(mean_max_growth, 6) as mean_max_growth, round(max_max_growth, 6) as max_max_growth) from summ"))
def q08(spark, sf):
    return rounded(_summary(spark, sf), fsr_ha=8)


@query("q09_extreme_share", V.sql("fires blocks", f""", {_GRID} select count(*) filter (where class_max_max_fsr = '> 10,000') as n_extreme_cells,
 count(*) filter (where class_max_max_fsr = '> 10,000') * 2500e0 as extreme_km2,
 round(count(*) filter (where class_max_max_fsr = '> 10,000') * 100e0 / count(*), 6) as extreme_percent
 from grid left join summ using (cell_id)"""))
def q09(spark, sf):
    grid = _grid(spark, sf)
    return rounded(P.extreme_share(P.all_cells(grid, _summary(spark, sf)), 50.0))


@query("q10_extreme_by_zone", V.sql("fires blocks", f""", {_GRID} select us_l3name, count(*) as n_extreme_cells from summ join blocks on {V.IN_ZONE}
 where max_max_growth > 10000 group by us_l3name"""))
def q10(spark, sf):
    return P.extreme_by_zone(_summary(spark, sf), V.zones(spark, sf), "zone", "us_l3name")


_HOMES = """homes as (select g.*, homes_n, roads_km, homes_n / nullif(roads_km, 0) as h from grid g join
 (select floor((-250000e0 + (cx + 0.5e0) * 10000 + 2300000) / 50000) as cx, floor((-200000e0 + (cy + 0.5e0) * 10000 + 2100000) / 50000) as cy,
  sum(home_density) as homes_n, sum(road_density) as roads_km from cells group by 1, 2) z on g.cx = z.cx and g.cy = z.cy),
classed as (select * exclude (h), h as homes_per_km_road, case when h > 0 and h <= 5 then '0-5' when h > 5 and h <= 10 then '5-10'
 when h > 10 and h <= 20 then '10-20' when h > 20 and h <= 50 then '20-50' when h > 50 and h <= 100 then '50-100' when h > 100 and h <= 100000000 then '100+' end as classes from homes)"""


def _homes(spark, sf):
    raster = V.cells(spark, sf).select("cx", "cy", F.col("home_density").alias("homes"), F.col("road_density").alias("roads"))
    return P.homes_per_road(raster, 10000.0, -250000.0, -200000.0, _grid(spark, sf), CELL, X0, Y0)


@query("q11_homes_per_road", V.sql("fires cells blocks", f""", {_GRID}, {_HOMES} select * replace (round(homes_n, 6) as homes_n, round(roads_km, 6) as roads_km, round(homes_per_km_road, 6) as homes_per_km_road) from classed"""))
def q11(spark, sf):
    return rounded(_homes(spark, sf))


@query("q11_fast_fires_and_homes", V.sql("fires cells blocks", f""", {_GRID}, {_HOMES} select c.cell_id, classes, freq, class_max_max_fsr, round(max_max_growth, 6) as max_max_growth
 from classed c join summ using (cell_id) where max_max_growth > 9999"""))
def q11b(spark, sf):
    return rounded(P.fast_fires_and_homes(_homes(spark, sf), _summary(spark, sf)).select("cell_id", "classes", "freq", "class_max_max_fsr", "max_max_growth"))


def _layer(spark, sf, name):
    return V.cells(spark, sf).select("cx", "cy", F.col(name).alias("value"))


@query("q12_homes_raster_classes", V.sql("cells", """, h as (select -250000e0 + (cx + 0.5e0) * 10000 as x, -200000e0 + (cy + 0.5e0) * 10000 as y,
 home_density / nullif(road_density, 0) as v from cells) select classes, count(*) as n, round(sum(v), 6) as total, round(avg(x), 6) as mean_x, round(avg(y), 6) as mean_y from
 (select *, case when v <= 5 then '0-5' when v <= 10 then '5-10' when v <= 20 then '10-20' when v <= 50 then '20-50' when v <= 100 then '50-100' else '100+' end as classes
 from h where v > 0) group by classes"""))
def q12(spark, sf):
    ratio = R.divide(_layer(spark, sf, "home_density"), _layer(spark, sf, "road_density")).withColumn("value", C.zero_to_null("value"))
    p = P.homes_raster_classes(ratio, 10000.0, -250000.0, -200000.0)
    return rounded(p.groupBy("classes").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y")))


# --- trends ---------------------------------------------------------------------------------------

def _trend_cte(src, keys):
    """``long`` (keys, m, yr, v) to ``wide`` (keys, n, trends, p-values) for the three metrics."""
    k = ", ".join(keys)
    return f""", base as ({src}), cnt as (select {k}, count(*) as n from base group by {k}),
long as (select {k}, m, ignition_year as yr, v from (select b.*, unnest(['mean_fsr', 'max_growth', 'duration']) as m,
 unnest([fsr_ha_per_day, max_growth_ha, cast(duration as double)]) as v from base b join cnt using ({k}) where n > 10) where v is not null),
sl as (select {', '.join('a.' + c for c in keys)}, a.m, (b.v - a.v) / (b.yr - a.yr) as s from long a join long b on {' and '.join(f'a.{c} = b.{c}' for c in keys)} and a.m = b.m and a.yr < b.yr),
{O.signed_rank('sl', k + ', m')},
med as (select {k}, m, median(s) as slope from sl group by {k}, m),
fit as (select med.*, p from med left join wx using ({k}, m)),
wide as (select {k}, any_value(cnt.n) as n, {', '.join(f"max(slope) filter (where m = '{m}') as {m}_trend, max(p) filter (where m = '{m}') as {m}_p" for m in P.METRICS)}
 from cnt left join fit using ({k}) group by {k})"""


def _label_sql(m, missing):
    return f"case when {m}_p is null then {missing} when {m}_p >= 0.05 then 'Not Significant' when {m}_trend > 0 then 'Positive' else 'Negative' end"


def _trend_cols(extra=""):
    return ", ".join(f"round({m}_trend, 6) as {m}_trend, round({m}_p, 6) as {m}_p" for m in P.METRICS) + extra


_CELL250 = f"select cast(floor((x + 2300000) / 250000) as bigint) as cx, cast(floor((y + 2100000) / 250000) as bigint) as cy, ignition_year, fsr_ha_per_day, max_growth_ha, duration"


def _cell_labels():
    return ", " + ", ".join(f"case when n >= 20 then {_label_sql(m, 'null')} end as {m}_class" for m in P.METRICS)


@query("q13_cell_trends", V.sql("fires", _trend_cte(_CELL250 + " from fires", ["cx", "cy"]) + f" select cx, cy, n, {_trend_cols(_cell_labels())} from wide"))
def q13(spark, sf):
    return rounded(P.cell_trends(V.fires(spark, sf), 250000.0, X0, Y0))


_LAND100 = f"""grid as (select cell_id, cx, cy, round(sum(land) / 1e6, 6) as land_km2 from (select g.*, {V.zone_area('x - 50000', 'y - 50000', '100000', '100000')} as land
 from (select 46 * iy + ix + 1 as cell_id, ix as cx, iy as cy, {X0}e0 + (ix + 0.5e0) * 100000 as x, {Y0}e0 + (iy + 0.5e0) * 100000 as y
 from range(0, 46) a(ix), range(0, 29) b(iy)) g join blocks on x - 50000 < x0 + 920000 and x + 50000 > x0 and y - 50000 < y0 + 580000 and y + 50000 > y0) where land > 0 group by all)"""


@query("q13_land_cell_trends", V.sql("fires blocks", _trend_cte(_CELL250.replace("250000", "100000") + f" from fires join blocks on {V.IN_ZONE}", ["cx", "cy"]) + f""", {_LAND100}
 select cell_id, cx, cy, land_km2, coalesce(n, 0) as n, {_trend_cols(_cell_labels())} from grid left join wide using (cx, cy)"""))
def q13c(spark, sf):
    t = P.land_cell_trends(V.fires(spark, sf), V.zones(spark, sf), "zone", BOX, 100000.0)
    return rounded(t.drop("x", "y"))


@query("q13_cell_landcover_trends", V.sql("fires", _trend_cte(_CELL250.replace("250000", "500000") + ", lc_name from fires where lc_name is not null", ["cx", "cy", "lc_name"]) + f" select cx, cy, lc_name, n, {_trend_cols(_cell_labels())} from wide"))
def q13b(spark, sf):
    f = V.fires(spark, sf).where("lc_name is not null")
    return rounded(P.cell_trends(f, 500000.0, X0, Y0, ["lc_name"]))


@query("q14_region_trends", V.sql("fires blocks", _trend_cte(f"select zone, fires.* from fires join blocks on {V.IN_ZONE} where duration > 5", ["zone"]) + f""" select b.zone, coalesce(n, 0) as n, {_trend_cols()},
 {", ".join(f"{_label_sql(m, chr(39) + 'Insufficient data' + chr(39))} as {m}_class" for m in P.METRICS)} from blocks b left join wide using (zone)"""))
def q14(spark, sf):
    return rounded(P.zone_trends(V.fires(spark, sf), V.zones(spark, sf), "zone"))


def _duration_sql(col, name):
    return V.sql("fires", f""", yr as (select ignition_year as year, {col} as g, avg(duration) as m from fires where duration is not null and {col} is not null group by 1, 2),
sl as (select a.g, (b.m - a.m) / (b.year - a.year) as s from yr a join yr b on a.g = b.g and a.year < b.year),
{O.signed_rank('sl', 'g')}
select yr.g as {name}, round_even(any_value(q.slope), 3) as slope, round_even(any_value(wx.p), 5) as p, round(min(m), 6) as min_duration, round(max(m), 6) as max_duration
from yr join (select g, median(s) as slope from sl group by g) q using (g) left join wx using (g) group by yr.g""")


def _yearly(spark, sf, group):
    f = V.fires(spark, sf).where(F.col("duration").isNotNull() & F.col(group).isNotNull())
    return P.yearly_duration(f.withColumnRenamed("ignition_year", "year"), group)


@query("q15_duration_trend", _duration_sql("l1_ecoregion", "l1_ecoregion"))
def q15(spark, sf):
    return rounded(P.duration_trend_table(_yearly(spark, sf, "l1_ecoregion"), "l1_ecoregion"))


@query("q15_duration_trend_by_landcover", _duration_sql("lc_name", "lc_name"))
def q15b(spark, sf):
    return rounded(P.duration_trend_table(_yearly(spark, sf, "lc_name"), "lc_name"))


@query("q15_duration_bands", V.sql("fires", """, c as (select l1_ecoregion, regr_count(duration, ignition_year) as n, regr_avgx(duration, ignition_year) as xb, regr_sxx(duration, ignition_year) as sxx,
 regr_slope(duration, ignition_year) as b, regr_intercept(duration, ignition_year) as a, regr_syy(duration, ignition_year) - regr_slope(duration, ignition_year) * regr_sxy(duration, ignition_year) as rss
 from fires where l1_ecoregion is not null and duration is not null group by l1_ecoregion),
r as (select distinct l1_ecoregion, ignition_year as year from fires where l1_ecoregion is not null),
o as (select l1_ecoregion, year, a + b * year as f, sqrt(rss / (n - 2)) * sqrt(1e0 / n + (year - xb) * (year - xb) / sxx) as se from r join c using (l1_ecoregion))
select l1_ecoregion, year, round(f, 5) as fitted, round(se, 6) as se_fit, round(f - 1.96e0 * se, 5) as lower, round(f + 1.96e0 * se, 5) as upper from o"""))
def q15c(spark, sf):
    f = V.fires(spark, sf).where("l1_ecoregion is not null").withColumnRenamed("ignition_year", "year")
    fit = M.ols(f, ["l1_ecoregion"], "year", "duration")
    rows = f.select("l1_ecoregion", "year").distinct()
    return rounded(M.augment(rows, fit, ["l1_ecoregion"], "year"), fitted=5, lower=5, upper=5)


@query("q15_event_modes", V.sql("daily", ", ".join([""] + [f"""m{i} as (select id, arg_min(v, (-c, s)) as {c} from (select id, {e} as v, count(*) as c, min(event_day) as s from daily group by 1, 2) group by id)"""
    for i, (c, e) in enumerate((("duration", "duration"), ("year", "cast(substr(date, 1, 4) as int)"), ("l1_ecoregion", "l1_ecoregion"), ("lc_name", "lc_name")))]) + " select * from m0 join m1 using (id) join m2 using (id) join m3 using (id)"))
def q15d(spark, sf):
    return P.event_modes(V.daily(spark, sf))


#: Lines in a task of the joins below, so that its memory does not grow with the input.
DAY_ROWS = 400_000


def _days(spark, sf):
    """Daily rows of the events over several years, with attributes that change from day to day."""
    f = V.fires(spark, sf, DAY_ROWS).where("l1_ecoregion is not null and lc_name is not null")
    return f.join(V.table(spark, sf, "lineitem"), F.col("fire_id") == F.col("l_orderkey")).selectExpr(
        "fire_id as id", "cast(date_add(ignition_date, 20 * cast(l_linenumber as int)) as string) as date", "cast(l_linenumber as int) as event_day",
        "duration + cast(l_linenumber as int) % 2 as duration", "l1_ecoregion", "case when l_linenumber % 3 = 2 then '5-LOW' else lc_name end as lc_name",
    )


def _days_sql(group, cond, body):
    modes = [f"""m{i} as (select id, arg_min(v, (-c, s)) as {c} from (select id, {e} as v, count(*) as c, min(event_day) as s from days group by 1, 2) group by id)"""
             for i, (c, e) in enumerate((("duration", "duration"), ("year", "cast(substr(date, 1, 4) as int)"), ("g", group)))]
    return V.sql("fires", f""", days as (select fire_id as id, cast(ignition_date + 20 * cast(l_linenumber as int) as varchar) as date, cast(l_linenumber as int) as event_day, duration + l_linenumber % 2 as duration,
 l1_ecoregion, case when l_linenumber % 3 = 2 then '5-LOW' else lc_name end as lc_name from fires join lineitem on l_orderkey = fire_id where l1_ecoregion is not null and lc_name is not null),
{", ".join(modes)}, yr as (select year, g, avg(duration) as m, stddev_samp(duration) as sd from m0 join m1 using (id) join m2 using (id) where duration is not null and {cond} group by 1, 2),
sl as (select a.g, (b.m - a.m) / (b.year - a.year) as s from yr a join yr b on a.g = b.g and a.year < b.year),
sm as (select g, median(s) as slope from sl group by g){body}""")


def _days_trend_sql(group, cond):
    return _days_sql(group, cond, f""", {O.signed_rank('sl', 'g')}
select yr.g as {group}, round_even(any_value(slope), 3) as slope, round_even(any_value(wx.p), 5) as p, round(min(m), 6) as min_duration, round(max(m), 6) as max_duration from yr join sm using (g) left join wx using (g) group by yr.g""")


UNBURNT = ("5-LOW", "4-NOT SPECIFIED")
_BURNT = "g not in ('5-LOW', '4-NOT SPECIFIED')"


@query("q15_event_duration_trend", _days_trend_sql("l1_ecoregion", "true"))
def q15g(spark, sf):
    return rounded(P.duration_trend_table(P.yearly_event_duration(_days(spark, sf), "l1_ecoregion"), "l1_ecoregion"))


@query("q15_event_duration_trend_by_landcover", _days_trend_sql("lc_name", _BURNT))
def q15h(spark, sf):
    return rounded(P.duration_trend_table(P.yearly_event_duration(_days(spark, sf), "lc_name", UNBURNT), "lc_name"))


@query("q15_event_duration_lines", _days_sql("lc_name", _BURNT, """,
ic as (select g, any_value(slope) as slope, median(m - slope * year) as a from yr join sm using (g) group by g)
select year, g as lc_name, round(m, 6) as duration_mean, round(sd, 6) as duration_sd, round(a + slope * year, 5) as fitted, round(m - (a + slope * year), 5) as resid from yr left join ic using (g)"""))
def q15i(spark, sf):
    return rounded(P.duration_lines(P.yearly_event_duration(_days(spark, sf), "lc_name", UNBURNT), "lc_name"), fitted=5, resid=5)


_SPREAD = """, y0 as (select l1_eco, ignition_year as year, min(l1_ecoregion) as na_l1name, avg(fsr_acres_per_day) as mean_fsr from fires where l1_eco is not null group by 1, 2),
y as (select na_l1name, year, mean_fsr, (year - avg(year) over ()) / stddev_samp(year) over () as cyear from y0)"""


@query("q16_spread_trend", V.sql("fires", _SPREAD + f""", o as (select na_l1name, regr_slope(mean_fsr, cyear) as b, regr_intercept(mean_fsr, cyear) as a, regr_r2(mean_fsr, cyear) as r2, count(*) as n,
 arg_max(cyear, year) as c1, arg_min(cyear, year) as c0 from y group by 1),
ps as (select i.na_l1name, i.year, median((j.mean_fsr - i.mean_fsr) / (j.cyear - i.cyear)) as s, median((j.cyear * i.mean_fsr - i.cyear * j.mean_fsr) / (j.cyear - i.cyear)) as t
 from y i join y j on i.na_l1name = j.na_l1name and i.year <> j.year group by 1, 2),
rm as (select na_l1name, median(s) as rb, median(t) as ra from ps group by 1)
select na_l1name, round(b * (c1 - c0) * 100, 5) as ols_change_x100, round(b * (c1 - c0) / (a + b * c0) * 100, 6) as ols_pct_change,
 round(rb * (c1 - c0) * 100, 5) as rm_change_x100, round(rb * (c1 - c0) / (ra + rb * c0) * 100, 6) as rm_pct_change,
 round(r2, 6) as r_squared, round({O.f_p('r2 / (1 - r2) * (n - 2)', '1', '(n - 2)')}, 6) as p, round(rb, 6) as rm_slope from o join rm using (na_l1name)"""))
def q16(spark, sf):
    return rounded(P.spread_change(P.yearly_spread(V.fires(spark, sf))), ols_change_x100=5, rm_change_x100=5)


# --- regions, models ---------------------------------------------------------------------------------

_TITLE = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


# Blocks, holes and notches are whole squares of a 230 x 145 km net; what cannot be reached from outside belongs to a region without its holes.
@query("q17_region_means", V.sql("fires blocks", f""", own as (select na_l1name, cast((x0 + 2300000) / 230000 as int) + i as cx, cast((y0 + 2100000) / 145000 as int) + j as cy
 from blocks, range(0, 4) a(i), range(0, 4) b(j) where not (holed and i = 1 and j = 1) and not (not holed and i = 3 and j = 3)),
free as (select na_l1name, cast(cx as int) as cx, cast(cy as int) as cy from (select distinct na_l1name from blocks), range(-1, 21) a(cx), range(-1, 21) b(cy) where (na_l1name, cx, cy) not in (select (na_l1name, cx, cy) from own)),
outside as (select na_l1name, cx, cy from free where cx = -1 and cy = -1
 union select free.na_l1name, free.cx, free.cy from outside o join free on free.na_l1name = o.na_l1name and abs(free.cx - o.cx) <= 1 and abs(free.cy - o.cy) <= 1),
area as (select na_l1name, (22 * 22 - count(*)) * 33350e0 as area_km2 from outside group by 1)
select {_TITLE.format('na_l1name')} as na_l1name, area_km2, round(avg_fsr, 6) as avg_fsr, round(avg_max_growth, 6) as avg_max_growth from area left join
 (select l1_ecoregion as na_l1name, avg(fsr_ha_per_day) as avg_fsr, avg(max_growth_ha) as avg_max_growth from fires group by 1) using (na_l1name)"""))
def q17(spark, sf):
    regions = P.region_outlines(V.zones(spark, sf), "na_l1name").drop("geom").withColumn("na_l1name", C.title_case("na_l1name"))
    means = PT.spread_by_region(V.fires(spark, sf), "l1_ecoregion").withColumn("l1_ecoregion", C.title_case("l1_ecoregion"))
    return rounded(join_keys(regions, means.withColumnRenamed("l1_ecoregion", "na_l1name"), ["na_l1name"], "left"))


_SQUARES = "ov as (select * from (select fire_id as id, zone, blocks.us_l3name, " + V.zone_area("x - 50000", "y - 50000", "100000", "100000") + """ as area from {src}
 join blocks on x - 50000 < x0 + 920000 and x + 50000 > x0 and y - 50000 < y0 + 580000 and y + 50000 > y0) where area > 0)"""


@query("q17_level3_means", V.sql("fires blocks", ", " + _SQUARES.format(src="fires") + """ select ov.us_l3name, round(avg(fsr_ha_per_day), 6) as avg_fsr, round(avg(max_growth_ha), 6) as avg_max_growth, count(*) as n
 from ov join fires on fire_id = id group by ov.us_l3name"""))
def q17b(spark, sf):
    f = P.square_around(V.fires(spark, sf), 50000.0)
    return rounded(P.region_means(f, "fire_id", V.zones(spark, sf), "zone", "us_l3name"))


@query("q27_burned_area", V.sql("fires blocks", ", " + _SQUARES.format(src="(select * from fires where ignition_year >= 1998)") + """ select fire_id, zone, cast(ignition_date as varchar) as discovery_date, ignition_year as discovery_year,
 day(ignition_date) as discovery_day, ignition_month as discovery_month, ignition_doy as discovery_doy,
 case when -100 + degrees(atan2(x * sin(arc), rho * cos(radians(45)) * cos(arc) - y * sin(radians(45)) * sin(arc))) < -97 then 'West' else 'East' end as mtbs_region,
 round(fsr_acres_per_day * 0.404686e0, 6) as mtbs_ba_ha, round(area * 0.0001e0, 6) as mtbs_ba_ecoreg_ha
 from ov join (select *, 2 * asin(rho / (2 * 6370997e0)) as arc from (select *, sqrt(x * x + y * y) as rho from fires)) on fire_id = id"""))
def q27(spark, sf):
    p = P.square_around(V.fires(spark, sf), 50000.0).select(
        "fire_id", F.col("ignition_year").alias("year"), F.col("ignition_month").alias("startmonth"), F.day("ignition_date").alias("startday"),
        F.col("fsr_acres_per_day").alias("acres"), "geom",
    )
    b = P.burned_area(p, V.zones(spark, sf), "zone", 1998)
    return rounded(b.withColumn("discovery_date", F.col("discovery_date").cast("string")))


_LM = """regr_count({y}, {x}) as n, regr_avgy({y}, {x}) as yb, regr_avgx({y}, {x}) as xb, regr_sxx({y}, {x}) as sxx, regr_sxy({y}, {x}) as sxy, regr_syy({y}, {x}) as syy"""


def _glance_sql(src, keys, x, y, factor=None, pooled=""):
    k = ", ".join(keys)
    lv = ", ".join([*keys, *([factor] if factor else [])])
    s = f"lv as (select {lv}, {_LM.format(x=x, y=y)} from {src} group by {lv}), l2 as (select *, syy - case when sxx > 0 then sxy * sxy / sxx else 0 end as r1, case when sxx > 0 then 2 else 1 end as rk from lv where n > 0)"
    part = f"partition by {k}" if k else ""
    s += f""", l3 as (select *, sum(n * yb) over ({part}) / sum(n) over ({part}) as gm from l2),
md as (select {k + ',' if k else ''} sum(n) as n, sum(r1) as rss, sum(syy + n * (yb - gm) * (yb - gm)) as tss, sum(rk) as rk from l3 {('group by ' + k) if k else ''}),
gl as (select *, 1 - rss / nullif(tss, 0) as r2, (tss - rss) / nullif(rk - 1, 0) / nullif(rss / nullif(n - rk, 0), 0) as fs from md)
select {k + ',' if k else ''} cast(n as bigint) as n, round(r2, 6) as r_squared, round(1 - (1 - r2) * (n - 1) / nullif(n - rk, 0), 6) as adj_r_squared, round(sqrt(rss / nullif(n - rk, 0)), 6) as sigma,
 round(fs, 5) as statistic, cast(rk - 1 as int) as df, cast(n - rk as int) as df_residual, round({O.f_p('fs', '(rk - 1)', '(n - rk)')}, 6) as p_value from gl"""
    return s


_T = "t as (select l1_ecoregion, ignition_year, lc_name, count(*) as n0, median(fsr_ha_per_day) as avg_fsr, ln(max(max_growth_ha)) as lmg, avg(ignition_month) as peak_season from fires where l1_ecoregion is not null and lc_name is not null group by 1, 2, 3)"
_GL = ["n", "r_squared", "adj_r_squared", "sigma", "statistic", "df", "df_residual", "p_value"]


def _season(spark, sf):
    s = PT.season_stats(V.fires(spark, sf), ["l1_ecoregion", "ignition_year", "lc_name"])
    return s.withColumn("log_max_growth", C.log_or_null("max_growth"))


def _pooled(df, keys, factor, x, y):
    g = M.interaction_glance(M.interaction_levels(df, keys, factor, x, y), keys)
    return rounded(g.select(*keys, *_GL), statistic=5)


@query("q19_spread_models", V.sql("fires", f", {_T}, " + _glance_sql("t", ["l1_ecoregion"], "ignition_year", "avg_fsr", "lc_name")))
def q19(spark, sf):
    return _pooled(_season(spark, sf), ["l1_ecoregion"], "lc_name", "ignition_year", "avg_fsr")


@query("q19_growth_models", V.sql("fires", f", {_T}, " + _glance_sql("t", ["l1_ecoregion"], "ignition_year", "lmg", "lc_name")))
def q19b(spark, sf):
    return _pooled(_season(spark, sf), ["l1_ecoregion"], "lc_name", "ignition_year", "log_max_growth")


@query("q19_landcover_models", V.sql("fires", ", t as (select ignition_year, lc_name, ln(max(max_growth_ha)) as lmg from fires where l1_ecoregion is not null and lc_name is not null group by 1, 2), " + _glance_sql("t", ["lc_name"], "ignition_year", "lmg")))
def q19c(spark, sf):
    s = PT.season_stats(V.fires(spark, sf), ["ignition_year", "lc_name"]).withColumn("log_max_growth", C.log_or_null("max_growth"))
    return rounded(M.glance(M.ols(s, ["lc_name"], "ignition_year", "log_max_growth")).select("lc_name", *_GL), statistic=5)


_DECADE = "case when ignition_year < 1998 then '2000-2009' else '2010-2019' end"


@query("q20_kruskal", V.sql("fires", f""", d as (select l1_ecoregion as g, {_DECADE} as c, ignition_doy as v from fires where l1_ecoregion is not null),
r as (select *, count(*) over (partition by g, v) as t, rank() over (partition by g order by v) + (count(*) over (partition by g, v) - 1) / 2e0 as rk, count(*) over (partition by g) as n from d),
h as (select g, any_value(n) as n, count(*) as classes, 12e0 / (any_value(n) * (any_value(n) + 1e0)) * sum(s * s / nc) - 3 * (any_value(n) + 1) as h0 from
 (select g, c, any_value(n) as n, sum(rk) as s, count(*) as nc from r group by g, c) group by g),
ti as (select g, sum(cast(t as double) * t - 1) as ties from r group by g),
o as (select g, n, classes, h0 / (1 - ties / (power(n, 3) - n)) as h from h join ti using (g))
select g as l1_ecoregion, n, classes, round(h, 6) as h, cast(classes - 1 as int) as df, round({O.normal_p('sqrt(h)')}, 6) as p from o"""))
def q20(spark, sf):
    f = V.fires(spark, sf).where("l1_ecoregion is not null").withColumn("temp_bin", C.decade("ignition_year", 1998))
    return rounded(K.kruskal(f, ["l1_ecoregion"], "temp_bin", "ignition_doy"))


def _density_sql(by, expr, cond="true"):
    return V.sql("fires", f""", d as (select l1_ecoregion as g, {expr} as {by}, ignition_doy as v from fires where l1_ecoregion is not null and {cond}),
s as (select g, {by}, count(*) as n, 0.9e0 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34e0) * power(count(*), -0.2e0) as h, min(v) as lo, max(v) as hi from d group by 1, 2),
x as (select *, lo - 3 * h + i * (hi - lo + 6 * h) / 63 as x from s, range(0, 64) r(i)),
c as (select g, {by}, v, count(*) as w from d group by 1, 2, 3)
select x.g as l1_ecoregion, x.{by}, cast(i as int) as i, round(x, 6) as x, round(sum(w * exp(-power((x - v) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 9) as density
 from x join c on x.g = c.g and x.{by} = c.{by} group by 1, 2, 3, x.x""")


@query("q20_season_density_by_year", _density_sql("ignition_year", "ignition_year", "ignition_year <> 2001"))
def q20c(spark, sf):
    return rounded(P.season_density(V.fires(spark, sf), "ignition_year", 2001), density=9)


@query("q20_season_density", _density_sql("temp_bin", _DECADE))
def q20b(spark, sf):
    return rounded(P.season_density(V.fires(spark, sf).withColumn("temp_bin", C.decade("ignition_year", 1998)), "temp_bin"), density=9)


@query("q21_size_speed_models", V.sql("fires", ", t as (select * from fires where lc_name is not null), " + _glance_sql("t", [], "total_area_km2", "fsr_km2_per_day", "lc_name")))
def q21(spark, sf):
    return _pooled(V.fires(spark, sf), [], "lc_name", "total_area_km2", "fsr_km2_per_day")


@query("q21_landcover_models", V.sql("fires", ", t as (select * from fires where l1_ecoregion is not null and lc_name <> '5-LOW'), " + _glance_sql("t", ["lc_name"], "max_growth_km2", "total_area_km2")))
def q21b(spark, sf):
    f = V.fires(spark, sf).where(F.col("l1_ecoregion").isNotNull() & C.all_different("lc_name", ("5-LOW",)))
    return rounded(M.glance(M.ols(f, ["lc_name"], "max_growth_km2", "total_area_km2")).select("lc_name", *_GL), statistic=5)


@query("q21_variation_explained", V.sql("fires", """ select concat('Model w/o interaction explains ', cast(cast(round_even(regr_r2(total_area_km2, max_growth_km2), 2) * 100 as int) as varchar), '% of Variation') as label,
 format('{:,}', regr_count(total_area_km2, max_growth_km2)) as n from fires"""))
def q21c(spark, sf):
    g = M.glance(M.ols(V.fires(spark, sf), [], "max_growth_km2", "total_area_km2"))
    pct = F.round(C.half_even("r_squared", 2) * 100).cast("int").cast("string")
    return g.select(F.concat(F.lit("Model w/o interaction explains "), pct, F.lit("% of Variation")).alias("label"), C.thousands("n").alias("n"))


_DIGITS = {"df": 0, "estimate": 6, "std_error": 6, "statistic": 3}


def _mixed_sql(group, x, y, slope=False):
    return V.sql("fires", ", " + O.reml_fit("fires", group, x, y, slope) + ", " + O.reml_tests(x, slope, _DIGITS))


def _mixed(spark, sf, group, x, y, slope=False):
    return rounded(X.mixed_model(V.fires(spark, sf), group, x, y, random_slope=slope)["fixed"], **_DIGITS)


@query("q21_mixed_intercept", _mixed_sql("us_l3name", "total_area_km2", "fsr_km2_per_day"))
def q21d(spark, sf):
    return _mixed(spark, sf, "us_l3name", "total_area_km2", "fsr_km2_per_day")


@query("q21_mixed_landcover", _mixed_sql("lc_name", "total_area_km2", "fsr_km2_per_day"))
def q21e(spark, sf):
    return _mixed(spark, sf, "lc_name", "total_area_km2", "fsr_km2_per_day")


@query("q15_mixed_slope", _mixed_sql("us_l3name", "ignition_year", "duration", True))
def q15e(spark, sf):
    return _mixed(spark, sf, "us_l3name", "ignition_year", "duration", True)


@query("q15_mixed_predictions", V.sql("fires", ", " + O.reml_fit("fires", "l1_ecoregion", "ignition_year", "duration", True) + ", " + O.REML_LINES + """
select distinct l1_ecoregion, ignition_year, round(c0 + c1 * (ignition_year - mx) / sd, 4) as predicted from fires left join lines on g = l1_ecoregion where l1_ecoregion is not null"""))
def q15f(spark, sf):
    f = V.fires(spark, sf)
    m = X.mixed_model(f, "l1_ecoregion", "ignition_year", "duration", random_slope=True)
    rows = f.where("l1_ecoregion is not null").select("l1_ecoregion", "ignition_year").distinct()
    return rounded(X.predict_mixed(rows, m, "l1_ecoregion", "ignition_year"), 4)


def _hist_sql(g, cond):
    return V.sql("fires", f""", d as (select {g} as g, max_growth_ha as v from fires where total_area_ha > 1000 and {cond} and max_growth_ha is not null),
s as (select g, min(v) as lo, max(v) as hi from d group by g)
select g as {g}, cast(coalesce(least(floor((v - lo) * 30 / nullif(hi - lo, 0)) + 1, 30), 1) as int) as bin, count(*) as n,
 round(lo + (bin - 1) * (hi - lo) / 30, 6) as bin_lo, round(lo + bin * (hi - lo) / 30, 6) as bin_hi from d join s using (g) group by g, bin, lo, hi""")


@query("q22_growth_histogram", _hist_sql("l1_ecoregion", "l1_ecoregion is not null"))
def q22(spark, sf):
    f = V.fires(spark, sf).where((F.col("total_area_ha") > 1000) & F.col("l1_ecoregion").isNotNull())
    return rounded(G.histogram(f, ["l1_ecoregion"], "max_growth_ha"))


@query("q22_landcover_histogram", _hist_sql("lc_name", "lc_name <> '5-LOW'"))
def q22b(spark, sf):
    f = V.fires(spark, sf).where((F.col("total_area_ha") > 1000) & C.all_different("lc_name", ("5-LOW",)))
    return rounded(G.histogram(f, ["lc_name"], "max_growth_ha"))


def _breaks_sql(col, k):
    """Least squares over all partitions of the distinct values: class by class, every value against every earlier one."""
    cost = "a.f + (b.c2 - a.c2) - (b.c1 - a.c1) * (b.c1 - a.c1) / (b.c0 - a.c0)"
    s = f""", v as (select cast({col} as double) as v, count(*) * 1e0 as w from fires where {col} is not null group by 1), mean as (select sum(w * v) / sum(w) as m from v),
c as materialized (select v, row_number() over o as j, sum(w) over o as c0, sum(w * (v - m)) over o as c1, sum(w * (v - m) * (v - m)) over o as c2 from v, mean window o as (order by v)),
f1 as (select *, c2 - c1 * c1 / c0 as f from c)"""
    for i in range(2, k + 1):
        last = " where b.j = (select max(j) from c)" if i == k else ""
        s += f""", p{i} as materialized (select b.j, min({cost}) as f, arg_min(a.j, {cost}) as p from f{i - 1} a join c b on a.j < b.j{last} group by b.j),
f{i} as (select c.*, f, p from p{i} join c using (j))"""
    s += f", e{k} as (select max(j) as j from c)"
    for i in range(k, 1, -1):
        s += f", e{i - 1} as (select p as j from p{i} join e{i} using (j))"
    s += ", ends as (select 0 as class, 0 as j union all " + " union all ".join(f"select {i}, j from e{i}" for i in range(1, k + 1)) + ")"
    return s + """ select cast(b.class as int) as class, lo.v as lo, hi.v as hi, cast(hi.c0 - coalesce(prior.c0, 0) as bigint) as n
from ends a join ends b on b.class = a.class + 1 join c lo on lo.j = a.j + 1 join c hi on hi.j = b.j left join c prior on prior.j = a.j"""


@query("q22_natural_breaks", V.sql("fires", _breaks_sql("max_growth_ha", 5)))
def q22c(spark, sf):
    return B.natural_breaks(V.fires(spark, sf), "max_growth_ha", 5)


# --- roads and rasters ------------------------------------------------------------------------------------

_SPLIT = """, tt as (select *, list_sort(list_distinct(list_concat([0e0, 1e0],
 case when x1 <> x2 then list_filter(list_transform(range(cast(ceil(least(x1, x2) / 50000) as bigint), cast(floor(greatest(x1, x2) / 50000) as bigint) + 1), lambda k: (k * 50000e0 - x1) / (x2 - x1)), lambda v: v >= 0 and v <= 1) else []::double[] end,
 case when y1 <> y2 then list_filter(list_transform(range(cast(ceil(least(y1, y2) / 50000) as bigint), cast(floor(greatest(y1, y2) / 50000) as bigint) + 1), lambda k: (k * 50000e0 - y1) / (y2 - y1)), lambda v: v >= 0 and v <= 1) else []::double[] end))) as t from roads),
pc as (select *, unnest(list_zip(t[1:len(t)-1], t[2:])) as p from tt),
lc as (select cast(floor((x1 + (p[1] + p[2]) / 2 * (x2 - x1)) / 50000) as bigint) as cx, cast(floor((y1 + (p[1] + p[2]) / 2 * (y2 - y1)) / 50000) as bigint) as cy,
 (p[2] - p[1]) * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)) / 1000 as km from pc),
rd as (select cx, cy, sum(km) as km from lc where km > 0 group by 1, 2)"""


def _template(spark, sf):
    return R.blank(V.cells(spark, sf).withColumns({"cx": F.col("cx") - 25, "cy": F.col("cy") - 20}))


@query("q23_road_density", V.sql("roads cells", _SPLIT + " select c.cx, c.cy, round(coalesce(km, 0), 6) as value from (select distinct cx - 25 as cx, cy - 20 as cy from cells) c left join rd using (cx, cy)"))
def q23(spark, sf):
    return rounded(P.road_density(V.roads(spark, sf), 50000.0, 0.0, 0.0, _template(spark, sf)))


@query("q23_homes_per_road_km", V.sql("roads cells", _SPLIT + " select c.cx, c.cy, round(h / nullif(coalesce(km, 0), 0), 6) as homes_per_km from (select cx - 25 as cx, cy - 20 as cy, home_density as h from cells) c left join rd using (cx, cy)"))
def q23b(spark, sf):
    roads = P.road_density(V.roads(spark, sf), 50000.0, 0.0, 0.0, _template(spark, sf))
    homes = V.cells(spark, sf).select((F.col("cx") - 25).alias("cx"), (F.col("cy") - 20).alias("cy"), F.col("home_density").alias("value"))
    return rounded(R.divide(homes, roads, "homes_per_km"))


@query("q24_landcover_counts", V.sql("cells", " select value, year, count(*) as count, any_value(n_name) as name from (select year, landcover as value from cells) join nation on n_nationkey = value where n_nationkey < 15 group by value, year"))
def q24(spark, sf):
    classes = V.table(spark, sf, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("name"))
    return PT.landcover_counts(V.cells(spark, sf), classes, "landcover")


def _dp_sql():
    """Bai-Perron by nested CTEs: series of 21 to 31 days, segments of at least floor(0.15 n) days."""
    s = """, s as (select *, row_number() over (partition by id order by event_day) as j, count(*) over (partition by id) as n,
 sum(pixels) over (partition by id order by event_day) as c1, sum(pixels * pixels) over (partition by id order by event_day) as c2 from daily where duration > 20),
q as (select *, cast(floor(0.15e0 * n) as int) as h from s where n > 20),
cost as (select a.id, a.j as i, b.j as j, a.n, a.h, round(greatest(b.c2 - a.c2 + a.pixels * a.pixels - power(b.c1 - a.c1 + a.pixels, 2) / (b.j - a.j + 1), 0), 6) as c
 from q a join q b on a.id = b.id and b.j - a.j + 1 >= a.h),
f0 as (select id, j, n, h, c, []::bigint[] as path from cost where i = 1)"""
    for m in range(1, 7):
        s += f""", f{m} as (select p.id, q.j, any_value(p.n) as n, any_value(p.h) as h, min(round(p.c + q.c, 6)) as c, arg_min(list_append(p.path, p.j), (round(p.c + q.c, 6), p.j)) as path
 from f{m - 1} p join cost q on p.id = q.id and q.i = p.j + 1 group by p.id, q.j)"""
    s += ", alls as (" + " union all ".join(f"select id, {m} as m, n, c, path from f{m} where j = n and {m} <= ceil(n / h) - 2" for m in range(0, 7)) + ")"
    s += """, pick as (select id, arg_min(path, (case when c > 0 then n * (ln(c) + 1 - ln(n) + ln(2 * pi())) + ln(n) * 2 * (m + 1) else -1e300 end, m)) as path from alls group by id),
br as (select id, unnest(path) as j from pick),
pts as (select id, 0 as event_day, 0 as cum from br group by id union all select q.id, event_day, cum_pixels from br join q on q.id = br.id and q.j = br.j
 union all select id, max(event_day), max(cum_pixels) from q where id in (select id from br) group by id),
rt as (select *, cum - lag(cum) over w as gain, event_day - lag(event_day) over w as span, lag(event_day) over w as prior from pts window w as (partition by id order by event_day)),
bst as (select id, arg_max({'g': gain, 's': span, 'p': prior, 'e': event_day}, (gain / span, -event_day)) as b from rt where span is not null group by id)
select id, round(b.g / b.s, 6) as pgp_fsr, b.s as pgp_duration, b.g as pgp_ba_pix, greatest(b.p, 1) as pgp_start, b.e as pgp_end from bst"""
    return s


@query("q25_peak_growth", V.sql("daily", _dp_sql()))
def q25(spark, sf):
    return rounded(E.peak_growth(V.daily(spark, sf)))


_PIX = """, ev as (select year, cx, cy, concat(landcover, '_', year) as event from cells where landcover >= 1),
ids as (select event, row_number() over (order by event) as fire_id from (select distinct event from ev)),
pix as (select year, fire_id, cx, cy from ev join ids using (event))"""
RX, RY, RSIZE = -1750000.0, -2050000.0, 70000.0


def _stack(spark, sf, name):
    return V.cells(spark, sf).select("year", "cx", "cy", F.col(name).cast("double").alias("value"))


@query("q26_event_area", V.sql("cells", _PIX + " select year, fire_id, count(*) as pixel_count, count(*) * 4900e0 as area_km2 from pix group by 1, 2"))
def q26(spark, sf):
    return P.event_points(_stack(spark, sf, "landcover"), RSIZE)[1]


@query("q26_region_duration", V.sql("cells blocks", _PIX + f""", v as (select year, cx, cy, road_density as value from cells where road_density >= 0.01),
j as (select p.*, value, -1750000e0 + (p.cx + 0.5e0) * 70000 as x, -2050000e0 + (p.cy + 0.5e0) * 70000 as y from pix p left join v using (year, cx, cy)),
o as (select * from j qualify row_number() over (partition by fire_id order by cx, cy) = 1),
r as (select o.*, us_l3name from o left join blocks on {V.IN_ZONE})
select us_l3name, year, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as min, median(value) as median, max(value) as max
 from r where us_l3name is not null group by 1, 2"""))
def q26b(spark, sf):
    pix, _ = P.event_points(_stack(spark, sf, "landcover"), RSIZE)
    one = P.event_values(pix, _stack(spark, sf, "road_density"))
    pts = P.region_points(one, RSIZE, RX, RY, V.zones(spark, sf), "zone", ["us_l3name"])
    return rounded(G.yearly_stats(pts, "us_l3name", "value"))
