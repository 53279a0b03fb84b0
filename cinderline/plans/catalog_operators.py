"""Registered queries: one per remaining source, projection, join, window, statistical, spatial or raster operator."""

import uuid

from pyspark.sql import functions as F

from cinderline.functions import columns as C
from cinderline.operators import breaks as B
from cinderline.operators import cells as R
from cinderline.operators import grouping as G
from cinderline.operators import models as M
from cinderline.operators import ranks as Q
from cinderline.operators import spatial as S
from cinderline.operators import trend as T
from cinderline.operators.keys import join_keys, natural_left_join, semi_join
from cinderline.operators.overlay import cover_area, overlay
from cinderline.plans import oracle as O
from cinderline.plans import studies as P
from cinderline.plans.registry import ORACLES, QUERIES, query, rounded
from cinderline.sources import schemas
from cinderline.sources import tables as I
from cinderline.sources import views as V

c = F.col


def _op(name, views, body, fn):
    query(name, V.sql(views, body) if views else body)(fn)


def _scratch(spark, name):
    """A fresh path in the shared folder, for queries that write and read back."""
    I.use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------------

_REGION = schemas._schema([("r_regionkey", schemas._I), ("r_name", schemas._S)])
_NATION = schemas._schema([("n_nationkey", schemas._I), ("n_name", schemas._S), ("n_regionkey", schemas._I)])
_CELL = schemas._schema([("cx", schemas._L), ("cy", schemas._L), ("home_density", schemas._D), ("year", schemas._I)])

_op("scan_feature_table", "", "select n_nationkey, n_name, n_regionkey from nation",
    lambda spark, sf: I.read_features(spark, f"{sf}/nation.parquet", _NATION))
_op("scan_named_layer", "", "select r_regionkey, r_name from region",
    lambda spark, sf: I.read_features(spark, sf, _REGION, layer="region.parquet"))
_op("scan_many_files", "", """select 'nation' as source, count(*) as n, sum(n_regionkey) * 1e0 as total from nation
 union all select 'supplier', count(*), null from supplier""",
    lambda spark, sf: I.read_many(spark, sf, schemas._schema([("n_regionkey", schemas._I)]), "{nation,supplier}.parquet", tag="source", tag_regex=r"([a-z]+)\.parquet$")
    .groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_regionkey").cast("double").alias("total")))


def csv_round_trip(spark, sf):
    path = _scratch(spark, "csv")
    I.write_csv(V.daily(spark, sf).select("id", "date", "event_day", "duration", "pixels", "cum_pixels", "cum_area_km2", "l1_ecoregion", "lc_name"), path)
    return I.read_csv(spark, path, schemas.DAILY_GROWTH)


_op("csv_write_and_scan", "daily", "select id, date, event_day, duration, pixels, cum_pixels, cum_area_km2, l1_ecoregion, lc_name from daily", csv_round_trip)


def raster_round_trip(spark, sf):
    path = _scratch(spark, "raster")
    I.write_raster(V.cells(spark, sf).select("cx", "cy", "home_density", "year"), path)
    cells = I.read_raster(spark, path, _CELL)
    return R.to_points(cells, 1000.0, 0.0, 0.0, "home_density").select("x", "y", "home_density")


_op("raster_write_scan_to_points", "cells", "select (cx + 0.5e0) * 1000 as x, (cy + 0.5e0) * 1000 as y, home_density from cells", raster_round_trip)


def build_once(spark, sf):
    path = _scratch(spark, "built")
    first = I.read_or_build(spark, path, lambda: V.fires(spark, sf).groupBy("lc_name").agg(F.count(F.lit(1)).alias("n")))
    again = I.read_or_build(spark, path, lambda: first.where("false"))
    return again


_op("build_once_then_read", "fires", "select lc_name, count(*) as n from fires group by lc_name", build_once)


def replace_features(spark, sf):
    path = _scratch(spark, "features")
    for keep in ("zone < 3", "zone >= 3"):
        I.write_features(V.zones(spark, sf).where(keep), path)
    z = I.read_features(spark, path, schemas._schema([("zone", schemas._I), ("us_l3name", schemas._S)], schemas.POLYGON))
    return rounded(z.select("zone", "us_l3name", S.area("geom").alias("area")))


_op("feature_write_replaces", "blocks", "select zone, us_l3name, 920000e0 * 580000e0 * 15 / 16 as area from blocks where zone >= 3", replace_features)

# --- projections and filters --------------------------------------------------------------------

_op("select_and_rename", "fires", 'select lc_name as landcover, duration * 1e0 as days, fire_id from fires',
    lambda spark, sf: V.fires(spark, sf).select("fire_id", "lc_name", c("duration").cast("double").alias("duration")).withColumnsRenamed({"lc_name": "landcover", "duration": "days"}))
_op("lower_case_names", "", "select n_nationkey as nation_key, n_name as nation_name from nation",
    lambda spark, sf: C.rename_lower(V.table(spark, sf, "nation").select(c("n_nationkey").alias("NATION_KEY"), c("n_name").alias("Nation_Name"))))
_op("filter_conjunction", "fires", "select fire_id, lc_name, duration from fires where lc_name <> '1-URGENT' and duration > 3",
    lambda spark, sf: V.fires(spark, sf).where((c("lc_name") != "1-URGENT") & (c("duration") > 3)).select("fire_id", "lc_name", "duration"))
_op("filter_not_in", "fires", "select fire_id, lc_name from fires where lc_name not in ('1-URGENT', '2-HIGH') or lc_name is null",
    lambda spark, sf: V.fires(spark, sf).where(C.not_in("lc_name", ("1-URGENT", "2-HIGH"))).select("fire_id", "lc_name"))
_op("filter_membership", "", "select c_custkey, c_nationkey from customer where c_nationkey in (select s_nationkey from supplier)",
    lambda spark, sf: semi_join(V.table(spark, sf, "customer"), V.table(spark, sf, "supplier"), "c_nationkey", "s_nationkey").select("c_custkey", "c_nationkey"))
_op("filter_not_null", "fires", "select count(*) as n from fires where l1_ecoregion is not null",
    lambda spark, sf: V.fires(spark, sf).where(c("l1_ecoregion").isNotNull()).agg(F.count(F.lit(1)).alias("n")))
_op("drop_incomplete_rows", "fires", "select fire_id, l1_ecoregion, lc_name, max_growth_ha from fires where l1_ecoregion is not null and lc_name is not null and max_growth_ha is not null",
    lambda spark, sf: V.fires(spark, sf).select("fire_id", "l1_ecoregion", "lc_name", "max_growth_ha").dropna("any"))
_op("filter_year_range", "fires", "select ignition_year, count(*) as n from fires where ignition_year < 2001 and ignition_year > 1996 group by 1",
    lambda spark, sf: V.fires(spark, sf).where((c("ignition_year") < 2001) & (c("ignition_year") > 1996)).groupBy("ignition_year").agg(F.count(F.lit(1)).alias("n")))
_op("drop_geometry", "blocks", "select zone, us_l3name, na_l1name from blocks", lambda spark, sf: V.zones(spark, sf).drop("geom"))
_op("recode_values", "fires", "select fire_id, case lc_name when '1-URGENT' then 'Urgent' when '2-HIGH' then 'Urgent' when '5-LOW' then 'Low' else lc_name end as lc_name from fires",
    lambda spark, sf: V.fires(spark, sf).select("fire_id", C.recode("lc_name", {"1-URGENT": "Urgent", "2-HIGH": "Urgent", "5-LOW": "Low"}).alias("lc_name")))
_op("case_pass_through", "", "select n_nationkey, case when n_name = 'PERU' then 'PERU (ANDES)' else n_name end as n_name from nation",
    lambda spark, sf: V.table(spark, sf, "nation").select("n_nationkey", C.when_equal("n_name", "PERU", "PERU (ANDES)").alias("n_name")))
_L1 = ["EASTERN TEMPERATE FORESTS", "NORTH AMERICAN DESERTS", "GREAT PLAINS", "TEMPERATE SIERRAS", "NORTHERN FORESTS"]
_op("part_of_country", "", "select c_custkey, case c_nationkey % 5 when 0 then 'East' when 1 then 'West' when 2 then 'Central' when 3 then 'West' else 'East' end as region from customer",
    lambda spark, sf: V.table(spark, sf, "customer").select("c_custkey", C.part_of_country(F.element_at(F.array(*map(F.lit, _L1)), c("c_nationkey") % 5 + 1)).alias("region")))
_op("east_west_split", "fires", "select fire_id, case when x / 20000 - 100 is null then null when x / 20000 - 100 < -97 then 'West' else 'East' end as side from fires",
    lambda spark, sf: V.fires(spark, sf).select("fire_id", C.east_or_west(c("x") / 20000 - 100).alias("side")))
_op("step_classes", "fires", """select fire_id, case when fsr_ha_per_day is null then null when fsr_ha_per_day < 15 then '< 15' when fsr_ha_per_day < 40 then '15 - 40' when fsr_ha_per_day < 100 then '40 - 100' when fsr_ha_per_day < 400 then '100 - 400' else '> 400' end as spread,
 case when duration < 1 then null when duration is null then null when duration <= 25 then '1 - 25' else '25 - 100' end as frequency,
 case when max_growth_ha is null then null when max_growth_ha < 100 then '< 100' when max_growth_ha < 200 then '100 - 200' when max_growth_ha < 500 then '200 - 500' when max_growth_ha < 2000 then '500 - 2000' else '> 2000' end as mean_growth,
 case when max_growth_ha is null then null when max_growth_ha < 200 then '< 200' when max_growth_ha < 500 then '200 - 500' when max_growth_ha < 2000 then '500 - 2,000' when max_growth_ha < 10000 then '2,000 - 10,000' else '> 10,000' end as peak_growth from fires""",
    lambda spark, sf: V.fires(spark, sf).select("fire_id", C.classify_spread("fsr_ha_per_day").alias("spread"), C.classify_frequency("duration").alias("frequency"),
                                                C.classify_mean_growth("max_growth_ha").alias("mean_growth"), C.classify_peak_growth("max_growth_ha").alias("peak_growth")))
_op("right_closed_bins", "cells", "select cx, cy, case when v > 0 and v <= 5 then '0-5' when v > 5 and v <= 10 then '5-10' when v > 10 and v <= 20 then '10-20' when v > 20 and v <= 50 then '20-50' when v > 50 and v <= 100 then '50-100' when v > 100 then '100+' end as classes from (select cx, cy, road_density as v from cells)",
    lambda spark, sf: V.cells(spark, sf).select("cx", "cy", C.cut("road_density", C.HOMES_PER_ROAD_BREAKS, C.HOMES_PER_ROAD_LABELS).alias("classes")))
_op("decade_bins", "fires", "select case when ignition_year < 1998 then 'a' else 'b' end as decade, count(*) as n from fires group by 1",
    lambda spark, sf: V.fires(spark, sf).groupBy(C.decade("ignition_year", 1998, ("a", "b")).alias("decade")).agg(F.count(F.lit(1)).alias("n")))
_op("ordered_category", "fires", "select fire_id, coalesce(list_position(['5-LOW', '1-URGENT', '2-HIGH'], lc_name), -1) as lc_order from fires",
    lambda spark, sf: V.fires(spark, sf).select("fire_id", F.coalesce(C.level_order("lc_name", ["5-LOW", "1-URGENT", "2-HIGH"]), F.lit(-1)).alias("lc_order")))
_op("cast_or_null", "", "select user_id, cast(sum(try_cast(case when event_id % 3 = 0 then 'n/a' else cast(event_id as varchar) end as bigint)) as bigint) as total from events group by user_id",
    lambda spark, sf: V.table(spark, sf, "events").withColumn("t", F.when(c("event_id") % 3 == 0, "n/a").otherwise(c("event_id").cast("string"))).groupBy("user_id").agg(F.sum(C.number_or_null("t", "long")).alias("total")))
_op("paste_strings", "fires", "select fire_id, concat_ws('-', cast(ignition_year as varchar), cast(ignition_month as varchar), lc_name) as label, concat(cast(fire_id as varchar), '_', cast(ignition_year as varchar)) as event from fires where lc_name is not null",
    lambda spark, sf: V.fires(spark, sf).where("lc_name is not null").select("fire_id", F.concat_ws("-", "ignition_year", "ignition_month", "lc_name").alias("label"), F.concat(c("fire_id").cast("string"), F.lit("_"), c("ignition_year").cast("string")).alias("event")))
_op("substring_offsets", "", "select page_id, substr(url, 1, 4) as head, substr(url, -8, 4) as tail from pages",
    lambda spark, sf: V.table(spark, sf, "pages").select("page_id", C.substring_at("url", 1, 4).alias("head"), C.substring_at("url", -8, -5).alias("tail")))
_op("regex_extract", "", "select c_custkey, nullif(regexp_extract(c_name, '[0-9]{5}'), '') as code from customer",
    lambda spark, sf: V.table(spark, sf, "customer").select("c_custkey", C.extract_or_null("c_name", r"\d{5}").alias("code")))
_op("title_case_words", "", """select p_partkey, array_to_string(list_transform(regexp_split_to_array(lower(replace(p_type, ' ', '/')), '/'), lambda w: upper(w[1]) || w[2:]), '/') as name from part""",
    lambda spark, sf: V.table(spark, sf, "part").select("p_partkey", C.title_case(F.replace(c("p_type"), F.lit(" "), F.lit("/"))).alias("name")))
_op("separate_columns", "", "select c_custkey, split_part(c_name, '#', 1) as prefix, split_part(c_name, '#', 2) as number from customer",
    lambda spark, sf: V.table(spark, sf, "customer").select("c_custkey", C.field("c_name", "#", 0).alias("prefix"), C.field("c_name", "#", 1).alias("number")))
_op("date_parts", "fires", """, d as (select fire_id, try_cast(concat(ignition_year, '-', ignition_month, '-', 1 + fire_id % 31) as date) as d from fires)
select fire_id, cast(d as varchar) as discovery_date, cast(year(d) as double) as discovery_year, cast(day(d) as double) as discovery_day, cast(month(d) as double) as discovery_month, cast(dayofyear(d) as double) as discovery_doy from d""",
    lambda spark, sf: V.fires(spark, sf).select("fire_id", C.date_of("ignition_year", "ignition_month", c("fire_id") % 31 + 1).alias("d")).select(
        "fire_id", *[(e.cast("string") if a.endswith("_date") else e.cast("double")).alias(a) for a, e in C.date_parts("d", "discovery").items()]))
_op("half_even_rounding", "", "select l_quantity, round_even(l_quantity / 2, 0) as half, round_even(l_quantity / 8, 2) as eighth from (select distinct l_quantity from lineitem)",
    lambda spark, sf: V.table(spark, sf, "lineitem").select("l_quantity").distinct().select("l_quantity", C.half_even(c("l_quantity") / 2).alias("half"), C.half_even(c("l_quantity") / 8, 2).alias("eighth")))
_op("log_and_geometric_mid", "cells", "select year, round(sum(case when road_density > 0 then ln(road_density) end), 6) as logs, round(exp(ln(max(home_density)) / 2), 6) as mid from cells group by year",
    lambda spark, sf: rounded(V.cells(spark, sf).groupBy("year").agg(F.sum(C.log_or_null("road_density")).alias("logs"), C.geometric_mid("home_density").alias("mid"))))
_op("unit_conversion", "fires", "select fire_id, round(fsr_acres_per_day * 0.404686e0, 6) as ha, round(total_area_ha * 10000 * 0.0001e0, 6) as ha2, round(x / 1000, 6) as km, round(y / 1000000, 9) as km2 from fires",
    lambda spark, sf: rounded(V.fires(spark, sf).select("fire_id", (c("fsr_acres_per_day") * C.HA_PER_ACRE).alias("ha"), (c("total_area_ha") * 10000 * C.HA_PER_M2).alias("ha2"), (c("x") / C.M_PER_KM).alias("km"), (c("y") / C.M2_PER_KM2).alias("km2")), km2=9))
_op("safe_ratio", "cells", "select cx, cy, round(home_density / nullif(road_density, 0), 6) as ratio from cells",
    lambda spark, sf: rounded(V.cells(spark, sf).select("cx", "cy", C.ratio("home_density", "road_density").alias("ratio"))))
_op("zero_and_missing", "cells", "select cx, cy, nullif(road_density, 0) as present, coalesce(case when landcover < 5 then road_density end, 0) as filled from cells",
    lambda spark, sf: V.cells(spark, sf).select("cx", "cy", C.zero_to_null("road_density").alias("present"), C.null_to_zero(F.when(c("landcover") < 5, c("road_density"))).alias("filled")))
_op("unpivot_wide_to_long", "cells", "select cx, cy, var, value from (select cx, cy, home_density, road_density from cells) unpivot (value for var in (home_density, road_density))",
    lambda spark, sf: C.unpivot(V.cells(spark, sf).select("cx", "cy", "home_density", "road_density"), ["cx", "cy"], ["home_density", "road_density"]))
_op("clip_to_range", "daily", "select id, event_day, cum_area_km2 from daily where event_day between 3 and 20 and cum_area_km2 between 1 and 10",
    lambda spark, sf: C.within(V.daily(spark, sf), event_day=(3, 20), cum_area_km2=(1.0, 10.0)).select("id", "event_day", "cum_area_km2"))
_op("formatted_labels", "fires", "select lc_name, concat('p = ', cast(cast(round_even(count(*) / 7e4, 3) as decimal(9, 3)) as varchar)) as p, format('{:,}', count(*) * 1000) as n from fires group by lc_name",
    lambda spark, sf: V.fires(spark, sf).groupBy("lc_name").agg(F.count(F.lit(1)).alias("k")).select("lc_name", F.concat(F.lit("p = "), C.half_even(c("k") / 7e4, 3).cast("decimal(9,3)").cast("string")).alias("p"), C.thousands(c("k") * 1000).alias("n")))

# --- joins ------------------------------------------------------------------------------------------

_op("left_join_null_keys", "fires", """, m as (select lc_name, round(avg(duration), 6) as d from fires group by lc_name) select f.fire_id, d from fires f left join m on f.lc_name is not distinct from m.lc_name""",
    lambda spark, sf: rounded(join_keys(V.fires(spark, sf).select("fire_id", "lc_name"), V.fires(spark, sf).groupBy("lc_name").agg(F.avg("duration").alias("d")), ["lc_name"], "left").select("fire_id", "d")))
_op("natural_left_join", "fires", """, m as (select l1_ecoregion, lc_name, max(duration) as d from fires group by 1, 2) select f.fire_id, cast(d as double) as d from fires f left join m on f.lc_name is not distinct from m.lc_name and f.l1_ecoregion is not distinct from m.l1_ecoregion""",
    lambda spark, sf: natural_left_join(V.fires(spark, sf).select("fire_id", "l1_ecoregion", "lc_name"), V.fires(spark, sf).groupBy("l1_ecoregion", "lc_name").agg(F.max("duration").alias("d"))).select("fire_id", c("d").cast("double").alias("d")))
_op("point_to_grid_cell", "fires", "select cast(floor((x + 2300000) / 50000) as bigint) as cx, cast(floor((y + 2100000) / 50000) as bigint) as cy, count(*) as n from fires group by 1, 2",
    lambda spark, sf: S.with_cell(V.fires(spark, sf), 50000.0, -2300000.0, -2100000.0).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")))
_op("point_in_polygon", "fires blocks", f"select fire_id, zone from fires join blocks on {V.IN_ZONE}",
    lambda spark, sf: S.point_in_polygon(V.fires(spark, sf).select("fire_id", "x", "y"), V.zones(spark, sf), "zone").select("fire_id", "zone"))
_op("left_spatial_join", "fires blocks", f"select fire_id, coalesce(zone, -1) as zone from fires left join blocks on {V.IN_ZONE}",
    lambda spark, sf: S.point_in_polygon(V.fires(spark, sf).select("fire_id", "x", "y"), V.zones(spark, sf), "zone", how="left").select("fire_id", F.coalesce("zone", F.lit(-1)).alias("zone")))
_op("co_located_cells", "cells", "select a.cx, a.cy, a.year, a.home_density, b.road_density from cells a left join (select * from cells where road_density > 10) b using (cx, cy, year)",
    lambda spark, sf: V.cells(spark, sf).select("cx", "cy", "year", "home_density").join(V.cells(spark, sf).where("road_density > 10").select("cx", "cy", "year", "road_density"), ["cx", "cy", "year"], "left"))
_op("polygon_overlay", "blocks", f""", h as (select zone as other, holed, x0 + 230000 as x0, y0 + 140000 as y0 from blocks)
select * from (select zone, other, round({V.zone_area('h.x0', 'h.y0', '920000', '580000', block='b.')}
 - {V.zone_area('case when h.holed then h.x0 + 230000 else h.x0 + 690000 end', 'case when h.holed then h.y0 + 145000 else h.y0 + 435000 end', '230000', '145000', block='b.')}, 3) as area
 from blocks b, h) where area > 0""",
    lambda spark, sf: rounded(overlay(V.zones(spark, sf), "zone", V.zones(spark, sf).select(
        c("zone").alias("other"), S.reproject("geom", lambda x, y: F.struct((x + 230000.0).alias("x"), (y + 140000.0).alias("y"))).alias("geom")), "other"), 3))
_op("clip_to_mask", "cells blocks", f""", g as (select cx, cy, (cx - 25) * 90000e0 as x, (cy - 20) * 90000e0 as y from cells),
t as (select cx, cy, {V.zone_area('x', 'y', '90000', '90000')} as a from g join blocks on x < x0 + 920000 and x + 90000 > x0 and y < y0 + 580000 and y + 90000 > y0 where a > 0)
select cx, cy, round(sum(a) / 1e6, 6) as land_km2 from t group by 1, 2""",
    lambda spark, sf: rounded(S.clip_to_cover(V.cells(spark, sf).select((c("cx") - 25).alias("cx"), (c("cy") - 20).alias("cy")), cover_area(V.zones(spark, sf), "zone", 90000.0), "area")
        .groupBy((c("cx") + 25).alias("cx"), (c("cy") + 20).alias("cy")).agg((F.sum("area") / 1e6).alias("land_km2"))))
_op("clip_to_box", "fires", "select fire_id, x, y from fires where x between -500000 and 700000 and y between -1000000 and 0",
    lambda spark, sf: S.clip_to_box(V.fires(spark, sf), -500000, -1000000, 700000, 0).select("fire_id", "x", "y"))
_op("points_per_polygon", "fires blocks", f", hits as (select zone, count(*) as n from fires join blocks on {V.IN_ZONE} where max_growth_ha > 9000 group by zone) select zone, coalesce(n, 0) as n from blocks left join hits using (zone)",
    lambda spark, sf: S.count_in_polygons(V.zones(spark, sf), "zone", V.fires(spark, sf).where("max_growth_ha > 9000")).select("zone", "n"))
_op("line_length_per_cell", "roads", """, t as (select line_id, x1, y1, x2, y2, (unnest(range(cast(floor(least(x1, x2) / 50000) as bigint), cast(floor(greatest(x1, x2) / 50000) as bigint) + 2)) * 50000e0 - x1) / (x2 - x1) as s from roads where x1 <> x2
 union select line_id, x1, y1, x2, y2, (unnest(range(cast(floor(least(y1, y2) / 50000) as bigint), cast(floor(greatest(y1, y2) / 50000) as bigint) + 2)) * 50000e0 - y1) / (y2 - y1) from roads where y1 <> y2
 union select line_id, x1, y1, x2, y2, unnest([0e0, 1e0]) from roads),
p as (select *, lead(s) over (partition by line_id order by s) as e from t where s between 0 and 1)
select cast(floor((x1 + (s + e) / 2 * (x2 - x1)) / 50000) as bigint) as cx, cast(floor((y1 + (s + e) / 2 * (y2 - y1)) / 50000) as bigint) as cy,
 round(sum((e - s) * sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 1000), 6) as km from p where e > s and (x1 <> x2 or y1 <> y2) group by 1, 2""",
    lambda spark, sf: rounded(S.line_km_per_cell(V.roads(spark, sf), 50000.0)))
_op("zonal_sum_grid", "cells", "select cast(floor(cx / 5) as bigint) as zx, cast(floor(cy / 5) as bigint) as zy, round(sum(home_density), 6) as homes from cells group by 1, 2",
    lambda spark, sf: rounded(R.zonal_sum(V.cells(spark, sf), [F.floor(c("cx") / 5).alias("zx"), F.floor(c("cy") / 5).alias("zy")], {"homes": "home_density"})))
_op("zonal_sum_polygons", "cells blocks", f", g as (select *, (cx - 25 + 0.5e0) * 90000 as x, (cy - 20 + 0.5e0) * 90000 as y from cells) select zone, round(sum(home_density), 6) as homes from g join blocks on {V.IN_ZONE} group by zone",
    lambda spark, sf: rounded(R.zonal_sum_polygons(R.to_points(V.cells(spark, sf), 90000.0, -25 * 90000.0, -20 * 90000.0, "home_density"), V.zones(spark, sf), "zone", {"homes": "home_density"})))
_op("raster_algebra", "cells", "select cx, cy, round(home_density + case when landcover < 9 then road_density else 0 end, 6) as value from cells",
    lambda spark, sf: rounded(R.add(V.cells(spark, sf).select("cx", "cy", c("home_density").alias("value")), V.cells(spark, sf).where("landcover < 9").select("cx", "cy", c("road_density").alias("value")))))

# --- aggregates -----------------------------------------------------------------------------------------

_op("null_aware_reducers", "fires", """select us_l3name, ignition_year, ignition_month, round(avg(max_growth_ha), 6) as mean_skip, case when count(max_growth_ha) = count(*) then round(avg(max_growth_ha), 6) end as mean_strict,
 case when count(max_growth_ha) = count(*) then round(max(max_growth_ha), 6) end as max_strict, case when count(max_growth_ha) = count(*) then round(sum(max_growth_ha), 5) end as sum_strict from fires group by 1, 2, 3""",
    lambda spark, sf: rounded(V.fires(spark, sf).groupBy("us_l3name", "ignition_year", "ignition_month").agg(
        F.avg("max_growth_ha").alias("mean_skip"), G.strict_mean("max_growth_ha").alias("mean_strict"), G.strict_max("max_growth_ha").alias("max_strict"), G.strict_sum("max_growth_ha").alias("sum_strict")), sum_strict=5))
_op("exact_median", "", "select l_returnflag, l_linestatus, round(median(l_extendedprice), 6) as price, round(quantile_cont(l_quantity, 0.25), 6) as q1, round(quantile_cont(l_quantity, 0.9), 6) as q9 from lineitem group by 1, 2",
    lambda spark, sf: rounded(Q.multi_quantiles(V.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"price": ("l_extendedprice", 0.5), "q1": ("l_quantity", 0.25), "q9": ("l_quantity", 0.9)})))
_op("sample_deviation", "fires", "select l1_ecoregion, round(stddev_samp(fsr_ha_per_day), 6) as sd, round(stddev_samp(datediff('day', date '1970-01-01', ignition_date)) * 2, 6) as season_days from fires group by 1",
    lambda spark, sf: rounded(V.fires(spark, sf).groupBy("l1_ecoregion").agg(F.stddev_samp("fsr_ha_per_day").alias("sd"), (G.date_sd("ignition_date") * 2).alias("season_days"))))
_op("group_mode", "fires", """, w as (select us_l3name, coalesce(lc_name, '') as v, count(*) as n, min(fire_id) as s from fires group by 1, 2) select us_l3name, nullif(arg_min(v, (-n, s)), '') as lc_name from w group by 1""",
    lambda spark, sf: G.group_mode(V.fires(spark, sf), ["us_l3name"], ["lc_name"], "fire_id"))
_op("first_in_group", "fires", "select us_l3name, arg_min(coalesce(lc_name, '?'), fire_id) as first_class from fires group by 1",
    lambda spark, sf: V.fires(spark, sf).withColumn("lc", F.coalesce("lc_name", F.lit("?"))).groupBy("us_l3name").agg(G.first_by("lc", "fire_id").alias("first_class")))
_op("having_filter", "fires", "select us_l3name, ignition_year, count(*) as n from fires group by 1, 2 having count(*) >= 60",
    lambda spark, sf: V.fires(spark, sf).groupBy("us_l3name", "ignition_year").agg(F.count(F.lit(1)).alias("n")).where("n >= 60"))
_op("grand_total", "fires", "select round_even(sum(max_growth_km2), 0) as growth, round_even(sum(total_area_km2), 0) as area, 'All' as label from fires",
    lambda spark, sf: V.fires(spark, sf).agg(C.half_even(F.sum("max_growth_km2")).alias("growth"), C.half_even(F.sum("total_area_km2")).alias("area"), F.lit("All").alias("label")))
_op("subtotals_and_total", "fires", """select l1_ecoregion as g, count(*) as n from fires where l1_ecoregion is not null group by 1 having count(*) > 250 union all select 'Total', count(*) from fires""",
    lambda spark, sf: V.fires(spark, sf).where("l1_ecoregion is not null").groupBy(c("l1_ecoregion").alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n > 250").unionByName(V.fires(spark, sf).agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.lit("Total"))))
_op("distinct_values", "fires", "select count(distinct us_l3name) as regions, count(distinct lc_name) as classes, count(distinct ignition_doy) as days from fires",
    lambda spark, sf: V.fires(spark, sf).agg(F.count_distinct("us_l3name").alias("regions"), F.count_distinct("lc_name").alias("classes"), F.count_distinct("ignition_doy").alias("days")))
_op("raster_value_frequency", "cells", "select year, landcover, count(*) as n from cells group by 1, 2",
    lambda spark, sf: V.cells(spark, sf).groupBy("year", "landcover").agg(F.count(F.lit(1)).alias("n")))
_op("conditional_share", "fires", "select l1_ecoregion, round(count(*) filter (where max_growth_ha > 8000) * 100e0 / count(*), 6) as pct, count(*) filter (where max_growth_ha > 8000) * 2500e0 as km2 from fires group by 1",
    lambda spark, sf: rounded(V.fires(spark, sf).groupBy("l1_ecoregion").agg(G.share_percent(c("max_growth_ha") > 8000).alias("pct"), G.cell_area(c("max_growth_ha") > 8000, 50.0).alias("km2"))))
_op("group_extremes", "fires", "select lc_name, min(fsr_ha_per_day) as lo, max(fsr_ha_per_day) as hi from fires group by 1",
    lambda spark, sf: V.fires(spark, sf).groupBy("lc_name").agg(F.min("fsr_ha_per_day").alias("lo"), F.max("fsr_ha_per_day").alias("hi")))
_op("two_stage_aggregate", "daily", ", e as (select id, max(duration) as duration, min(l1_ecoregion) as g from daily group by id) select g, round(avg(duration), 6) as mean, round(stddev_samp(duration), 6) as sd from e group by g",
    lambda spark, sf: rounded(V.daily(spark, sf).groupBy("id").agg(F.max("duration").alias("duration"), F.min("l1_ecoregion").alias("g")).groupBy("g").agg(F.avg("duration").alias("mean"), F.stddev_samp("duration").alias("sd"))))
_op("nest_and_unnest", "daily", "select id, event_day, pixels from daily",
    lambda spark, sf: G.unnest(G.nest(V.daily(spark, sf).select("id", "event_day", "pixels"), ["id"])))
_op("dissolve_regions", "blocks", f", g as (select ix as cx, iy as cy, (ix + 0.5e0) * 50000 as x, (iy + 0.5e0) * 50000 as y from range(-50, 50) a(ix), range(-50, 30) b(iy)) select na_l1name, cx, cy from g join blocks on {V.IN_ZONE}",
    lambda spark, sf: S.dissolve(S.cover(V.zones(spark, sf), "zone", 50000.0).join(V.zones(spark, sf).select("zone", "na_l1name"), "zone"), ["na_l1name"]))
_op("dissolve_polygons", "blocks", """, s as (select na_l1name, x0, y0, 920000e0 * 580000 - 230000e0 * 145000 as area, 3000000e0 + case when holed then 750000 else 0 end as border,
 case when holed then 580000e0 else 435000e0 end as east, case when holed then 920000e0 else 690000e0 end as north from blocks),
shared as (select a.na_l1name, sum(case when b.x0 > a.x0 then a.east else a.north end) as length from s a join s b on a.na_l1name = b.na_l1name and ((b.x0 = a.x0 + 920000 and b.y0 = a.y0) or (b.x0 = a.x0 and b.y0 = a.y0 + 580000)) group by 1)
select na_l1name, round(sum(area) / 1e6, 6) as area_km2, round((sum(border) - 2 * coalesce(max(length), 0)) / 1000, 6) as border_km from s left join shared using (na_l1name) group by 1""",
    lambda spark, sf: rounded(P.region_borders(V.zones(spark, sf), "na_l1name")))
_op("yearly_statistics", "fires", """select l1_ecoregion, ignition_year as year, count(total_area_km2) as n, round(avg(total_area_km2), 6) as mean, round(stddev_samp(total_area_km2), 6) as sd, round(min(total_area_km2), 6) as min,
 round(median(total_area_km2), 6) as median, round(max(total_area_km2), 6) as max from fires where l1_ecoregion is not null group by 1, 2""",
    lambda spark, sf: rounded(G.yearly_stats(V.fires(spark, sf).withColumnRenamed("ignition_year", "year"), "l1_ecoregion", "total_area_km2")))

# --- windows, sorts ------------------------------------------------------------------------------------------

_op("group_max_on_rows", "fires", "select fire_id, duration * 1e0 as duration, max(duration) over (partition by us_l3name) as longest from fires",
    lambda spark, sf: G.with_group_max(V.fires(spark, sf).select("fire_id", "us_l3name", c("duration").cast("double").alias("duration")), ["us_l3name"], "duration", "longest").withColumn("longest", c("longest").cast("int")).drop("us_l3name"))
_op("lag_and_rate", "daily", """select id, event_day, cast(lag(cum_pixels) over w as double) as prior_cum_pixels, cast(lag(event_day) over w as double) as prior_event_day, cast(cum_pixels - lag(cum_pixels) over w as double) as gain,
 cast(event_day - lag(event_day) over w as double) as span, round((cum_pixels - lag(cum_pixels) over w) / (event_day - lag(event_day) over w), 6) as rate from daily window w as (partition by id order by event_day)""",
    lambda spark, sf: rounded(G.consecutive_rate(V.daily(spark, sf), "id", "event_day", "cum_pixels").select("id", "event_day", *[c(k).cast("double").alias(k) for k in ("prior_cum_pixels", "prior_event_day", "gain", "span", "rate")])))
_op("change_first_to_last", "fires", ", y as (select l1_ecoregion, ignition_year as yr, avg(fsr_ha_per_day) as m from fires where l1_ecoregion is not null group by 1, 2) select l1_ecoregion, round(arg_max(m, yr) - arg_min(m, yr), 6) as change from y group by 1",
    lambda spark, sf: rounded(V.fires(spark, sf).where("l1_ecoregion is not null").groupBy("l1_ecoregion", "ignition_year").agg(F.avg("fsr_ha_per_day").alias("m")).groupBy("l1_ecoregion").agg(G.change_over("m", "ignition_year").alias("change"))))
_op("dense_event_id", "fires", "select fire_id, dense_rank() over (order by concat(us_l3name, '_', cast(ignition_year as varchar))) as event_no from fires",
    lambda spark, sf: G.dense_id(V.fires(spark, sf).select("fire_id", F.concat_ws("_", "us_l3name", "ignition_year").alias("k")), "k", "event_no").drop("k"))
_op("row_numbers", "fires", "select fire_id, row_number() over (order by x, fire_id) as row_no from fires",
    lambda spark, sf: G.row_ordinal(V.fires(spark, sf).select("x", "fire_id"), ["x", "fire_id"], "row_no").drop("x"))
_op("keep_first_per_key", "fires", "select us_l3name, fire_id, x, y from fires qualify row_number() over (partition by us_l3name order by x, y, fire_id) = 1",
    lambda spark, sf: G.keep_first(V.fires(spark, sf).select("us_l3name", "fire_id", "x", "y"), ["us_l3name"], ["x", "y", "fire_id"]))
_op("global_z_score", "fires", "select fire_id, round((duration - avg(duration) over ()) / stddev_samp(duration) over (), 6) as z from fires",
    lambda spark, sf: rounded(G.z_score(V.fires(spark, sf).select("fire_id", "duration"), "duration", "z").select("fire_id", "z")))
_op("sort_descending", "fires", "select us_l3name, count(*) as n from fires group by 1",
    lambda spark, sf: V.fires(spark, sf).groupBy("us_l3name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc_nulls_last("n"), "us_l3name"))
_op("sort_groups_by_max", "fires", "select l1_ecoregion, us_l3name, count(*) as n from fires group by 1, 2",
    lambda spark, sf: G.with_group_max(V.fires(spark, sf).groupBy("l1_ecoregion", "us_l3name").agg(F.count(F.lit(1)).alias("n")), ["l1_ecoregion"], "n", "m").orderBy(F.desc_nulls_last("m"), F.desc_nulls_last("l1_ecoregion"), F.desc("n"), "us_l3name").drop("m"))
_op("top_rows_with_ties", "fires", "select us_l3name, fire_id, duration from fires qualify duration = max(duration) over (partition by us_l3name)",
    lambda spark, sf: G.top_rows(V.fires(spark, sf).select("us_l3name", "fire_id", "duration"), ["us_l3name"], "duration"))
_op("append_by_name", "", "select n_nationkey as k, n_name as name from nation union all select r_regionkey, r_name from region",
    lambda spark, sf: V.table(spark, sf, "nation").select(c("n_nationkey").alias("k"), c("n_name").alias("name")).unionByName(V.table(spark, sf, "region").select(c("r_name").alias("name"), c("r_regionkey").alias("k"))))

# --- statistics ---------------------------------------------------------------------------------------------------

_op("theil_sen_slope", "fires", f""", y as (select us_l3name, ignition_year as x, fsr_ha_per_day as v from fires),
sl as (select a.us_l3name, (b.v - a.v) / (b.x - a.x) as s from y a join y b on a.us_l3name = b.us_l3name and a.x < b.x),
{O.signed_rank('sl', 'us_l3name')}, m as (select us_l3name, median(s) as slope, count(*) as k from sl group by 1),
r as (select us_l3name, median(v - slope * x) as intercept, count(*) as n from y join m using (us_l3name) group by 1)
select us_l3name, r.n, k * 1e0 as n_slopes, round(slope, 6) as slope, round(intercept, 4) as intercept, v, round(z, 6) as z, round(p, 6) as p from m join r using (us_l3name) left join wx using (us_l3name)""",
    lambda spark, sf: rounded(T.theil_sen(V.fires(spark, sf), ["us_l3name"], "ignition_year", "fsr_ha_per_day").drop("p_error"), intercept=4))
_op("repeated_medians_slope", "fires", """, y as (select us_l3name, ignition_year as x, avg(fsr_ha_per_day) as v from fires group by 1, 2),
p as (select a.us_l3name, a.x, median((b.v - a.v) / (b.x - a.x)) as s, median((b.x * a.v - a.x * b.v) / (b.x - a.x)) as t from y a join y b on a.us_l3name = b.us_l3name and a.x <> b.x group by 1, 2)
select us_l3name, count(*) as n, round(median(s), 6) as slope, round(median(t), 4) as intercept from p group by 1""",
    lambda spark, sf: rounded(T.repeated_medians(V.fires(spark, sf), ["us_l3name"], "ignition_year", "fsr_ha_per_day").select("us_l3name", "n", "slope", "intercept"), intercept=4))
_op("trend_labels", "fires", """, s as (select us_l3name, round(regr_slope(fsr_ha_per_day, ignition_year), 6) as slope, case when count(*) % 3 = 0 then null else count(*) % 100 / 100e0 end as p from fires group by 1)
select us_l3name, case when p is null then 'Insufficient data' when p >= 0.05 then 'Not Significant' when slope > 0 then 'Positive' else 'Negative' end as label from s""",
    lambda spark, sf: V.fires(spark, sf).groupBy("us_l3name").agg(F.regr_slope("fsr_ha_per_day", "ignition_year").alias("slope"), F.count(F.lit(1)).alias("k")).withColumn("p", F.when(c("k") % 3 != 0, c("k") % 100 / 100)).select("us_l3name", T.trend_label("slope", "p", "Insufficient data").alias("label")))
_op("least_squares_by_group", "fires", "select us_l3name, cast(regr_count(fsr_ha_per_day, duration) as bigint) as n, round(regr_slope(fsr_ha_per_day, duration), 6) as slope, round(regr_intercept(fsr_ha_per_day, duration), 6) as intercept, round(regr_syy(fsr_ha_per_day, duration) - regr_slope(fsr_ha_per_day, duration) * regr_sxy(fsr_ha_per_day, duration), 3) as rss from fires group by 1",
    lambda spark, sf: rounded(M.ols(V.fires(spark, sf), ["us_l3name"], "duration", "fsr_ha_per_day").select("us_l3name", "n", "slope", "intercept", "rss"), rss=3))
_COEF = """l as (select us_l3name, regr_count(v, x) as n, regr_avgx(v, x) as xb, regr_sxx(v, x) as sxx, regr_slope(v, x) as b, regr_intercept(v, x) as a, regr_syy(v, x) - regr_slope(v, x) * regr_sxy(v, x) as rss from (select us_l3name, fsr_ha_per_day as v, duration as x from fires) group by 1)"""
_op("coefficient_table", "fires", f""", {_COEF}, t as (select us_l3name, n, '(Intercept)' as term, a as estimate, sqrt(rss / (n - 2)) * sqrt(1e0 / n + xb * xb / sxx) as std_error from l union all select us_l3name, n, 'duration', b, sqrt(rss / (n - 2)) / sqrt(sxx) from l)
select us_l3name, term, round(estimate, 6) as estimate, round(std_error, 6) as std_error, round(estimate / std_error, 6) as statistic, round({O.f_p('power(estimate / std_error, 2)', '1', '(n - 2)')}, 6) as p_value from t""",
    lambda spark, sf: rounded(M.tidy(M.ols(V.fires(spark, sf), ["us_l3name"], "duration", "fsr_ha_per_day"), ["us_l3name"], "duration")))
_op("interaction_coefficients", "fires", """, l as (select lc_name as g, regr_count(v, x) as n, regr_avgx(v, x) as xb, regr_sxx(v, x) as sxx, regr_slope(v, x) as b, regr_intercept(v, x) as a, regr_syy(v, x) - regr_slope(v, x) * regr_sxy(v, x) as rss
 from (select lc_name, fsr_km2_per_day as v, total_area_km2 as x from fires where lc_name is not null) group by 1),
s as (select sqrt(sum(rss) / sum(n - 2)) as s from l), z as (select * from l order by g limit 1),
t as (select case when l.g = z.g then '(Intercept)' else concat('lc_name', l.g) end as term, case when l.g = z.g then l.a else l.a - z.a end as estimate,
 s * sqrt(1e0 / l.n + l.xb * l.xb / l.sxx + case when l.g = z.g then 0 else 1e0 / z.n + z.xb * z.xb / z.sxx end) as std_error from l, z, s
 union all select case when l.g = z.g then 'total_area_km2' else concat('total_area_km2:lc_name', l.g) end, case when l.g = z.g then l.b else l.b - z.b end, s * sqrt(1 / l.sxx + case when l.g = z.g then 0 else 1 / z.sxx end) from l, z, s)
select term, round(estimate, 7) as estimate, round(std_error, 7) as std_error, round(estimate / std_error, 5) as statistic from t""",
    lambda spark, sf: rounded(M.interaction_tidy(M.interaction_levels(V.fires(spark, sf), [], "lc_name", "total_area_km2", "fsr_km2_per_day"), [], "lc_name", "total_area_km2").drop("p_value"), 7, statistic=5))
_op("fitted_rows_and_bands", "fires", f""", {_COEF}, r as (select fire_id, us_l3name, duration as x, fsr_ha_per_day as v from fires where duration is not null),
o as (select fire_id, a + b * x as f, sqrt(rss / (n - 2)) * sqrt(1e0 / n + (x - xb) * (x - xb) / sxx) as se, v from r join l using (us_l3name))
select fire_id, round(f, 6) as fitted, round(se, 6) as se_fit, round(f - 1.96e0 * se, 6) as lower, round(f + 1.96e0 * se, 6) as upper, round(v - f, 6) as resid from o""",
    lambda spark, sf: rounded(M.augment(V.fires(spark, sf).where("duration is not null").select("fire_id", "us_l3name", "duration", "fsr_ha_per_day"), M.ols(V.fires(spark, sf), ["us_l3name"], "duration", "fsr_ha_per_day"), ["us_l3name"], "duration", "fsr_ha_per_day").select("fire_id", "fitted", "se_fit", "lower", "upper", "resid")))
_op("correlation_test", "fires", f""", k as (select us_l3name, count(*) as n, corr(fsr_ha_per_day, ignition_doy) as r from fires group by 1)
select us_l3name, n, round(r, 6) as r, round(r * r, 6) as r_squared, round(r * sqrt(n - 2) / sqrt(1 - r * r), 6) as t, round({O.f_p('r * r * (n - 2) / (1 - r * r)', '1', '(n - 2)')}, 6) as p from k""",
    lambda spark, sf: rounded(M.correlation(V.fires(spark, sf), ["us_l3name"], "ignition_doy", "fsr_ha_per_day")))
_op("smoothed_lines", "fires", """, l as (select l1_ecoregion, lc_name, regr_count(v, x) as n, regr_avgx(v, x) as xb, regr_sxx(v, x) as sxx, regr_slope(v, x) as b, regr_intercept(v, x) as a, regr_syy(v, x) - regr_slope(v, x) * regr_sxy(v, x) as rss, min(x) as lo, max(x) as hi
 from (select l1_ecoregion, lc_name, total_area_km2 as x, fsr_km2_per_day as v from fires where l1_ecoregion is not null and lc_name is not null and total_area_km2 is not null) group by 1, 2),
o as (select *, lo + i * (hi - lo) / 19 as x from l, range(0, 20) r(i)), e as (select *, sqrt(rss / (n - 2)) * sqrt(1e0 / n + (x - xb) * (x - xb) / sxx) as se from o)
select l1_ecoregion, lc_name, cast(i as int) as i, round(x, 6) as total_area_km2, round(a + b * x, 6) as fitted, round(se, 6) as se_fit, round(a + b * x - 1.96e0 * se, 6) as lower, round(a + b * x + 1.96e0 * se, 6) as upper from e""",
    lambda spark, sf: rounded(M.smooth_lines(V.fires(spark, sf).where("l1_ecoregion is not null and lc_name is not null"), ["l1_ecoregion", "lc_name"], "total_area_km2", "fsr_km2_per_day", 20)))
_op("predict_new_rows", "fires", f""", {_COEF} select f.us_l3name, d.n as duration, round(a + b * d.n, 6) as predicted from (select distinct us_l3name from fires) f, (select cast(unnest([1, 5, 9]) as int) as n) d join l on l.us_l3name = f.us_l3name""",
    lambda spark, sf: rounded(M.predict(V.fires(spark, sf).select("us_l3name").distinct().select("us_l3name", F.explode(F.array(F.lit(1), F.lit(5), F.lit(9))).alias("duration")), M.ols(V.fires(spark, sf), ["us_l3name"], "duration", "fsr_ha_per_day"), ["us_l3name"], "duration")))
_op("fixed_break_counts", "cells", """, v as (select home_density * coalesce(road_density, 0) as v from cells), b as (select unnest([0, 10, 20, 50, 100, 500, 1000]) * 1e0 as lo, unnest([10, 20, 50, 100, 500, 1000, 100000]) * 1e0 as hi, unnest([1, 2, 3, 4, 5, 6, 7]) as class)
select cast(class as int) as class, lo, hi, count(*) as n from v join b on v >= lo and (v < hi or (class = 7 and v = hi)) group by 1, 2, 3""",
    lambda spark, sf: B.fixed_class_counts(V.cells(spark, sf).withColumn("v", c("home_density") * c("road_density")), "v", C.HOMES_INTERVALS))

# --- geometry --------------------------------------------------------------------------------------------------------

_LAEA = """, k as (select fire_id, radians(x / 50000) as lam, radians(38 + y / 200000) as phi, radians(45e0) as p0 from fires),
p as (select fire_id, 6370997e0 * sqrt(2 / (1 + sin(p0) * sin(phi) + cos(p0) * cos(phi) * cos(lam))) * cos(phi) * sin(lam) as x,
 6370997e0 * sqrt(2 / (1 + sin(p0) * sin(phi) + cos(p0) * cos(phi) * cos(lam))) * (cos(p0) * sin(phi) - sin(p0) * cos(phi) * cos(lam)) as y, degrees(lam) - 100 as lon, degrees(phi) as lat from k)
select fire_id, round(x, 3) as x, round(y, 3) as y, round(lon, 6) as lon, round(lat, 6) as lat from p"""


def reprojection(spark, sf):
    f = V.fires(spark, sf).select("fire_id", S.to_laea(c("x") / 50000 - 100, F.lit(38) + c("y") / 200000).alias("p"))
    back = f.select("fire_id", "p.x", "p.y", S.from_laea("p.x", "p.y").alias("q"))
    return rounded(back.select("fire_id", "x", "y", "q.lon", "q.lat"), x=3, y=3)


_op("project_and_back", "fires", _LAEA, reprojection)
_op("numbered_fishnet", "fires", """select 46 * iy + ix + 1 as cell_id, ix as cx, iy as cy, -2300000e0 + (ix + 0.5e0) * 100000 as x, -2100000e0 + (iy + 0.5e0) * 100000 as y,
 n from range(0, 46) a(ix), range(0, 29) c(iy) left join (select floor((x + 2300000) / 100000) as gx, floor((y + 2100000) / 100000) as gy, count(*) as n from fires group by 1, 2) f on gx = ix and gy = iy where n is not null""",
    lambda spark, sf: S.fishnet(spark, -2300000.0, -2100000.0, 2300000.0, 800000.0, 100000.0).join(
        S.with_cell(V.fires(spark, sf), 100000.0, -2300000.0, -2100000.0).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")), ["cx", "cy"]))
_op("polygon_centroid_and_area", "blocks", """, a as (select zone, holed, x0, y0, 920000e0 * 580000 as full_area from blocks),
m as (select zone, full_area * 15 / 16 as area, case when holed then (full_area * (x0 + 460000) - full_area / 16 * (x0 + 345000)) else (full_area * (x0 + 460000) - full_area / 16 * (x0 + 805000)) end as mx,
 case when holed then (full_area * (y0 + 290000) - full_area / 16 * (y0 + 217500)) else (full_area * (y0 + 290000) - full_area / 16 * (y0 + 507500)) end as my from a)
select zone, area, round(mx / area, 3) as x, round(my / area, 3) as y from m""",
    lambda spark, sf: rounded(V.zones(spark, sf).select("zone", S.area("geom").alias("area"), S.centroid("geom").alias("p")).select("zone", "area", "p.x", "p.y"), 3))
_op("point_columns", "fires", "select fire_id, x, y from fires",
    lambda spark, sf: S.point_columns(V.fires(spark, sf).select("fire_id", S.as_point("x", "y").alias("p"), F.lit(0).alias("x")), "p").drop("p"))
_op("line_length", "roads", "select line_id, round(2 * sqrt(power(x2 - x1, 2) + power(y2 - y1, 2)), 6) as length from roads",
    lambda spark, sf: rounded(V.roads(spark, sf).select("line_id", S.line_length("array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2), named_struct('x', x1, 'y', y1))").alias("length"))))
_op("line_segments", "roads", "select line_id, 0 as seq, x1, y1, x2, y2 from roads union all select line_id, 1, x2, y2, x1, y1 from roads",
    lambda spark, sf: S.segments(V.roads(spark, sf).select("line_id", F.array(S.as_point("x1", "y1"), S.as_point("x2", "y2"), S.as_point("x1", "y1")).alias("geom")), "line_id"))
_op("bounding_box", "blocks", "select min(x0) as xmin, min(y0) as ymin, max(x0) + 920000 as xmax, max(y0) + 580000 as ymax, (max(x0) + 920000 - min(x0)) * (max(y0) + 580000 - min(y0)) as area from blocks",
    lambda spark, sf: S.bounding_box(V.zones(spark, sf), "geom").select("xmin", "ymin", "xmax", "ymax", S.area("geom").alias("area")))
_op("remove_holes", "blocks", "select zone, 920000e0 * 580000 * case when holed then 1 else 15e0 / 16 end as area from blocks",
    lambda spark, sf: rounded(V.zones(spark, sf).withColumn("geom", S.remove_holes("geom")).select("zone", S.area("geom").alias("area")), 3))
_op("polygon_cover", "blocks", f", g as (select ix as cx, iy as cy, (ix + 0.5e0) * 30000 as x, (iy + 0.5e0) * 30000 as y from range(-90, 90) a(ix), range(-90, 50) b(iy)) select zone, cx, cy from g join blocks on {V.IN_ZONE}",
    lambda spark, sf: S.cover(V.zones(spark, sf), "zone", 30000.0))
_op("explode_points", "roads", "select line_id, x1 as x, y1 as y from roads union all select line_id, x2, y2 from roads",
    lambda spark, sf: S.explode_points(V.roads(spark, sf).select("line_id", F.array(S.as_point("x1", "y1"), S.as_point("x2", "y2")).alias("g")), "g").select("line_id", "point.x", "point.y"))
_op("polygon_vertices", "blocks", "select us_l3name, count(*) as n, round(sum(x), 3) as sx, round(sum(y), 3) as sy from (select us_l3name, x0 + unnest(case when holed then [0, 920000, 920000, 0, 0, 230000, 230000, 460000, 460000, 230000] else [0, 920000, 920000, 690000, 690000, 0, 0] end) as x, y0 + unnest(case when holed then [0, 0, 580000, 580000, 0, 145000, 290000, 290000, 145000, 145000] else [0, 0, 435000, 435000, 580000, 580000, 0] end) as y from blocks) group by 1",
    lambda spark, sf: rounded(S.vertices(V.zones(spark, sf), "zone", attributes=["us_l3name"]).groupBy("us_l3name").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")), 3))

# --- rasters ------------------------------------------------------------------------------------------------------------

_op("reclassify_below", "cells", "select cx, cy, case when road_density >= 1 then road_density end as value from cells",
    lambda spark, sf: R.drop_below(V.cells(spark, sf).select("cx", "cy", c("road_density").alias("value")), 1.0))
_op("crop_to_extent", "cells", "select cx, cy, home_density from cells where cx between 10 and 30 and cy between 3 and 25",
    lambda spark, sf: R.crop(V.cells(spark, sf).select("cx", "cy", "home_density"), (10, 30), (3, 25)))
_op("mosaic_layers", "cells", "select cx, cy, round(coalesce(case when year > 2001 then home_density end, 0) + coalesce(case when year < 2003 then road_density end, 0), 6) as value from cells",
    lambda spark, sf: rounded(R.mosaic([V.cells(spark, sf).where("year > 2001").select("cx", "cy", c("home_density").alias("value")), V.cells(spark, sf).where("year < 2003").select("cx", "cy", c("road_density").alias("value"))], R.blank(V.cells(spark, sf)))))
_op("blank_template", "cells", "select distinct cx, cy, 0e0 as value from cells", lambda spark, sf: R.blank(V.cells(spark, sf)))
_op("cell_squares", "cells", "select cx, cy, 1000000e0 as area, cx * 1000e0 + 500 as x, cy * 1000e0 + 500 as y from cells",
    lambda spark, sf: rounded(R.squares(V.cells(spark, sf).select("cx", "cy"), 1000.0).select("cx", "cy", S.area("geom").alias("area"), S.centroid("geom").alias("p")).select("cx", "cy", "area", "p.x", "p.y")))
_op("rasterize_polygons", "blocks", f", g as (select ix as cx, iy as cy, (ix + 0.5e0) * 50000 as x, (iy + 0.5e0) * 50000 as y from range(-60, 80) a(ix), range(-60, 60) b(iy)), z as (select zone, x0, y0, holed from blocks union all select zone, x0 + 200000, y0 + 100000, holed from blocks) select cx, cy, max(zone) as value from g join z as blocks on {V.IN_ZONE} group by 1, 2",
    lambda spark, sf: R.rasterize(V.zones(spark, sf).select(c("zone").alias("id"), "zone", c("zone").alias("ord"), "geom").unionByName(V.zones(spark, sf).select(
        (c("zone") + 100).alias("id"), "zone", c("zone").alias("ord"), S.reproject("geom", lambda x, y: F.struct((x + 200000.0).alias("x"), (y + 100000.0).alias("y"))).alias("geom"))), "id", "zone", "ord", 50000.0))


def _stack(spark, sf):
    cells = V.cells(spark, sf)
    years = sorted(r["year"] for r in cells.select("year").distinct().collect())  # one layer each
    return R.stack({y: cells.where(f"year = {y}").select("cx", "cy", c("home_density").alias("value")) for y in years})


_op("stack_layers", "cells", "select cx, cy, home_density as value, cast(year as int) as year from cells", _stack)


def _regions_sql(diagonal):
    near = "abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1" if diagonal else "abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1"
    near_cells = "(-1, 0), (1, 0), (0, -1), (0, 1)" + (", (-1, -1), (-1, 1), (1, -1), (1, 1)" if diagonal else "")
    return V.sql("cells", f""", k as (select cx, cy, landcover % 4 as v from cells),
adj as (select a.cx, a.cy, b.cx as bx, b.cy as by from k a, (values {near_cells}) d(dx, dy) join k b on b.cx = a.cx + dx and b.cy = a.cy + dy and b.v = a.v),
reach as (select cx, cy, cx as rx, cy as ry from k union select adj.bx, adj.by, rx, ry from reach join adj using (cx, cy)),
lab as (select cx, cy, min((rx, ry)) as r from reach group by 1, 2),
sides as (select r, count(*) as shared from lab a join lab b using (r) where abs(a.cx - b.cx) + abs(a.cy - b.cy) = 1 group by r)
select struct_extract_at(r, 1) as rx, struct_extract_at(r, 2) as ry, any_value(v) as value, count(*) as n_cells, count(*) * 4 - coalesce(any_value(shared), 0) as boundary_edges
 from lab join k using (cx, cy) left join sides using (r) group by r""")


def _regions(connectivity):
    def run(spark, sf):
        cells = V.cells(spark, sf)
        src = cells.select("cx", "cy", (c("landcover") % 4).alias("value"))
        f = R.region_features(R.raster_regions(src, connectivity, tile=16))
        half, shift = F.lit(1 << 30), F.lit(1 << 31)
        return f.select((F.floor(c("region") / shift) - half).cast("long").alias("rx"), (c("region") % shift - half).alias("ry"), "value", "n_cells", "boundary_edges")
    return run


query("raster_regions_4", _regions_sql(False))(_regions(4))
query("raster_regions_8", _regions_sql(True))(_regions(8))


# Further names of the same whole-table queries.
for _name in ("raster_write_scan_to_points", "natural_left_join", "clip_to_mask", "theil_sen_slope", "stack_layers", "line_length_per_cell", "raster_regions_4", "raster_regions_8"):
    query(f"{_name}_all", ORACLES[_name])(QUERIES[_name])
