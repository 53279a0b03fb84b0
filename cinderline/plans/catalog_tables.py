"""Registered queries: summary tables and grouping operators."""

from pyspark.sql import functions as F

from cinderline.functions import columns as C
from cinderline.operators import grouping as G
from cinderline.operators import ranks as R
from cinderline.operators.keys import join_keys, natural_left_join, semi_join
from cinderline.plans import tables as P
from cinderline.plans.registry import query, rounded
from cinderline.sources import views as V

# On the benchmark tables this class plays the part of the excluded landcovers.
DROP = ("5-LOW",)
_LAND = "fires where lc_name <> '5-LOW'"
_COMPLETE = (
    _LAND + " and l1_ecoregion is not null and max_growth_ha is not null and total_area_ha is not null and duration is not null"
)


def _growth_sql(keys):
    return V.sql("fires", f"""select {keys}, round_even(max(max_growth_ha), 0) as max_single_day_growth,
 round_even(median(fsr_ha_per_day), 0) as median_fsr_ha_day, round_even(max(fsr_ha_per_day), 0) as max_fsr_ha_day,
 count(*) as n from {_COMPLETE} group by {keys} having count(*) > 100""")


def _share_sql(keys, total):
    cols = """case when count(max_growth_km2) = count(*) then round_even(sum(max_growth_km2), 0) end as max_growth_sum_km2,
 case when count(total_area_km2) = count(*) then round_even(sum(total_area_km2), 0) end as total_area_sum_km2"""
    first = keys.split(",")[0]
    return V.sql("fires", f""", u as (select {keys}, {cols} from {_LAND} group by {keys}
 having count(*) > 100 and {first} is not null union all select {total}, {cols} from {_LAND})
select *, round_even(max_growth_sum_km2 / nullif(total_area_sum_km2, 0) * 100, 0) as percent_one_day from u""")


@query("q01_region_landcover", _growth_sql("l1_ecoregion, lc_name"))
def q01(spark, sf):
    return P.growth_table(V.fires(spark, sf), ["l1_ecoregion", "lc_name"], DROP)


@query("q02_landcover_spread", _growth_sql("lc_name"))
def q02(spark, sf):
    return P.growth_table(V.fires(spark, sf), ["lc_name"], DROP)


@query("q03_region_spread", _growth_sql("l1_ecoregion"))
def q03(spark, sf):
    return P.growth_table(V.fires(spark, sf), ["l1_ecoregion"], DROP)


@query("q04_single_day_share", _share_sql("l1_ecoregion, lc_name", "'Coterminous US', 'All Landcover Types'"))
def q04(spark, sf):
    return P.single_day_share(V.fires(spark, sf), ["l1_ecoregion", "lc_name"], DROP)


@query("q05_share_by_landcover", _share_sql("lc_name", "'All Landcover Types'"))
def q05(spark, sf):
    return P.single_day_share(V.fires(spark, sf), ["lc_name"], DROP)


@query("q06_share_by_region", _share_sql("l1_ecoregion", "'Coterminous US'"))
def q06(spark, sf):
    return P.single_day_share(V.fires(spark, sf), ["l1_ecoregion"], DROP)


@query("q07_growth_curves", V.sql("daily", """select id, event_day, cum_area_km2,
 case lc_name when 'click' then 'Crops' else lc_name end as lc_name, l1_ecoregion from daily
 where lc_name <> 'error' and event_day between 0 and 213 and cum_area_km2 between 0 and 2620"""))
def q07(spark, sf):
    return P.growth_curves(V.daily(spark, sf), ("error",)).withColumn("lc_name", C.recode("lc_name", {"click": "Crops"}))


_SEASON = """count(*) as n, round(avg(ignition_month), 6) as peak_season,
 round(stddev_samp(datediff('day', date '1970-01-01', ignition_date)) * 2, 6) as season_length,
 round(max(max_growth_ha), 6) as max_growth, round(median(fsr_ha_per_day), 6) as avg_fsr,
 round(median(max_growth_ha), 6) as avg_max_growth
 from fires where l1_ecoregion is not null and lc_name <> '5-LOW'"""


@query("q18_season_stats", V.sql("fires", f"select l1_ecoregion, ignition_year, lc_name, {_SEASON} and l1_ecoregion <> 'AFRICA' group by all"))
def q18(spark, sf):
    return rounded(P.season_stats(V.fires(spark, sf), ["l1_ecoregion", "ignition_year", "lc_name"], DROP, ("AFRICA",)))


@query("q18_landcover_season", V.sql("fires", f"select ignition_year, lc_name, {_SEASON} and ignition_year < 2001 and ignition_year > 1995 group by all"))
def q18b(spark, sf):
    kept = V.fires(spark, sf).where((F.col("ignition_year") < 2001) & (F.col("ignition_year") > 1995))
    return rounded(P.season_stats(kept, ["ignition_year", "lc_name"], DROP))
