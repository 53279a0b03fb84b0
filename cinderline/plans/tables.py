"""Summary report tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.functions import columns as C
from cinderline.operators import grouping as G

DROPPED = ("Water Bodies", "Barren")
#: Classes that the seasonal and duration studies leave out (fixed values).
UNBURNABLE = ("Barren", "Water Bodies", "Permanent Wetlands", "Permanent Snow and Ice")
LABELS = {"l1_ecoregion": "Coterminous US", "lc_name": "All Landcover Types"}


def land_events(events: DataFrame, dropped: Sequence[str] = DROPPED) -> DataFrame:
    """Events on burnable land; geometry is pruned by leaving it out."""
    return events.where(C.all_different("lc_name", dropped)).drop("geom")


def growth_table(events: DataFrame, keys: Sequence[str], dropped=DROPPED, min_n: int = 100) -> DataFrame:
    """Largest daily growth, median and largest spread for groups of more than ``min_n`` complete events."""
    keys = list(keys)
    complete = land_events(events, dropped).dropna("any")
    t = G.with_medians(
        complete, keys,
        {
            "max_single_day_growth": C.half_even(F.max("max_growth_ha")),
            "max_fsr_ha_day": C.half_even(F.max("fsr_ha_per_day")),
            "n": F.count(F.lit(1)),
        },
        {"median_fsr_ha_day": "fsr_ha_per_day"},
    ).where(F.col("n") > min_n).withColumn("median_fsr_ha_day", C.half_even("median_fsr_ha_day"))
    order = [F.desc_nulls_last("median_fsr_ha_day"), *keys]
    if len(keys) > 1:
        t = G.with_group_max(t, keys[:1], "median_fsr_ha_day", "__max")
        order = [F.desc_nulls_last("__max"), F.desc_nulls_last(keys[0]), *order]
    return t.orderBy(*order).select(*keys, "max_single_day_growth", "median_fsr_ha_day", "max_fsr_ha_day", "n")


def _shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = {
        "max_growth_sum_km2": C.half_even(G.strict_sum("max_growth_km2")),
        "total_area_sum_km2": C.half_even(G.strict_sum("total_area_km2")),
        "n": F.count(F.lit(1)),
    }
    return df.groupBy(*keys).agg(*[c.alias(a) for a, c in sums.items()]).withColumn(
        "percent_one_day", C.rounded_percent("max_growth_sum_km2", "total_area_sum_km2")
    )


def single_day_share(events: DataFrame, keys: Sequence[str], dropped=DROPPED, min_n: int = 100) -> DataFrame:
    """Area burned on the fastest day against all area burned, with a grand total over every event.

    A sum over a group with a missing area is missing.
    """
    keys = list(keys)
    land = land_events(events, dropped)
    groups = _shares(land, keys).where(F.col("n") > min_n).where(F.col(keys[0]).isNotNull())
    total = _shares(land, []).withColumns({k: F.lit(LABELS[k]) for k in keys})
    cols = [*keys, "max_growth_sum_km2", "total_area_sum_km2", "percent_one_day"]
    out = groups.withColumn("__last", F.lit(0)).unionByName(total.withColumn("__last", F.lit(1)))
    order = [F.asc("__last")]
    if len(keys) > 1:
        out = G.with_group_max(out, keys[:1], "percent_one_day", "__max")
        order += [F.desc_nulls_last("__max"), F.desc_nulls_last(keys[0])]
    return out.orderBy(*order, F.desc_nulls_last("percent_one_day"), *keys[1:]).select(*cols)


def growth_curves(daily: DataFrame, dropped=C.CURVE_EXCLUDED, max_day: int = 213, max_area: float = 2620.0) -> DataFrame:
    """Cumulative-area curves with merged classes, limited to the displayed range."""
    kept = daily.where(C.all_different("lc_name", dropped)).withColumns({
        "lc_name": C.recode("lc_name", C.MERGED_LANDCOVER),
        "l1_ecoregion": C.recode("l1_ecoregion", C.SHORT_REGION_NAMES),
    })
    return C.within(kept, event_day=(0, max_day), cum_area_km2=(0.0, max_area)).select(
        "id", "event_day", "cum_area_km2", "lc_name", "l1_ecoregion"
    )


def season_stats(events: DataFrame, keys: Sequence[str], dropped=UNBURNABLE, dropped_regions=("Northern Forests",)) -> DataFrame:
    """Per group: count, mean ignition month, season length (two sd of the date, in days) and growth."""
    kept = events.where(F.col("l1_ecoregion").isNotNull() & F.col("lc_name").isNotNull())
    t = G.with_medians(
        kept, keys,
        {
            "n": F.count(F.lit(1)), "peak_season": G.strict_mean("ignition_month"),
            "season_length": G.date_sd("ignition_date") * 2, "max_growth": F.max("max_growth_ha"),
        },
        {"avg_fsr": "fsr_ha_per_day", "avg_max_growth": "max_growth_ha"},
    ).where(C.all_different("lc_name", dropped))
    return t.where(C.all_different("l1_ecoregion", dropped_regions)) if "l1_ecoregion" in keys else t


def spread_by_region(events: DataFrame, key: str) -> DataFrame:
    """Mean spread and mean fastest-day growth per region."""
    return events.groupBy(key).agg(
        F.avg("fsr_ha_per_day").alias("avg_fsr"), F.avg("max_growth_ha").alias("avg_max_growth")
    ).where(F.col(key).isNotNull())


def landcover_counts(cells: DataFrame, classes: DataFrame, value: str = "value") -> DataFrame:
    """Pixels per year and landcover class; classes without a name drop out."""
    freq = cells.groupBy("year", F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return freq.join(classes, "value", "left").dropna("any")
