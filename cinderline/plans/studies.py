"""Grid maps, trends, exposure and burned-area studies built from the operators."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.functions import columns as C
from cinderline.operators import cells as R
from cinderline.operators import grouping as G
from cinderline.operators import models as M
from cinderline.operators import overlay as O
from cinderline.operators import spatial as S
from cinderline.operators import trend as T
from cinderline.operators.dissolve import dissolve_polygons
from cinderline.operators.keys import join_keys
from cinderline.sources.tables import cut_lineage

METRICS = {"mean_fsr": "fsr_ha_per_day", "max_growth": "max_growth_ha", "duration": "duration"}


# --- fires on a grid --------------------------------------------------------------------------

def land_cells(spark, polys: DataFrame, key: str, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """Numbered grid cells that have some land, with their land area ``land_km2``. The polygons must not overlap."""
    land = O.cover_area(polys, key, size, box[0], box[1]).groupBy("cx", "cy").agg((F.sum("area") / C.M2_PER_KM2).alias("land_km2"))
    return S.fishnet(spark, *box, size).join(land, ["cx", "cy"])


def land_points(points: DataFrame, grid: DataFrame, polys: DataFrame, key: str, size: float, x0: float, y0: float) -> DataFrame:
    """The points on land. Only those in cells that are land in part are tested against the polygons."""
    p = S.with_cell(points, size, x0, y0).join(grid.select("cx", "cy", "land_km2"), ["cx", "cy"])
    whole = F.col("land_km2") >= size * size / C.M2_PER_KM2 * (1 - 1e-9)
    border = S.point_in_polygon(p.where(~whole), polys, key, how="left_semi")
    return p.where(whole).unionByName(border).select(*points.columns)


def cell_summary(points: DataFrame, grid: DataFrame, size: float, x0: float, y0: float) -> DataFrame:
    """Events per grid cell with mean and extreme growth and their classes; cells with events only."""
    s = S.with_cell(points, size, x0, y0).groupBy("cx", "cy").agg(
        F.count(F.lit(1)).alias("freq"), F.avg("fsr_ha_per_day").alias("fsr_ha"),
        G.strict_mean("max_growth_ha").alias("mean_max_growth"), G.strict_max("max_growth_ha").alias("max_max_growth"),
    ).withColumns({
        "class_fsr": C.classify_spread("fsr_ha"), "class_freq": C.classify_frequency("freq"),
        "class_max_fsr": C.classify_mean_growth("mean_max_growth"),
        "class_max_max_fsr": C.classify_peak_growth("max_max_growth"),
    })
    return grid.join(s, ["cx", "cy"])


def all_cells(grid: DataFrame, summary: DataFrame) -> DataFrame:
    return grid.join(summary.drop("cx", "cy", "x", "y", "land_km2"), "cell_id", "left")


def extreme_share(every_cell: DataFrame, size_km: float) -> DataFrame:
    extreme = F.col("class_max_max_fsr") == C.PEAK_GROWTH_LABELS[-1]
    return every_cell.agg(
        F.count_if(extreme).alias("n_extreme_cells"), G.cell_area(extreme, size_km).alias("extreme_km2"),
        G.share_percent(extreme).alias("extreme_percent"),
    )


def extreme_by_zone(summary: DataFrame, zones: DataFrame, key: str, name: str, threshold: float = 10000.0) -> DataFrame:
    """Zones by their number of grid cells with growth above the threshold."""
    hot = summary.where(F.col("max_max_growth") > threshold)
    n = S.count_in_polygons(zones, key, hot, name="n_extreme_cells")
    return n.where(F.col("n_extreme_cells") > 0).select(name, "n_extreme_cells").orderBy(F.desc("n_extreme_cells"), name)


def homes_per_road(raster: DataFrame, size: float, x0: float, y0: float, grid: DataFrame, grid_size: float, gx: float, gy: float) -> DataFrame:
    """Homes per km of road in each grid cell, with its class."""
    pts = R.to_points(raster, size, x0, y0, "homes")
    z = R.zonal_sum(S.with_cell(pts.drop("cx", "cy"), grid_size, gx, gy), [F.col("cx"), F.col("cy")], {"homes_n": "homes", "roads_km": "roads"})
    h = grid.join(z, ["cx", "cy"]).withColumn("homes_per_km_road", C.ratio("homes_n", "roads_km"))
    return h.withColumn("classes", C.cut("homes_per_km_road", C.HOMES_PER_ROAD_BREAKS, C.HOMES_PER_ROAD_LABELS))


def fast_fires_and_homes(homes: DataFrame, summary: DataFrame, threshold: float = 9999.0) -> DataFrame:
    s = summary.select("cell_id", "freq", "max_max_growth", "class_max_max_fsr")
    return join_keys(homes, s, ["cell_id"], "left").where(F.col("max_max_growth") > threshold)


def homes_raster_classes(ratio_cells: DataFrame, size: float, x0: float, y0: float) -> DataFrame:
    p = R.to_points(ratio_cells, size, x0, y0).where(F.col("value") > 0)
    return p.withColumn("classes", C.cut("value", C.HOMES_PER_ROAD_BREAKS, C.HOMES_PER_ROAD_LABELS))


# --- trends ---------------------------------------------------------------------------------------

def cell_trends(points: DataFrame, size: float, x0: float, y0: float, keys: Sequence[str] = (), min_labelled: int = 20, **fit) -> DataFrame:
    """Trends of three metrics per grid cell (and optional further keys), labelled where at least ``min_labelled`` events fall."""
    t = T.metric_trends(S.with_cell(points, size, x0, y0), ["cx", "cy", *keys], "ignition_year", METRICS, **fit)
    label = lambda m: F.when(F.col("n") >= min_labelled, T.trend_label(f"{m}_trend", f"{m}_p"))
    return t.withColumns({f"{m}_class": label(m) for m in METRICS})


def land_cell_trends(
    points: DataFrame, polys: DataFrame, key: str, box: tuple[float, float, float, float], size: float, min_labelled: int = 20, **fit,
) -> DataFrame:
    """Every grid cell with land and the trends of the events on it; a cell without events has ``n`` 0 and no trend."""
    x0, y0 = box[:2]
    grid = land_cells(points.sparkSession, polys, key, box, size)
    trends = cell_trends(land_points(points, grid, polys, key, size, x0, y0), size, x0, y0, min_labelled=min_labelled, **fit)
    return join_keys(grid, trends, ["cx", "cy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def zone_trends(points: DataFrame, zones: DataFrame, key: str, min_duration: int = 5, **fit) -> DataFrame:
    """Trends per region over events longer than ``min_duration`` days; regions without enough are kept."""
    hit = S.point_in_polygon(points.where(F.col("duration") > min_duration), zones, key)
    t = T.metric_trends(hit, [key], "ignition_year", METRICS, **fit)
    every = join_keys(zones.select(key), t, [key], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.withColumns({f"{m}_class": T.trend_label(f"{m}_trend", f"{m}_p", "Insufficient data") for m in METRICS})


def event_modes(daily: DataFrame) -> DataFrame:
    """One row per event from its daily rows, each attribute by its most frequent value."""
    d = daily.withColumn("year", C.number_or_null(F.substring("date", 1, 4), "int"))
    return G.group_mode(d, ["id"], ["duration", "year", "l1_ecoregion", "lc_name"], "event_day")


def yearly_duration(events: DataFrame, group: str) -> DataFrame:
    return events.groupBy("year", group).agg(F.avg("duration").alias("duration_mean"), F.stddev_samp("duration").alias("duration_sd"))


def yearly_event_duration(daily: DataFrame, group: str, dropped: Sequence[str] = ()) -> DataFrame:
    """From daily rows to the yearly mean and spread of durations: event modes first, then groups without the ``dropped`` ones.

    An event whose mode of ``group``, year or duration is missing takes no part.
    """
    events = event_modes(daily).where(F.col(group).isNotNull() & F.col("year").isNotNull() & F.col("duration").isNotNull())
    return cut_lineage(yearly_duration(events.where(C.all_different(group, dropped)) if dropped else events, group))  # read twice


def duration_lines(yearly: DataFrame, group: str) -> DataFrame:
    """Yearly means beside the line through them (median of pairwise slopes) and their distance from it."""
    fit = T.theil_sen(yearly, [group], "year", "duration_mean")
    return M.predict(yearly, fit, [group], "year", "fitted").withColumn("resid", F.col("duration_mean") - F.col("fitted"))


def season_density(events: DataFrame, by: str, last_year: int | None = None) -> DataFrame:
    """Density of ignition days per region and ``by`` (a decade or a year), without a last, incomplete year."""
    kept = events.where(F.col("l1_ecoregion").isNotNull())
    if last_year is not None:
        kept = kept.where(F.col("ignition_year") != last_year)
    return G.density(kept, ["l1_ecoregion", by], "ignition_doy")


def duration_trend_table(yearly: DataFrame, group: str) -> DataFrame:
    """Slope of the yearly mean with its p-value, and the smallest and largest yearly mean."""
    t = T.theil_sen(yearly, [group], "year", "duration_mean")
    ends = yearly.groupBy(group).agg(F.min("duration_mean").alias("min_duration"), F.max("duration_mean").alias("max_duration"))
    return join_keys(t, ends, [group], "inner").select(
        group, C.half_even("slope", 3).alias("slope"), C.half_even("p", 5).alias("p"), "min_duration", "max_duration"
    )


def yearly_spread(events: DataFrame) -> DataFrame:
    """Mean spread (acres per day) per level-1 region and year, with the year centred and scaled over all rows."""
    y = events.where(F.col("l1_eco").isNotNull()).groupBy("l1_eco", F.col("ignition_year").alias("year")).agg(
        G.first_by("l1_ecoregion", "fire_id").alias("na_l1name"), G.strict_mean("fsr_acres_per_day").alias("mean_fsr")
    ).select("na_l1name", "year", "mean_fsr").dropna("any")
    return G.z_score(y.withColumn("log_mean_fsr", C.log_or_null("mean_fsr")), "year", "cyear")


def spread_change(series: DataFrame) -> DataFrame:
    """Least-squares and repeated-median change over the period, per region, with the correlation test."""
    fit = M.ols(series, ["na_l1name"], "cyear", "mean_fsr")
    robust = T.repeated_medians(series, ["na_l1name"], "cyear", "mean_fsr")
    change = lambda rows, f, a: rows.groupBy("na_l1name").agg((G.change_over(f, "year") * 100).alias(f"{a}_change_x100"), (C.ratio(G.change_over(f, "year"), F.min_by(f, "year")) * 100).alias(f"{a}_pct_change"))
    a = change(M.augment(series, fit, ["na_l1name"], "cyear"), "fitted", "ols")
    b = change(M.predict(series, robust, ["na_l1name"], "cyear", "fitted"), "fitted", "rm")
    r = M.correlation(series, ["na_l1name"], "cyear", "mean_fsr").select("na_l1name", "r_squared", "p")
    return a.join(b, "na_l1name").join(r, "na_l1name").join(robust.select("na_l1name", F.col("slope").alias("rm_slope")), "na_l1name")


# --- overlays, roads, rasters --------------------------------------------------------------------------

def square_around(df: DataFrame, half: float, x: str = "x", y: str = "y") -> DataFrame:
    c = F.col
    return df.withColumn("geom", S.box_polygon(c(x) - half, c(y) - half, c(x) + half, c(y) + half))


def region_outlines(regions: DataFrame, name: str) -> DataFrame:
    """One polygon row per region name, put together from its parts and without holes, with its area ``area_km2``."""
    return dissolve_polygons(regions, [name]).withColumn("geom", S.remove_holes("geom")).withColumn("area_km2", S.area("geom") / C.M2_PER_KM2)


def region_borders(regions: DataFrame, name: str) -> DataFrame:
    """Area and length of border, holes included, per region name."""
    whole = cut_lineage(dissolve_polygons(regions, [name]))  # read twice
    border = S.edges(whole, name).groupBy(name).agg((F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))) / C.M_PER_KM).alias("border_km"))
    return join_keys(whole.select(name, (S.area("geom") / C.M2_PER_KM2).alias("area_km2")), border, [name], "inner")


def region_means(events: DataFrame, event_key: str, zones: DataFrame, zone_key: str, name: str) -> DataFrame:
    """Mean spread and growth of the events that overlap each region; an event counts in every region it touches."""
    pairs = O.overlay(events.select(event_key, "geom"), event_key, zones, zone_key).select(event_key, zone_key)
    hit = pairs.join(events.drop("geom", name), event_key).join(zones.select(zone_key, name), zone_key)
    return hit.groupBy(name).agg(F.avg("fsr_ha_per_day").alias("avg_fsr"), F.avg("max_growth_ha").alias("avg_max_growth"), F.count(F.lit(1)).alias("n"))


def burned_area(perimeters: DataFrame, zones: DataFrame, zone_key: str, first_year: int = 2001) -> DataFrame:
    """Perimeter by region pieces: discovery date parts, part of the country, and both area measures in hectares."""
    p = perimeters.where(F.col("year") >= first_year).withColumn("__d", C.date_of("year", "startmonth", "startday"))
    p = p.withColumns(C.date_parts("__d", "discovery")).withColumn("__c", S.centroid("geom"))
    lon = S.from_laea(F.col("__c.x"), F.col("__c.y")).getField("lon")
    p = p.withColumns({"mtbs_region": C.east_or_west(lon), "mtbs_ba_ha": F.col("acres") * C.HA_PER_ACRE})
    pieces = O.overlay(p.select("fire_id", "geom"), "fire_id", zones, zone_key)
    keep = ["fire_id", "discovery_date", "discovery_year", "discovery_day", "discovery_month", "discovery_doy", "mtbs_region", "mtbs_ba_ha"]
    return pieces.join(p.select(*keep), "fire_id").withColumn("mtbs_ba_ecoreg_ha", F.col("area") * C.HA_PER_M2).drop("area")


def road_density(roads: DataFrame, size: float, x0: float, y0: float, template: DataFrame) -> DataFrame:
    """Road kilometres on every template cell; all sources are summed in one pass."""
    km = S.line_km_per_cell(roads, size, x0, y0).withColumnRenamed("km", "value")
    return R.mosaic([km], template)


def event_points(stack: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Pixels of a yearly event raster with a dense event id, and each event's area."""
    p = R.drop_below(stack, 1.0).where(F.col("value").isNotNull())
    named = p.withColumn("event", F.concat_ws("_", F.col("value").cast("long"), F.col("year")))
    pix = G.dense_id(named, "event", "fire_id").select("year", "fire_id", "cx", "cy")
    area = pix.groupBy("year", "fire_id").agg(F.count(F.lit(1)).alias("pixel_count")).withColumn(
        "area_km2", F.col("pixel_count") * size * size / C.M2_PER_KM2
    )
    return pix, area


def event_values(pixels: DataFrame, layer: DataFrame, threshold: float = 0.01) -> DataFrame:
    """One value per event from a co-located layer: that of its first pixel by ``cx, cy``."""
    v = R.drop_below(layer, threshold).where(F.col("value").isNotNull())
    j = pixels.join(v.select("year", "cx", "cy", "value"), ["year", "cx", "cy"], "left")
    return G.keep_first(j, ["fire_id"], ["cx", "cy"])


def region_points(points: DataFrame, size: float, x0: float, y0: float, zones: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Event pixels as points with their region (if any) and part of the country."""
    p = points.withColumns({"x": x0 + (F.col("cx") + 0.5) * size, "y": y0 + (F.col("cy") + 0.5) * size})
    j = S.point_in_polygon(p, zones, key, how="left", attributes=attributes)
    return j.withColumn("mtbs_region", C.east_or_west(S.from_laea("x", "y").getField("lon"))).drop("x", "y")
