from cinderline.plans import studies as P
from cinderline.plans import tables as PT


def test_seasons_leave_four_classes_out(spark):
    classes = ["Barren", "Water Bodies", "Permanent Wetlands", "Permanent Snow and Ice", "Grasslands"]
    df = spark.createDataFrame([(c, "Great Plains", 2001, m) for c in classes for m in (3, 5)], "lc_name string, l1_ecoregion string, ignition_year int, ignition_month int")
    df = df.selectExpr("*", "make_date(ignition_year, ignition_month, 1) as ignition_date", "1.0D as max_growth_ha", "2.0D as fsr_ha_per_day")
    assert [(r.lc_name, r.n) for r in PT.season_stats(df, ["ignition_year", "lc_name"]).collect()] == [("Grasslands", 2)]


def test_durations_come_from_event_modes(spark):
    days = [
        (1, "2001-12-30", 1, 4, "A", "x"), (1, "2001-12-31", 2, 4, "A", "x"), (1, "2002-01-01", 3, 9, "A", "y"),
        (2, "2001-05-01", 1, 6, "A", "y"), (3, "2003-05-01", 1, 11, "A", "x"), (4, "2003-05-01", 1, 7, None, None), (5, "none", 1, 7, "A", "x"),
    ]
    df = spark.createDataFrame(days, "id int, date string, event_day int, duration int, l1_ecoregion string, lc_name string")
    got = P.yearly_event_duration(df, "l1_ecoregion").orderBy("year").collect()
    assert [(r.year, r.duration_mean) for r in got] == [(2001, 5.0), (2003, 11.0)]
    assert [(r.year, r.duration_mean) for r in P.yearly_event_duration(df, "lc_name", ("y",)).orderBy("year").collect()] == [(2001, 4.0), (2003, 11.0)]
    lines = {r.year: (r.fitted, r.resid) for r in P.duration_lines(P.yearly_event_duration(df, "l1_ecoregion"), "l1_ecoregion").collect()}
    assert lines == {2001: (5.0, 0.0), 2003: (11.0, 0.0)}


def test_density_without_the_last_year(spark):
    df = spark.createDataFrame([("A", y, float(d)) for y in (2001, 2002) for d in (1, 5, 9)] + [(None, 2001, 3.0)], "l1_ecoregion string, ignition_year int, ignition_doy double")
    assert {r.ignition_year for r in P.season_density(df, "ignition_year", 2002).collect()} == {2001}


def test_land_cells_without_events_are_kept(spark):
    ring = [(0.0, 0.0), (25.0, 0.0), (25.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    land = spark.createDataFrame([(1, [[[{"x": x, "y": y} for x, y in ring]]])], "zone int, geom array<array<array<struct<x: double, y: double>>>>")
    rows = [(5.0, 5.0, 2000 + i, float(i), 2.0 * i, 3) for i in range(12)] + [(28.0, 5.0, 2000, 1.0, 1.0, 1)]
    points = spark.createDataFrame(rows, "x double, y double, ignition_year int, fsr_ha_per_day double, max_growth_ha double, duration int")
    got = {(r.cx, r.cy): r for r in P.land_cell_trends(points, land, "zone", (0.0, 0.0, 40.0, 20.0), 10.0, min_labelled=12).collect()}
    assert {k: r.n for k, r in got.items()} == {(0, 0): 12, (1, 0): 0, (2, 0): 0}
    assert (got[0, 0].mean_fsr_trend, got[0, 0].max_growth_trend, got[0, 0].mean_fsr_class) == (1.0, 2.0, "Positive")
    assert got[1, 0].mean_fsr_trend is None and got[2, 0].land_km2 == 50 / 1e6
