from datetime import date

import pytest
from pyspark.sql import functions as F

from cinderline.functions import columns as C
from cinderline.functions import tails


def one(spark, value, expr, kind="double"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"v {kind}").select(expr).collect()]


def test_ladders_at_every_break(spark):
    v = [None, 0.0, 14.999, 15.0, 39.9, 40.0, 100.0, 399.9, 400.0]
    assert one(spark, v, C.classify_spread("v")) == [None, "< 15", "< 15", "15 - 40", "15 - 40", "40 - 100", "100 - 400", "100 - 400", "> 400"]
    assert one(spark, [0.0, 1.0, 25.0, 25.5, 100.0, 500.0], C.classify_frequency("v")) == [None, "1 - 25", "1 - 25", "25 - 100", "100 - 250", "> 500"]


def test_cut_is_right_closed(spark):
    v = [None, 0.0, 0.1, 5.0, 5.1, 1e8, 1e8 + 1]
    assert one(spark, v, C.cut("v", C.HOMES_PER_ROAD_BREAKS, C.HOMES_PER_ROAD_LABELS)) == [None, None, "0-5", "0-5", "5-10", "100+", None]


def test_interval_index_closes_the_last(spark):
    assert one(spark, [-1.0, 0.0, 10.0, 100000.0, 100001.0], C.interval_index("v", C.HOMES_INTERVALS)) == [None, 1, 2, 7, None]


def test_title_case(spark):
    v = ["ARIZONA/NEW MEXICO MOUNTAINS", "SOUTHERN SEMI-ARID HIGHLANDS", "GILA (UPPER) RANGE", None]
    assert one(spark, v, C.title_case("v"), "string") == ["Arizona/New Mexico Mountains", "Southern Semi-Arid Highlands", "Gila (Upper) Range", None]


def test_dates(spark):
    df = spark.createDataFrame([(2001, 2, 31), (2004, 2, 29), (2004, 12, 31)], "y int, m int, d int")
    rows = df.select(C.date_of("y", "m", "d").alias("dt")).withColumn("doy", F.dayofyear("dt")).collect()
    assert [(r.dt, r.doy) for r in rows] == [(None, None), (date(2004, 2, 29), 60), (date(2004, 12, 31), 366)]


def test_missing_value_rules(spark):
    assert one(spark, [2.5, 3.5, -0.5], C.half_even("v")) == [2.0, 4.0, 0.0]
    assert one(spark, [0.0, 4.0], C.ratio(F.lit(8.0), "v")) == [None, 2.0]
    assert one(spark, [0.0, -1.0, 1.0], C.log_or_null("v")) == [None, None, 0.0]
    assert one(spark, ["HI", "CO", None], C.not_in("v", ["HI", "AK"]), "string") == [False, True, True]
    assert one(spark, ["a", "z", None], C.recode("v", {"a": "b"}), "string") == ["b", "z", None]
    assert one(spark, ["12", "x"], C.number_or_null("v"), "string") == [12.0, None]


@pytest.mark.parametrize("got, want", [
    (tails.student_two_sided(2.0, 10), 0.07338803),
    (tails.f_upper(3.5, 2, 20), 0.0497),
    (tails.chi2_upper(3.841459, 1), 0.05),
    (tails.chi2_upper(20.0, 3), 0.0001697424),
    (tails.normal_two_sided(1.959964), 0.05),
    (tails.signed_rank_two_sided(15, 5), 0.0625),
    (tails.signed_rank_two_sided(8, 10), 0.048828125),
])
def test_tails(got, want):
    assert got == pytest.approx(want, rel=1e-3)
