import pytest
from pyspark.sql import functions as F

from cinderline.operators import spatial as S
from cinderline.operators.overlay import overlay
from cinderline.sources import schemas


def poly(*rings):
    return [[[(float(x), float(y)) for x, y in [*r, r[0]]] for r in rings]]


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLE = [(4, 4), (4, 6), (6, 6), (6, 4)]
RIGHT = [(10, 0), (20, 0), (20, 10), (10, 10)]


def frame(spark, **polys):
    geom = schemas.POLYGON.simpleString()
    return spark.createDataFrame([(k, v) for k, v in polys.items()], f"k string, geom {geom}")


@pytest.fixture(scope="module")
def polys(spark):
    return frame(spark, a=poly(SQUARE, HOLE), b=poly(RIGHT), t=poly([(0, 20), (9, 20), (0, 29)]))


@pytest.mark.parametrize("strip", [1.0, 3.0, 100.0])
def test_points_on_borders_belong_to_one_side(spark, polys, strip):
    pts = [(10, 5, "b"), (0, 5, "a"), (5, 0, "a"), (5, 10, None), (20, 5, None), (4, 5, None), (6, 5, "a"), (5, 5, None), (5, 4, None), (5, 6, "a"), (1, 21, "t"), (10, 0, "b")]
    df = spark.createDataFrame([(float(x), float(y), w) for x, y, w in pts], "x double, y double, want string")
    got = S.point_in_polygon(df, polys, "k", strip, how="left").collect()
    assert len(got) == len(pts) and all(r.k == r.want for r in got)


def test_measures(spark, polys):
    r = {x.k: x for x in polys.select("k", S.area("geom").alias("a"), S.centroid("geom").alias("c"), S.area("transform(geom, p -> slice(p, 1, 1))").alias("f")).collect()}
    assert (r["a"].a, r["a"].f, r["t"].a) == pytest.approx((96, 100, 40.5))
    assert (r["a"].c.x, r["b"].c.x, r["t"].c.y) == pytest.approx((5, 15, 23))


@pytest.mark.parametrize("size, tol", [(1.0, 6.0), (0.25, 1.5), (0.0625, 0.4)])
def test_cover_area_approaches_the_polygon(spark, polys, size, tol):
    n = {r.k: r["count"] * size * size for r in S.cover(polys, "k", size).groupBy("k").count().collect()}
    assert n["a"] == pytest.approx(96) and n["t"] == pytest.approx(40.5, abs=tol)


def test_cover_of_a_tiny_polygon_is_empty(spark):
    assert S.cover(frame(spark, x=poly([(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)])), "k", 1.0).count() == 0


def test_lines_on_a_grid(spark):
    segs = [(1, 0.0, 0.0, 3.0, 0.0), (2, 0.0, 0.0, 3.0, 3.0), (3, 0.2, 0.2, 0.4, 0.6), (4, 1.0, 1.0, 1.0, 1.0), (5, -1.5, 2.5, 2.5, -1.2)]
    df = spark.createDataFrame(segs, "id int, x1 double, y1 double, x2 double, y2 double")
    got = S.split_on_grid(df, 1.0).collect()
    for i, x1, y1, x2, y2 in segs:
        mine = [r for r in got if r.id == i]
        assert sum(r.piece_m for r in mine) == pytest.approx(((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5)
    assert {(r.cx, r.cy) for r in got if r.id == 2} == {(0, 0), (1, 1), (2, 2)}
    assert {(r.cx, r.cy) for r in got if r.id == 1} == {(0, 0), (1, 0), (2, 0)}


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-100.0, 45.0), (-124.5, 32.1), (-70.0, 47.0)], "lon double, lat double")
    r = df.withColumn("p", S.to_laea("lon", "lat")).withColumn("q", S.from_laea(F.col("p.x"), F.col("p.y"))).collect()
    assert all((x.q.lon, x.q.lat) == pytest.approx((x.lon, x.lat), abs=1e-9) for x in r)
    assert (r[0].p.x, r[0].p.y) == pytest.approx((0.0, 0.0), abs=1e-6)


def test_no_cartesian_plans(spark, polys):
    pts = spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    segs = pts.select(F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 3).alias("x2"), F.col("y").alias("y2"))
    for df in (S.point_in_polygon(pts, polys, "k", how="left"), overlay(polys, "k", polys.withColumnRenamed("k", "j"), "j", 1.0), S.line_km_per_cell(segs, 2.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
