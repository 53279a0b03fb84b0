import numpy as np
import pytest

from cinderline.operators import grouping as G
from cinderline.operators import ranks as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    hot = [("hot", float(v)) for v in rng.lognormal(2, 2, 9000)]
    tied = [("tied", float(v)) for v in rng.integers(0, 3, 4000)]
    rest = [("one", 5.0), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, 9.0), (None, None), ("none", None)]
    return hot + tied + rest


@pytest.mark.parametrize("whole", [20000, 100])
def test_quantiles_match_numpy(spark, rows, whole, monkeypatch):
    monkeypatch.setattr(R, "WHOLE", whole)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r for r in R.multi_quantiles(df, ["k"], {"q1": ("v", 0.25), "q2": ("v", 0.5), "q9": ("v", 0.9)}).collect()}
    for k in {k for k, _ in rows}:
        v = [x for g, x in rows if g == k and x is not None]
        if v:
            assert (got[k].q1, got[k].q2, got[k].q9) == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.9])), rel=1e-12)
        else:
            assert k not in got or got[k].q2 is None


def test_cumulative_counts(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = R.cumulative_counts(R.value_counts(df, ["k"], "v"), ["k"]).collect()
    for k in ("hot", "tied"):
        v = np.sort([x for g, x in rows if g == k])
        for r in [r for r in got if r.k == k]:
            assert r.cum == np.searchsorted(v, r.value, "right")


def test_mode_first_seen_and_null(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (2, 1, None), (2, 2, None), (2, 3, "x")], "g int, o int, v string")
    assert {r.g: r.v for r in G.group_mode(df, ["g"], ["v"], "o").collect()} == {1: "b", 2: None}
    assert {r.g: r.v for r in G.group_mode(df, ["g"], ["v"]).collect()} == {1: "a", 2: None}


def test_ordinals_without_a_global_window(spark):
    df = spark.createDataFrame([(f"id_{i % 97:03d}",) for i in range(1000)], "k string")
    assert {(r.k, r.n) for r in G.dense_id(df, "k", "n").collect()} == {(f"id_{i:03d}", i + 1) for i in range(97)}


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(0, 1, 500)], "k string, v double")
    d = sorted((r.x, r.density) for r in G.density(df, ["k"], "v", points=200).collect())
    x, y = np.array(d).T
    assert np.trapezoid(y, x) == pytest.approx(1.0, abs=0.01)


def test_histogram_single_value(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 0.0), ("b", 3.0)], "k string, v double")
    assert {(r.k, r.bin, r.n) for r in G.histogram(df, ["k"], "v", 3).collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 3, 1)}
