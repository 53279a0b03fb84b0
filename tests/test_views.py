import datetime

from cinderline.sources import views as V


def test_fires_are_the_same_dealt_over_more_tasks(spark, tmp_path):
    """What made a task's memory grow with the input: joins over the shuffle partitions, however many rows there are."""
    day = datetime.datetime(2001, 5, 4)
    tables = {
        "region": ([(i, f"R{i}") for i in range(5)], "r_regionkey int, r_name string"),
        "nation": ([(i, f"N{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, i % 25) for i in range(30)] + [(None, 1)], "c_custkey long, c_nationkey int"),
        "orders": ([(i, i % 40, 10.0 * i, day, "1-URGENT") for i in range(400)] + [(7, 7, 1.0, day, None), (None, 3, 2.0, None, "5-LOW"), (500, None, 2.0, day, "5-LOW")],
                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i * 7 % 390, float(i)) for i in range(1000)] + [(None, 5.0), (7, None)], "l_orderkey long, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    whole, dealt = V.fires(spark, str(tmp_path)), V.fires(spark, str(tmp_path), 50)
    assert whole.count() > 200 and sorted(map(repr, whole.collect())) == sorted(map(repr, dealt.collect()))
    assert "REPARTITION_BY_NUM" not in _plan(whole) and "hashpartitioning(l_orderkey" in _plan(dealt) and ", 21)" in _plan(dealt)


def _plan(df):
    return df._jdf.queryExecution().toString()
