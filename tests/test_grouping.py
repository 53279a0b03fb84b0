import pytest
from pyspark.sql import functions as F

from cinderline.operators import grouping as G


def test_nest_deals_a_large_group_over_blocks(spark):
    rows = [("hot", 7, "x")] * 3000 + [("hot", i, None) for i in range(1000)] + [("cold", 1, "y"), (None, 2, "z"), (None, 2, "z")]
    df = spark.createDataFrame(rows, "k string, a int, b string").repartition(5)
    nested = G.nest(df, ["k"], block_bytes=4000)
    sizes = nested.select("k", "data_block", F.size("data").alias("n")).collect()
    hot = [r.n for r in sizes if r.k == "hot"]
    assert len(hot) > 10 and sum(hot) == 4000 and max(hot) < 3 * 4000 / len(hot)
    assert sorted((str(r.k), r.data_block, r.n) for r in sizes if r.k != "hot") == [("None", 0, 2), ("cold", 0, 1)]
    back = G.unnest(nested)
    assert back.columns == df.columns and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_nest_of_small_groups_and_of_none(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    got = {r.k: sorted((x.v or "") for x in r.data) for r in G.nest(df, ["k"]).collect()}
    assert got == {1: ["a", "b"], 2: [""]}
    assert G.nest(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("head", ["", "a common beginning of twenty bytes and more "])
def test_ordinals_spread_keys_that_begin_alike(spark, head):
    keys = [f"{head}{i:06d}" for i in range(5000)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string").repartition(4)
    got = {r.k: r.id for r in G.dense_id(df, "k", "id").collect()}
    assert got == {None: None, **{k: i + 1 for i, k in enumerate(keys)}}
    placed = df.dropna().repartitionByRange(8, "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(placed) == 8


def test_row_numbers_follow_every_column_of_the_order(spark):
    df = spark.createDataFrame([(1, i, j) for i in range(40) for j in range(40)] + [(None, 1, 1)], "a int, b int, c int").repartition(6)
    got = sorted((r.id, r.a or 0, r.b, r.c) for r in G.row_ordinal(df, ["a", "b", "c"], "id").collect())
    assert [r[0] for r in got] == list(range(1, 1602)) and got[0][1:] == (0, 1, 1)
    assert [r[1:] for r in got[1:]] == sorted(r[1:] for r in got[1:])
    assert G.row_ordinal(df.limit(0), ["a"], "id").count() == 0


@pytest.mark.parametrize("most", [10**6, 30, 41])
@pytest.mark.parametrize("order", ["o", None])
def test_modes_of_large_and_small_groups(spark, most, order, monkeypatch):
    monkeypatch.setattr(G, "MODE_ROWS", most)  # groups of more rows are counted by value first
    rows = [(k % 7 if k % 11 else None, "abc"[k * k % 3] if k % 5 else None, float(k % 4), k) for k in range(300)]
    want = {}
    for g in {r[0] for r in rows}:
        for j in (1, 2):
            seen = {}
            for r in rows:
                if r[0] == g:
                    seen.setdefault(r[j], []).append(r[3])
            first = min(seen.items(), key=lambda x: (-len(x[1]), min(x[1]) if order else 0, x[0] is None, x[0]))
            want.setdefault(g, []).append(first[0])
    df = spark.createDataFrame(rows, "g int, a string, b double, o int")
    assert {r.g: [r.a, r.b] for r in G.group_mode(df, ["g"], ["a", "b"], order).collect()} == want
