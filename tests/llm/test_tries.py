import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cinderline.llm import tries
from tests.llm.conftest import rows_of

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(sequences):
    """By brute force: every prefix of every sequence is a node."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += not children[node]
        saved[node] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(sequences[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return trie_of({c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()})


def same(got, want):
    assert got.columns == COLUMNS
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows_of(got), key=key) == sorted(want, key=key)


def test_whole_table(spark):
    rows = rows_of(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text"))
    same(tries.op11_conversation_trie(spark, "/root/testdata/sf0.01"), brute(rows))


def odd_conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 160), *range(305, 320)]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 20])):
            rows.append((c, rng.choice([t, t, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é" * 3, None, ""])))
    rows += [(400 + i, 0, "user", "the same") for i in range(40)] + [(450 + i, t, "user", "x") for i in range(3) for t in range(70)]
    rows += [(None, 0, "user", "no id"), (None, None, None, None), rows[0], rows[0], rows[5], (777, 0, "user", "word " * 50_000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_odd_rows(spark, tmp_path):
    rows = odd_conversations()
    extra = {c: F.lit("x") for c in ("c", "d", "len", "range", "pos", "id", "depth", "row")}
    spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    same(tries.op11_conversation_trie(spark, str(tmp_path)), brute(rows))


def test_none(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(tries.op11_conversation_trie(spark, str(tmp_path))) == []


def test_deep_and_branching(spark):
    """Sequences over two turns: every depth branches, some end inside others, many end at one node."""
    rng = random.Random(5)
    sequences = {c: [("u", rng.choice("ab")) for _ in range(rng.randrange(14))] for c in range(150)}
    sequences |= {200 + i: [("u", "a")] * n for i, n in enumerate([0, 1, 2, 3, 4, 7, 8, 9, 31, 32, 33, 33, 33])}
    turns = spark.createDataFrame([(c, d, r, t) for c, v in sequences.items() for d, (r, t) in enumerate(v, 1)], "conv_id long, depth long, role string, text string")
    turns = turns.select("conv_id", "depth", F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", "role").alias("t2"), F.length("text").cast("long").alias("chars"))
    convs = spark.createDataFrame([(c, len(v)) for c, v in sequences.items()], "conv_id long, len long")
    same(tries.conversation_trie(convs, turns), trie_of(sequences))


@pytest.mark.parametrize("a, b, want", [(0, 1, 1), (0, 7, 4), (4, 7, 6), (6, 7, 7), (5, 100, 64), (64, 100, 96)])
def test_two_fattest(spark, a, b, want):
    assert spark.range(1).select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")).select(tries._fattest("a", "b")).first()[0] == want


def test_running_over_ranges(spark):
    rows = [(k, i, 1) for k in range(3) for i in range(1000 if k == 1 else 5)]
    df = spark.createDataFrame(rows, "key long, at long, v long").repartition(4)
    got = {(r["key"], r["at"]): r["total"] for r in tries.running(df, "key", [F.col("at")], {"total": F.col("v")}, "test").collect()}
    assert got == {(k, i): i + 1 for k, i, _ in rows}


def test_hash_of_many_ids(spark):
    ids = list(range(120_000))
    df = spark.range(120_000).select(F.lit(7).cast("long").alias("id"), F.col("id").alias("conv_id"), F.lit(True).alias("many"))
    df = df.unionByName(spark.createDataFrame([(8, 5, False), (9, 6, True), (9, 4, True)], "id long, conv_id long, many boolean"))
    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert dict(rows_of(tries._id_hashes(df))) == {7: sha(ids), 8: sha([5]), 9: sha([4, 6])}
