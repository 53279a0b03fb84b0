import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderline.llm import negatives
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


def brute(rows, every=100, positives=5, most=5):
    part = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = int(np.fmod(label + 1, 10)) if i % 7 == 0 else label
        part.append((i, label, [int(np.clip(np.floor(256 * float(x)), -negatives.LARGEST, negatives.LARGEST)) for x in e]))
    out = []
    for n, (i, label, q) in enumerate(part):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j, own) for k, (j, own, v) in enumerate(part) if k != n and len(v) == len(q)]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted((s, k) for s, k, own in scored if own != label and 80 * -p <= 100 * -s <= 100 * -p)[:most]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_whole_table(spark, sf):
    rows = rows_of(spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select("vec_id", "embedding", "label"))
    got = negatives.op13_hard_negatives(spark, f"/root/testdata/sf{sf}")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(rows_of(got)) == brute(rows)


def odd_vectors():
    rng = random.Random(4)
    vec = lambda d: [rng.choice([0.0, 0.25, -0.5, 0.75, 1.0]) for _ in range(d)]
    rows = [(i * 10, vec(4), rng.choice([0, 1, 2])) for i in range(120)] + [(i * 50, vec(3), i % 2) for i in range(30)]
    rows += [(100, None, 1), (200, vec(4), None), (300, [0.1, None, 0.2, 0.3], 1), (400, [float("nan")] * 4, 1), (500, [float("inf")] * 4, 2), (None, vec(4), 1)]
    rows += [(600, [1e30, -1e30, 0.0, 1.0], 1), (700, [], 1), (800, [], 2), (900, [], 1), rows[10], rows[10], rows[20], (-100, vec(4), -3), (-7, vec(4), -3)]
    return rows


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, label int")
    rows = rows_of(df)
    extra = {c: F.lit("x") for c in ("row", "dim", "part", "kind", "id", "score")}
    df.withColumns(extra).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(rows_of(negatives.op13_hard_negatives(spark, str(tmp_path)))) == brute(rows)


def test_none(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert rows_of(negatives.op13_hard_negatives(spark, str(tmp_path))) == []


def test_small_blocks_and_groups(spark):
    """Many blocks, groups and stripes give what one of each gives; a hot label fills many blocks."""
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (3000, 20))
    label = np.where(rng.random(3000) < 0.4, 1, rng.integers(0, 5, 3000))
    data = [(i, i, int(c), 20, v.tolist()) for i, (c, v) in enumerate(zip(label, x))]
    rows = spark.createDataFrame(data, "row long, id long, label long, dim int, v array<int>")
    want = sorted(rows_of(negatives.hard_negatives(rows, rows.filter("id % 50 = 0"))))
    got = sorted(rows_of(negatives.hard_negatives(rows, rows.filter("id % 50 = 0"), per_group=9)))
    score = x @ x.T
    assert got == want
    for a, p, rank, n, ps, ns in want[:200]:
        assert score[a, p] == ps and score[a, n] == ns and 80 * ps <= 100 * ns <= 100 * ps and label[a] == label[p] != label[n]


def test_scan_drops_no_row():
    """Bounds between steps leave every row whose score is in the window."""
    rng = np.random.default_rng(1)
    cells = rng.integers(-128, 128, (64, 500)).astype(np.int32)
    ids = np.stack([np.arange(500), np.arange(500)])
    block = negatives.Block({
        "label": 1, "n": 500, "ids": ids.astype(np.int64).tobytes(), "low": cells.min(axis=1).tobytes(), "high": cells.max(axis=1).tobytes(), "cells": cells.tobytes(), "dim": 64,
    })
    q = rng.integers(-128, 128, 64)
    whole = q @ cells
    left = []
    rows, score = block.scan(q, lambda low, high: left.append(len(low)) or ((high >= 100_000) & (low <= 150_000)))
    assert sorted(rows.tolist()) == np.flatnonzero((whole >= 100_000) & (whole <= 150_000)).tolist()
    assert (score == whole[rows]).all() and left[-1] < left[0]


def test_blocks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(negatives, "_BLOCK", 7)
    rows = [(i, 10 * i, i // 40, 2, [i, -i]) for i in range(100)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(["row", "id", "label", "dim", "v"], r)) for r in rows[a : a + 33]]) for a in range(0, 100, 33)]
    blocks = [negatives.Block(b) for t in negatives._to_blocks(batches) for b in t.to_pylist()]
    got = [(int(r), int(i), b.label, 2, b.cells[:, k].tolist()) for b in blocks for k, (i, r) in enumerate(zip(b.ids, b.rows))]
    assert got == rows and max(b.n for b in blocks) == 7
