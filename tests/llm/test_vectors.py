import math

import numpy as np
import pytest

from cinderline.llm import vectors
from tests.llm.conftest import rows_of


def brute(rows, at_least=0.95):
    n = len(rows)
    x = [None if v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v) or not any(v) else np.array(v, float) for _, v in rows]
    up, links = list(range(n)), [0] * n

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(n):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]):
                if x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= at_least:
                    links[i] += 1
                    links[j] += 1
                    up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, links[i], least.get(root(i)) if x[i] is not None else d, d is not None and (d == least.get(root(i)) if x[i] is not None else True)) for i, (d, _) in enumerate(rows)]


def near(rng, n, dim, noise):
    base = rng.normal(size=(max(1, n // 6), dim))
    return base[rng.integers(0, len(base), n)] + noise * rng.normal(size=(n, dim)) * rng.random((n, 1))


@pytest.mark.parametrize("dim,block,target", [(64, 4096, 1024), (64, 16, 20), (3, 4096, 50), (100, 30, 60)])
def test_links(spark, dim, block, target, monkeypatch):
    rng = np.random.default_rng(dim + block)
    monkeypatch.setattr(vectors, "_BLOCK", block)
    monkeypatch.setattr(vectors, "plan", lambda n, a, f=vectors.plan: f(n, a, target))
    rows = [(i, v.tolist()) for i, v in enumerate(near(rng, 300, dim, 0.4))]
    rows += [(900 + i, rows[0][1]) for i in range(30)] + [(None, rows[1][1]), (1000, [2 * c for c in rows[2][1]]), (5, rows[3][1]), (5, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = rows_of(vectors.near_vectors(df)), brute(rows)
    wrong = len(set(got) ^ set(want))
    assert len(got) == len(want) and wrong <= 2  # pairs right at the threshold are found with chance 0.9999


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]),
            (9, [1.0]), (None, [1.0, 1.0]), (None, None), (10, [-1.0, -1.0]), (11, [1e-200, 1e-200]), (12, [1e200, 1e200]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "'x' as c", "2 as first")
    key = lambda r: tuple(str(x) for x in r)
    scaled = [(d, [c / max(map(abs, v)) for c in v] if v and all(c is not None and math.isfinite(c) for c in v) and any(v) else v) for d, v in rows]
    assert sorted(rows_of(vectors.near_vectors(df)), key=key) == sorted(brute(scaled), key=key)
    assert rows_of(vectors.near_vectors(df.limit(0))) == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    exact, errors, beyond = x @ x.T, [], 0
    for seed in range(5):
        c = vectors.Codes(x, vectors.rotation(64, seed))
        bound, estimate = (c.upper(slice(None), c, slice(None), s) for s in (vectors._SIGMAS, 0.0))
        off = ~np.eye(len(x), dtype=bool)
        errors.append((estimate - exact)[off].mean())
        beyond += (bound < exact)[off].sum()
    assert abs(np.mean(errors)) < 0.005 and beyond < 5


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = rows_of(spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding"))
    assert sorted(rows_of(vectors.op4_near_vectors(spark, sf))) == sorted(brute(rows))
