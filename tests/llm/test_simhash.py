import random
import re

import numpy as np
import pytest
import xxhash

from cinderline.llm import graph, simhash
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


def brute_print(text):
    t = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints, most=2):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def expected(rows):
    prints = [brute_print(t) for _, t in rows]
    groups = brute_groups(prints)
    least = {}
    for (d, _), g in zip(rows, groups):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [(d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, groups)]


def test_groups_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected(rows_of(docs.select("doc_id", "text")))
    assert sorted(rows_of(simhash.op7_simhash(spark, SF))) == sorted(want)


def test_odd_rows(spark, odd, none):
    want = expected(rows_of(odd.select("doc_id", "text")))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows_of(simhash.simhash_groups(odd)), key=key) == sorted(want, key=key)
    assert rows_of(simhash.simhash_groups(none)) == []


def test_one_row_stays(spark, odd):
    rows = expected(rows_of(odd.select("doc_id", "text")))
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [(r.doc_id is None, r.doc_id) for r in kept.collect()]
    assert sorted(ids) == sorted({(g is None, g) for _, _, g in rows})


def near_prints(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = set(base)
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.5 else (base[0] >> 40 << 40 | rng.getrandbits(40))
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("most", [0, 1, 2, 4])
@pytest.mark.parametrize("width", [8, 1 << 18])
def test_trie_join(most, width):
    a = np.array(near_prints(150, most), np.uint64)
    i, j = simhash.join_tries(a, None, 0, 0, most, width)
    up = dict(zip(i.tolist(), j.tolist()))
    assert [up.get(k, k) for k in range(len(a))] == brute_groups(a.tolist(), most)
    left, right = a[a >> np.uint64(63) == 0], a[a >> np.uint64(63) == 1]
    i, j = simhash.join_tries(left, right, 1, 1, most, width)
    both = np.concatenate([left, right]).tolist()
    up = list(range(len(both)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for x in range(len(left)):
        for y in range(len(left), len(both)):
            if (both[x] ^ both[y]).bit_count() <= most:
                up[max(root(x), root(y))] = min(root(x), root(y))
    got = dict(zip(i.tolist(), j.tolist()))
    assert [got.get(k, k) for k in range(len(both))] == [root(k) for k in range(len(both))]


@pytest.mark.parametrize("leaf", [2, 16, 4096])
def test_walk_of_the_upper_trie(spark, leaf):
    prints = near_prints(300, 9)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.fingerprint_components(df, 2, leaf).collect()}
    assert [got[f] for f in signed] == brute_groups(prints)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(40)] + [(500, 500), (None, 3), (900, 901), (901, 900)]
    rng.shuffle(links)
    got = dict(rows_of(graph.components(spark.createDataFrame(links, "a long, b long"))))
    want = {i: 0 for i in range(61)} | {i: 100 for i in [100, *range(200, 240)]} | {900: 900, 901: 900}
    assert got == want
    assert rows_of(graph.components(spark.createDataFrame([], "a long, b long"))) == []
