import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cinderline.llm import repeats
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


def brute(texts, size):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - size + 1):
            if times[d[i : i + size]] > 1:
                gone[i : i + size] = True
        gone = gone[: len(d)]
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), int(gone.sum()), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def test_whole_table(spark):
    docs = rows_of(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = [(d, n, r, s, hashlib.sha256(k).hexdigest()) for (d, _), (n, r, s, k) in zip(docs, brute([t for _, t in docs], 400))]
    assert sorted(rows_of(repeats.op2_repeats(spark, SF))) == sorted(want)


@pytest.mark.parametrize("seed", range(6))
def test_planted(spark, seed):
    """Copied passages of all lengths, at text ends, overlapping, nested and periodic, against brute force."""
    rng = random.Random(seed)
    size, q = rng.choice([(40, 10), (25, 10), (17, 16), (33, 7)])
    word = lambda n: "".join(rng.choice("abé" if seed % 2 else "abcdefghij ") for _ in range(n))
    passages = [word(rng.randrange(size // 2, 4 * size)) for _ in range(8)]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1)))
            t += rng.choice([word(rng.randrange(0, 2 * size)), p, p[a:b], p[a:], p[:b], "ab" * rng.randrange(size), word(3) * rng.randrange(1, size)])
        texts.append(t)
    texts += [None, "", texts[0], texts[1] + "x", "z" * (size - 1), "z" * size, "y" * (size + 1), word(5 * size) * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, size, q).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, size)


def test_odd_rows(spark, odd, none):
    rows = rows_of(odd.select("doc_id", "text"))
    want = Counter((d, *w) for (d, _), w in zip(rows, brute([t if t is None or len(t) < 10_000 else t[:0] for _, t in rows], 400)) if (w[0] or True))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(odd).collect())
    longs = [r for r in rows if r[1] and len(r[1]) >= 10_000]
    assert {k: v for k, v in got.items() if k[0] not in {d for d, _ in longs}} == {k: v for k, v in want.items() if k[0] not in {d for d, _ in longs}}
    assert all(k[2] == k[1] for k in got if k[0] in {d for d, _ in longs})
    assert rows_of(repeats.remove_repeats(none)) == []
