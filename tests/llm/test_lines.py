import random
import re

import numpy as np
import pytest

from cinderline.llm import lines
from tests.llm.conftest import DOCS, rows_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """``(doc_id, line): (size, links, kept)`` by comparing all distinct word sets."""
    all_ = [((d is None, d or 0), i, frozenset(WORDS.findall(x))) for d, t in rows if t is not None for i, x in enumerate(t.split("\n"))]
    all_ = [x for x in all_ if x[2]]
    first = {}
    for d, i, s in sorted(all_, key=lambda x: x[:2]):
        first.setdefault(s, (d, i))
    sets = list(first)
    near = {s: [o for o in sets if o is not s and 5 * len(s & o) >= 4 * len(s | o)] for s in sets}
    out = {}
    for d, i, s in all_:
        best = min([first[s], *(first[o] for o in near[s])])
        out[None if d[0] else d[1], i] = (len(s), len(near[s]), best == (d, i), None if first[s][0][0] else first[s][0][1], first[s][1])
    return out


def check(spark, docs):
    rows = rows_of(docs.select("doc_id", "text"))
    want = brute(rows)
    got = lines.judged_lines(docs).collect()
    assert {(r.doc_id, r.line): (r.size, r.n_links, r.kept, r.class_doc, r.class_line) for r in got} == want
    return rows, want


@pytest.mark.parametrize("seed", range(3))
def test_similar_lines(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(800)]
    pool = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 15, 30, 80]))] for _ in range(60)]
    docs = []
    for d in range(120):
        out = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                if line and rng.random() < 0.5:
                    line.pop(rng.randrange(len(line)))
                else:
                    line.insert(rng.randrange(len(line) + 1), rng.choice(vocabulary))
            rng.shuffle(line)
            out.append(rng.choice([" ", "\t", "  "]).join(line))
        docs.append((d, rng.choice(["\n", "\n\n"]).join(out)))
    check(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3))


def test_whole_table(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_rows(spark, odd, none):
    docs = odd.filter("doc_id is not null or text is null")
    check(spark, docs)
    assert lines.judged_lines(none).count() == 0
    assert lines.drop_similar_lines(none).count() == 0


def test_texts_without_later_lines(spark, odd):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id", "text"])
    rows = rows_of(docs.select("doc_id", "text"))
    judged = brute(rows)
    out = lines.drop_similar_lines(docs)
    assert out.columns == docs.columns
    want = {}
    for d, t in rows:
        if t is None or not any(k[0] == d and not v[2] for k, v in judged.items()):
            want[d] = t
            continue
        t = "\n".join(x for i, x in enumerate(t.split("\n")) if judged.get((d, i), (0, 0, True))[2])
        if WORDS.search(t):
            want[d] = t
    got = {r.doc_id: r for r in out.collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if r.n_chars is not None and r.text is not None)


@pytest.mark.parametrize("group", [4096, 30])
def test_large_group_of_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(lines, "_GROUP", group)
    rng = random.Random(group)
    base = [f"b{k}" for k in range(30)]
    docs = []
    for d in range(180):
        own = [w for w in base if rng.random() > 0.08] + [f"x{rng.randrange(40)}" for _ in range(rng.randrange(3))]
        docs.append((d, " ".join(own) + "\nfour words in common" + (f"\nfour words in common {d}" if d % 3 else "")))
    check(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5))


@pytest.mark.parametrize("cells", [50, 2000, 16_000_000])
def test_common_words_of_a_large_group(monkeypatch, cells):
    monkeypatch.setattr(lines, "_CELLS", cells)
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([[40], rng.integers(0, 300, 12), rng.integers(38, 44, 2)])) for _ in range(90)]
    got = list(lines._common_of_many(np.concatenate(sets), np.array([len(s) for s in sets]), 40))
    a, b, common, here = (np.concatenate(x) for x in zip(*got))
    want = {(i, j): (len(set(sets[i]) & set(sets[j])), min(set(sets[i]) & set(sets[j])) >= 40) for i in range(90) for j in range(i + 1, 90)}
    assert dict(zip(zip(a.tolist(), b.tolist()), zip(common.tolist(), here.tolist()))) == want
