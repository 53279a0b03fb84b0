import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cinderline.llm import mixing, packing
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = sum(w[s] for s in names if s not in full)
        level = (total - sum(3 * sizes[s] for s in full)) / free if free else 0
        more = {s for s in names if s not in full and level * w[s] > 3 * sizes[s]}
        if not more:
            return {s: 3.0 * sizes[s] if s in full else level * w[s] for s in names}
        full |= more


def check_mix(rows, given):
    sizes = defaultdict(int)
    for d, s, t in given:
        sizes[s] += len([x for x in (t or "").replace("\x0b", " ").replace("\x0c", " ").split(" ") for x in x.split("\n") for x in x.split("\t") if x])
    want, taken = brute_targets(sizes), defaultdict(int)
    assert len(rows) == len(given)
    for doc, source, size, source_size, target, got in rows:
        assert source_size == sizes[source] and target == pytest.approx(want[source], rel=1e-12)
        assert 0 <= got <= 3 * size
        taken[source] += got
    assert sum(taken.values()) == sum(sizes.values())
    for s, n in taken.items():
        assert abs(n - want[s]) <= 2 * mixing.PACKET * (1 + want[s] / max(1, min(x for x in want.values() if x))) and abs(n - want[s]) <= max(600, 0.02 * want[s])


def test_mix_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.op10_mixing(spark, SF)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = [(d, source[d], a, b, c, e) for d, a, b, c, e in rows_of(got)]
    check_mix(rows, rows_of(docs.select("doc_id", "source", "text")))
    again = mixing.mix_sizes(docs.repartition(7))
    assert sorted(rows_of(again)) == sorted(rows_of(got))


def test_mix_odd_rows(spark, odd, none):
    got = rows_of(mixing.mix_sizes(odd))
    assert len(got) == odd.count() and sum(r[4] for r in got) == sum(r[1] for r in got)
    assert rows_of(mixing.mix_sizes(none)) == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(rows_of(mixing.mix_sizes(blank))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mixed_documents_hold_what_was_taken(spark, odd):
    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).drop("rid", "h", "size")
    taken = {r.doc_id: r.taken for r in mixing.mix_sizes(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words, whole = defaultdict(int), {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        words[r.doc_id] += len([x for x in r.text.encode().split()])
        assert whole[r.doc_id].startswith(r.text)
    assert words == {d: n for d, n in taken.items() if n}


def test_targets_with_full_sources(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 30):
        sizes = {None if i == 2 else f"s{i}": rng.choice([0, 1, 10, 1000, 10**6]) for i in range(n)}
        rows = spark.createDataFrame([(s, v) for s, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
        assert got == pytest.approx(brute_targets(sizes), rel=1e-12)


def check_packing(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    want = []
    for doc, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r[:5] for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r[5]].append((r[6], r[3]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r[3] for r in rows) // capacity)
    return len(bins), least


def test_packing_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins, least = check_packing(rows_of(packing.op6_packing(spark, SF).select(cols)), rows_of(docs))
    assert bins <= least + 1


def test_packing_odd_rows(spark, odd, none):
    more = ["<|endoftext|> a<|startoftext|>b", "It's THE I'LL Σίγμας İx ÀÉ e\u0301a.b,c d.. ,e 12.5, x.\n\ny", "a\u00a0b\u3000c\x0bd\x1ce", "\ud55c\uae00 日本 👍🏽.", "<|EndOfText|>"]
    docs = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(900 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_packing(rows_of(packing.pack_documents(docs).select(cols)), rows_of(docs))
    assert rows_of(packing.pack_documents(none)) == []


def test_encoder_looks_up_distinct_words_only():
    class Counted(dict):
        looked = 0

        def get(self, *key):
            self.looked += 1
            return super().get(*key)

        def __getitem__(self, key):
            self.looked += 1
            return super().__getitem__(key)

    rng = random.Random(1)
    letters = [*"abßéZ'’!?,.<|-\u0301\n\t\x1c\u00a0 09Σ中", "<|endoftext|>", "'ll", "Word,", " the "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(500)]
    encoder = packing.Encoder(None)
    got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.batch(pa.array(texts))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encoder.known = Counted(encoder.known)
    ids = encoder.batch(pa.array(["The cat, the\ndog."] * 1000))
    assert len(set(map(bytes, ids))) == 1 and len(ids) == 1000
    assert encoder.known.looked < 20


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_bins(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(packing, "_ROWS_PER_PART", rng.choice([3, 20_000]))
    kind = [lambda: rng.randrange(1, 100), lambda: 1, lambda: 51, lambda: rng.choice([1, 2, 99]), lambda: rng.randrange(20, 40)][seed]
    lengths = [kind() for _ in range(400)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    rows = rows_of(packing.best_fit(items, 100))
    assert sorted(r[0] for r in rows) == list(range(400)) and all(lengths[r[0]] == r[3] for r in rows)
    load = defaultdict(int)
    for _, b, _, n in rows:
        load[b] += n
    assert max(load.values()) <= 100
    gaps = []  # best fit decreasing, one by one
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        gaps.append((100 if fit is None else gaps.pop(gaps.index(fit))) - n)
    assert len(load) <= 1.06 * len(gaps) + 1
