import random
import re

from pyspark.sql import functions as F

from cinderline.llm import licenses
from cinderline.llm.common import portions
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=licenses.TEMPLATES, least=licenses.LEAST):
    w = split(text)
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    blocks = []
    for label, sentence in templates:
        s = split(sentence)
        width = max(8, 1 << (len(s) - 1).bit_length())
        for i in range(0, len(w), width):
            share = len(set(s) & set(w[i : i + 2 * width])) / len(set(s))
            if share >= least - 1e-12:
                blocks.append((label, i, share))
    base = sorted({x for _, x in places})
    return (
        len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base),
        ",".join(sorted({*base, *(x for x, _, _ in blocks)})), 1.0 if places else max((x for _, _, x in blocks), default=0.0), sorted(blocks),
    )


def check(docs, got):
    want = [(i, *brute(t)) for i, t in docs]
    have = [(*r[:-1], sorted(tuple(b) for b in r[-1])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_whole_table(spark):
    for sf in ("0.001", "0.01"):
        docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
        got = rows_of(licenses.op12_license_scan(spark, f"/root/testdata/sf{sf}"))
        check(rows_of(docs.select("doc_id", "text")), got)
    assert {"cc-by", "gpl", "reserved", "mit", "apache", "cc-by-nc"} <= {x for r in got for x in r[6].split(",")}
    # Only texts that state a license are marked.
    texts = dict(rows_of(docs.select("doc_id", "text")))
    assert all(re.search("(?i)licen|rights reserved", texts[r[0]]) for r in got if r[6])


def test_odd_rows(spark, odd, none, tmp_path):
    rng = random.Random(7)
    rows = rows_of(odd.select("doc_id", "text"))
    sentences = [t for _, t in licenses.TEMPLATES] + list(licenses.PHRASES)
    for i in range(150):
        s = split(rng.choice(sentences))
        s = [x for x in s if rng.random() > 0.08]
        pad = lambda n: " ".join(rng.choice(["de", "the", "of", "license", "café", "X9"]) for _ in range(rng.randrange(n)))
        rows.append((1000 + i, pad(60) + rng.choice([" ", "\n", "--", "\x00"]) + rng.choice([" ", "\n", "; "]).join(s) + rng.choice([".", " "]) + pad(60).upper()))
    rows.append((5000, "CC-BY cc by, CC.BY ccby " * 3000 + "x" * 100_000))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("q") for c in ("scan", "places", "n_words", "word")})
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    check(rows, rows_of(licenses.op12_license_scan(spark, str(tmp_path))))
    out = licenses.license_scan(odd)
    assert out.columns == [*odd.columns, "scan"] and out.count() == odd.count()
    assert rows_of(licenses.license_scan(none)) == []


def test_portions_and_words():
    assert [(p.start, p.stop) for p in portions([b"a" * 10] * 5, 25)] == [(0, 2), (2, 4), (4, 5)]
    assert [(p.start, p.stop) for p in portions(["a" * 100, "", "b"], 25)] == [(0, 1), (1, 3)] and list(portions([], 25)) == []
    n, text, at, which = licenses.Words(["b", "été", "cc"]).find(["A b-CC".encode(), b"", "Été".encode(), "été cc".encode()])
    assert n.tolist() == [3, 0, 1, 2] and text.tolist() == [0, 0, 3, 3] and at.tolist() == [1, 2, 0, 1] and which.tolist() == [0, 2, 1, 2]


def test_order_does_not_change_matches(spark):
    """Any global order of words gives the same blocks: the filters lose none."""
    docs = [(i, t) for i, t in rows_of(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")) if t]
    own = sorted({w for _, t in licenses.TEMPLATES for w in licenses.words_of(t)})
    results = []
    for seed in range(3):
        order = random.Random(seed).sample(own, len(own))
        index = licenses.Templates(licenses.TEMPLATES, order, 0.6)
        size, text, at, word = licenses.Words(order).find([t.encode() for _, t in docs])
        results.append(sorted(tuple(x) for found in index.matches(size, text, at, word) for x in zip(*(y.tolist() for y in found))))
    want = sorted((k, licenses.TEMPLATES.index(t), i, s) for k, (_, x) in enumerate(docs) for t in licenses.TEMPLATES for _, i, s in brute(x, [t], 0.6)[-1])
    assert results[0] == results[1] == results[2] == want and want
