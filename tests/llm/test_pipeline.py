"""The pipeline stage by stage, each against a brute-force version on the rows it got."""

from collections import Counter, defaultdict

import corpus_pipeline
from cinderline.llm.common import stored
from tests.llm.conftest import rows_of
from tests.llm.test_lines import WORDS, brute
from tests.llm.test_mix_and_pack import brute_targets, check_packing
from tests.llm.test_row_filters import brute_quality
from tests.llm.test_simhash import expected

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append(docs)
        docs = stored(stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns
    seen.append(docs)
    raw, good, lined, single, mixed = ({r.doc_id: r.text for r in d.collect()} for d in seen[:5])

    assert all(not brute_quality(t)[-1] for t in good.values()) and good.items() <= raw.items()
    passed = {d for d, t in raw.items() if not brute_quality(t)[-1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d in passed if labels.get(d) == 1]
    assert sum(d in good for d in clean) >= 0.97 * len(clean)

    judged, want = brute(list(good.items())), {}
    for d, t in good.items():
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if judged.get((d, i), (0, 0, True))[2])
        if WORDS.search(left):
            want[d] = left
    assert lined == want

    groups = expected(list(lined.items()))
    assert single == {d: lined[d] for d in {g for _, _, g in groups}}

    rows = seen[4].collect()
    size = {d: len(WORDS.findall(t)) for d, t in single.items()}
    source = {r.doc_id: r.source for r in seen[3].collect()}
    words, used = defaultdict(int), Counter()
    for r in rows:
        n = len(WORDS.findall(r.text))
        words[r.source] += n
        used[r.doc_id] += n
        assert single[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    sizes = defaultdict(int)
    for d, n in size.items():
        sizes[source[d]] += n
    assert sum(words.values()) == sum(size.values()) and all(n <= 3 * size[d] for d, n in used.items())
    for s, target in brute_targets(sizes).items():
        assert abs(words[s] - target) <= max(600, 0.02 * target)

    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    bins, least = check_packing(rows_of(docs.select(cols)), [(r.doc_id, r.text) for r in rows])
    assert bins <= least + 1


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None
