"""URL filters, quality rules."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from cinderline.llm import quality, urls
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


def brute_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def test_urls_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.execute(f"select page_id, host, path, rule, verdict from ({urls.SQL})").fetchall()
    assert sorted(rows_of(urls.op3_url_filters(spark, SF))) == sorted(want)


def test_urls_against_brute_force(spark):
    rules = urls.QUERY_RULES + [("example.com", "/en/a/", "allow"), ("b.example.com", "/", "block"), ("example.com", "/", "block"), ("com", "/en/long/path/", "block"),
                                ("x.y.z", "/é", "block"), ("", "/", "block"), ("net", "", "allow")]
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "EXAMPLE.Com", "notexample.com", "net", "a.net", "x.y.z", "", "..", "a..net", "com.", "é.com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/en/a/b", "/en/long/path/z", "/es/", "/fr/q?x=/en/", "/é/", "?q", "#f/en/", "/%0a\nz"]
    given = [f"{s}{h}{p}" for s in ("https://", "://", "x") for h in hosts for p in paths] + [None, "", "http://a://b/en/"]
    rows = [(i, u) for i, u in enumerate(given)] + [(None, "http://example.com/en/")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumnsRenamed({}).selectExpr("*", "1 as host", "2 as path", "3 as rule", "4 as key")
    got = rows_of(urls.filter_urls(pages.repartition(5), spark.createDataFrame(rules, urls.RULES)))
    want = [(i, *brute_url(u, rules)) for i, u in rows]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_urls_with_empty_path_and_subdomain_rules(spark):
    rules = [("example.com", "", "block"), ("www.example.com", "/en/", "allow"), ("com", "", "allow"), ("a-b.com", "", "block"), ("x.a-b.com", "/", "allow")]
    urls_ = [f"http://{h}{p}" for h in ("example.com", "www.example.com", "com", "a-b.com", "x.a-b.com", "net") for p in ("", "/", "/x", "/en/x", "?q")]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = rows_of(urls.filter_urls(pages, spark.createDataFrame(rules, urls.RULES)))
    assert sorted(got, key=str) == sorted(((i, *brute_url(u, rules)) for i, u in enumerate(urls_)), key=str)


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert rows_of(urls.filter_urls(none, spark.createDataFrame(urls.QUERY_RULES, urls.RULES))) == []
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert rows_of(urls.filter_urls(pages, spark.createDataFrame([(None, "/", "block")], urls.RULES), "block")) == [(1, "a.com", "/", None, "block")]


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_counts(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for table in (odd, docs):
        got = quality.with_quality(table.select("doc_id", "text", *(["kept", "score"] if "kept" in table.columns else [])), None)
        for r in got.collect():
            q = r["__quality"]
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_quality(r["text"])
            assert q.kept == (not q.base_failed)
    assert quality.with_quality(none, None).count() == 0


def test_quality_verdicts(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train_quality(docs, labels, most=1500)
    judged = quality.with_quality(docs.join(labels, "doc_id"), model).filter("not __quality.base_failed").selectExpr("quality", "__quality.kept", "__quality.score").toPandas()
    assert (judged[judged.quality == 1].kept).mean() > 0.99
    assert (judged[judged.quality == 0].kept).mean() < 0.1


def test_quality_without_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train_quality(odd, labels) is None
    assert quality.train_quality(none, labels) is None
    one = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (None, 0, 0), (5, None, 1)], labels.schema)
    assert quality.train_quality(odd, one) is None
    assert quality.keep_good(odd, labels).columns == odd.columns


@pytest.mark.parametrize("seed", range(4))
def test_trees_follow_direction(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(800, 3))
    y = (np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(size=800) > 0).astype(float)
    model = quality.fit_trees(x, y, np.array([-1, 1, 0]))
    assert ((model.score(x) > 0.5) == y).mean() > 0.7
    for f, sign in ((0, -1), (1, 1)):
        base = rng.normal(size=(50, 3)).repeat(40, axis=0)
        base[:, f] = np.tile(np.linspace(-3, 3, 40), 50)
        steps = np.diff(model.margin(base).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-12).all()
