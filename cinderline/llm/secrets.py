"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. DataFrame operations only."""

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import WORD, stored, table

_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
_CLASS = r"[A-Za-z0-9+/_=-]"
#: Kinds in their order, pattern, group that holds the value.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"(AKIA[A-Z0-9]+)", 1),
    # A run of at least 16: the same matches as runs of any length with the short ones dropped.
    ("hex", r"([0-9a-f]{16,})", 1),
]
_LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "markov"]
_MARK = "\x01"


def _spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """``array<struct<start, kind, end, value>>`` of the leftmost non-overlapping matches whose value is long enough.

    Matches are put between marks and the text is split there, so every second part is a match and lengths add up to
    offsets in code points.
    """
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), none.alias("out"))

    def step(s: Column, part: Column) -> Column:
        after, value = s["at"] + F.length(part), F.regexp_extract(part, pattern, group)
        span = F.array(F.struct(s["at"].alias("start"), F.lit(kind).alias("kind"), after.alias("end"), value.alias("value")))
        return F.struct(
            after.alias("at"), (~s["odd"]).alias("odd"),
            F.when(s["odd"] & (F.length(value) >= least), F.concat(s["out"], span)).otherwise(s["out"]).alias("out"),
        )

    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step, lambda s: s["out"])).otherwise(none)


def _touched(text: Column) -> Column:
    """Whole words that the spans of ``base`` touch, as pieces of text; each word is taken once however many spans touch it."""
    t = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    start = F.expr("named_struct('to', 0, 'out', cast(array() as array<string>))")

    def step(s: Column, b: Column) -> Column:
        left = F.when(b["start"] > s["to"], F.length(F.substring_index(F.substr(t, s["to"] + 1, b["start"] - s["to"]), " ", -1))).otherwise(0)
        begin = F.greatest(b["start"], s["to"]) - left
        end = b["end"] + F.length(F.substring_index(F.substr(t, b["end"] + 1), " ", 1))
        return F.when(b["end"] <= s["to"], s).otherwise(
            F.struct(end.alias("to"), F.concat(s["out"], F.array(F.substr(t, begin + 1, end - begin))).alias("out"))
        )

    return F.aggregate("base", start, step, lambda s: s["out"])


def scan(docs: DataFrame, least: int = 16) -> DataFrame:
    """``doc_id, base, candidates, touched``: spans of the fixed patterns, runs of at least ``least`` characters of keys,
    and the text of all words that a span of the fixed patterns touches.

    Null text is empty. The mark character is replaced by another control character, which no pattern holds either.
    """
    text = F.translate(F.coalesce("text", F.lit("")), _MARK, "\x02")
    base = [_spans(text, k, pattern, group, _LEAST[kind]) for k, (kind, pattern, group) in enumerate(PATTERNS)]
    found = docs.select(
        "doc_id", F.array_sort(F.concat(*base)).alias("base"),
        _spans(text, len(PATTERNS), f"({_CLASS}{{{least},}})", 1, least).alias("candidates"), text.alias("text"),
    )
    return found.select("doc_id", "base", "candidates", _touched(F.col("text")).alias("touched"))


def _pairs(strings: DataFrame) -> Counter:
    """Counts of adjacent characters of the column ``value``; at most the square of the alphabet of them.

    Equal strings are counted first, map-side, so that pairs are made once a distinct string.
    """
    steps = strings.filter("length(value) > 1").groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.expr("transform(sequence(1, length(value) - 1), i -> substring(value, i, 2))")).alias("pair"), "n"
    )
    return Counter({(r["pair"][0], r["pair"][1]): r["n"] for r in steps.groupBy("pair").agg(F.sum("n").alias("n")).filter(
        F.col("pair").rlike("^[A-Za-z0-9+/_=.-]{2}$")
    ).collect()})


def _words(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("value"))


def train(scanned: DataFrame, docs: DataFrame, smooth: float = 20.0) -> list[float]:
    """Log-likelihood ratio of each character pair, random string over ordinary word, as a flat table.

    Labels: the values the fixed patterns find are random strings; the words they do not touch are ordinary. Both are
    counted over all documents. Both models start from ``smooth`` uniform observations per character, so a table without
    secrets still gives a model (random strings are then uniform).
    """
    random = _pairs(scanned.select(F.explode("base.value").alias("value")))
    ordinary = _pairs(_words(docs))
    ordinary.subtract(_pairs(_words(scanned.select(F.explode("touched").alias("text")))))
    n = len(_CHARS)

    def logs(counts):
        total = Counter()
        for (a, _), k in counts.items():
            total[a] += k
        return {(a, b): math.log((counts.get((a, b), 0) + smooth / n) / (total[a] + smooth)) for a in _CHARS for b in _CHARS}

    r, o = logs(random), logs(ordinary)
    return [r[a, b] - o[a, b] for a in _CHARS for b in _CHARS]


def find_secrets(docs: DataFrame, at_least: float = 0.9) -> DataFrame:
    """``doc_id, base, spans`` for every row: arrays of ``(start, kind, end, value)`` by start and kind, offsets in code points.

    ``base`` has the fixed patterns' spans; ``spans`` also the runs that touch none of them and whose mean log-likelihood
    ratio per character pair is ``at_least`` or more (kind ``markov``). Null and empty texts have none.
    """
    scanned = stored(scan(docs), "scan")
    ratios = F.from_json(F.lit(json.dumps(train(scanned, docs))), "array<double>")
    n = len(_CHARS)

    def score(c: Column) -> Column:
        v = c["value"]
        return F.aggregate(
            F.sequence(F.lit(1), F.length(v) - 1), F.lit(0.0),
            lambda s, i: s + F.element_at(ratios, (F.instr(F.lit(_CHARS), F.substr(v, i, F.lit(1))) - 1) * n + F.instr(F.lit(_CHARS), F.substr(v, i + 1, F.lit(1)))),
        ) / (F.length(v) - 1)

    def is_new(c: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) & (score(c) >= at_least)

    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", F.filter("candidates", is_new))).alias("spans"))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))
