"""SimHash near-duplicates: a binary trie of fingerprints joined with itself under a Hamming budget."""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderline.llm.common import fresh, partitions, stored, table
from cinderline.llm.graph import components

_STEP = 4


def fingerprint_of(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles, as a signed number.

    A-Z is lower-cased; shingles (repeats included) are joined by a space and hashed with XXH64; a bit is 1 if set in
    over half the hashes. Fewer words than a shingle: the whole sequence; no word or null: 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if n == 0:
        return 0
    joined = b" ".join(tokens)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1)
        starts = ends[:-1].tolist()
        starts.insert(0, 0)
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    bits = np.zeros(64, np.int64)
    array = np.array(hashes, np.uint64)
    for i in range(0, len(array), 1 << 14):
        part = array[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(array), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in text], dtype="int64")


def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    return [(sum(1 << i for i in c), k) for k in range(most + 1) for c in combinations(range(bits), k)]


def _prefix(column: str | Column, depth: int) -> Column:
    return F.shiftrightunsigned(column, 64 - depth) if depth else F.lit(0).cast("long")


class _Forest:
    """Union-find over positions, so that a dense cluster yields one link per member instead of all its pairs."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root(a), self.root(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def root(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = y


def join_tries(left: np.ndarray, right: np.ndarray | None, depth: int, spent: int, most: int, width: int = 1 << 18):
    """Links ``(i, j, kind)`` between two sorted arrays of unsigned fingerprints, each a subtree at ``depth``.

    Node pairs go down together one bit at a time. A pair of children adds a differing bit; a pair beyond ``most``
    is dropped. ``right`` None joins ``left`` with itself. At most about ``width`` node pairs of one level are
    held at a time (a stack keeps the rest). Positions of ``right`` follow those of ``left``; the links form
    a spanning forest of all pairs found.
    """
    own = right is None
    right = left if own else right
    shift = 0 if own else len(left)
    forest = _Forest(shift + len(right))
    zero = np.zeros(1, np.int64)
    stack = [(depth, zero, zero + len(left), zero, zero + len(right), zero + spent)]
    while stack:
        d, a0, a1, b0, b1, dist = stack.pop()
        if len(a0) > width:
            half = len(a0) // 2
            stack += [(d, *(x[half:] for x in (a0, a1, b0, b1, dist))), (d, *(x[:half] for x in (a0, a1, b0, b1, dist)))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            close = np.bitwise_count(left[i] ^ right[j]) <= most
            forest.add(i[close], j[close] + shift)
            a0, a1, b0, b1, dist = (x[~single] for x in (a0, a1, b0, b1, dist))
        if not len(a0) or d == 64:
            continue
        bit = np.uint64(63 - d)
        ac, bc = _cuts(left, a0, a1, bit), _cuts(right, b0, b1, bit)
        parts = []
        for x0, x1, y0, y1, extra in ((a0, ac, b0, bc, 0), (ac, a1, bc, b1, 0), (a0, ac, bc, b1, 1), (ac, a1, b0, bc, 1)):
            keep = (x1 > x0) & (y1 > y0) & (dist + extra <= most)
            if own and extra and x0 is ac:
                keep &= (a0 != b0) | (a1 != b1)  # the mirror of the pair before
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], dist[keep] + extra))
        merged = [np.concatenate(x) for x in zip(*parts)]
        if own:
            same = (merged[0] == merged[2]) & (merged[1] - merged[0] == 1) & (merged[3] - merged[2] == 1)
            merged = [x[~same] for x in merged]
        if len(merged[0]):
            stack.append((d + 1, *merged))
    every = np.arange(len(forest.up))
    roots = forest.root(every)
    return every[roots != every], roots[roots != every]


def _cuts(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each range, all of one prefix, the given bit turns from 0 to 1 (binary search, all ranges at once)."""
    low, high = start.copy(), end.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        one = ((values[np.minimum(middle, len(values) - 1)] >> bit) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)


def close_fingerprints(prints: DataFrame, most: int = 2, leaf: int = 16_384) -> DataFrame:
    """Links ``(a, b)`` of distinct fingerprints (column ``fp``) at ``most`` or fewer differing bits, as spanning forests.

    The upper trie is walked in Spark: node pairs of one depth, each with its differing bits, are joined with the
    nodes that differ within the budget. A pair whose nodes hold at most ``leaf`` fingerprints becomes a task;
    larger ones go four bits deeper, however many fingerprints share a prefix. Inside a task ``join_tries`` goes on.
    """
    spark = prints.sparkSession
    total = prints.count()
    depth = 0
    while depth < 60 and total > leaf << depth:
        depth += _STEP

    def nodes(d):
        return prints.groupBy(_prefix("fp", d).alias("node")).agg(F.count(F.lit(1)).alias("n"))

    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in _masks(depth, most)])
    here = nodes(depth)
    pairs = (
        here.select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode(masks).alias("x"))
        .select("a", "na", F.col("a").bitwiseXOR(F.col("x.m")).alias("b"), F.col("x.k").alias("spent"))
        .filter("a <= b").join(here.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    )
    found = []
    while True:
        pairs = stored(pairs.select("a", "b", "na", "nb", "spent"), "trie")
        big = F.greatest("na", "nb") > 2 * leaf
        found.append(_leaf_links(prints, pairs.filter(~big), depth, most))
        if depth == 64 or pairs.filter(big).isEmpty():
            break
        step = min(_STEP, 64 - depth)
        below = nodes(depth + step)
        masks = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).alias("k")) for m, k in _masks(step, most)])
        pairs = (
            pairs.filter(big).select("a", "b", "spent")
            .join(below.select(F.shiftrightunsigned("node", step).alias("a"), F.col("node").alias("a1"), F.col("n").alias("na")), "a")
            .select("a", "b", "a1", "na", "spent", F.explode(masks).alias("x")).filter(F.col("spent") + F.col("x.k") <= most)
            .select(
                F.col("a1").alias("a"), "na", (F.col("spent") + F.col("x.k")).alias("spent"),
                F.shiftleft("b", step).bitwiseOR(F.col("a1").bitwiseAND(F.lit((1 << step) - 1))).bitwiseXOR(F.col("x.m")).alias("b"),
            )
            .filter("a <= b").join(below.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        )
        depth += step
    links = found[0]
    for more in found[1:]:
        links = links.unionAll(more)
    return links


def _leaf_links(prints: DataFrame, pairs: DataFrame, depth: int, most: int) -> DataFrame:
    def join_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, spent = (int(pdf[c].iloc[0]) for c in ("a", "b", "spent"))
        values = np.sort(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        if a == b:
            i, j = join_tries(values, None, depth, 0, most)
        else:
            side = (values >> np.uint64(64 - depth)) == np.uint64(a % (1 << 64))
            i, j = join_tries(values[side], values[~side], depth, spent, most)
            values = np.concatenate([values[side], values[~side]])
        out = values.view(np.int64)
        return pd.DataFrame({"a": out[i], "b": out[j]})

    ends = pairs.select("a", "b", "spent", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("node"))
    dealt = (
        prints.select("fp", _prefix("fp", depth).alias("node")).join(ends, "node").select("a", "b", "spent", "fp")
        .repartition(2 * partitions(prints.sparkSession), "a", "b")
    )
    return dealt.groupBy("a", "b").applyInPandas(join_pair, "a long, b long")


def fingerprint_components(prints: DataFrame, most: int = 2, leaf: int = 16_384) -> DataFrame:
    """``(fp, component_id)`` for rows ``(doc_id, fp)``: the smallest non-null ``doc_id`` reachable by links.

    Rows of one fingerprint are one node, pre-aggregated; a group of copies of any size is one row from here on.
    Where no document of a component has an id, ``component_id`` is null.
    """
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    comp = components(close_fingerprints(nodes.select("fp"), most, leaf))
    rooted = nodes.join(comp, F.col("fp") == F.col("id"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def simhash_groups(docs: DataFrame, most: int = 2, leaf: int = 16_384) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 lower-case hex digits), ``component_id``.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows are kept. An empty table gives none.
    """
    prints = stored(docs.select("doc_id", fingerprint(docs["text"]).alias("fp")), "prints")
    found = fingerprint_components(prints, most, leaf)
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, most: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of each SimHash group, one row each, all columns kept.

    Of several rows with that ``doc_id`` one text's stays, and of its copies one row.
    """
    hashes = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "text", "doc_id")
    prints = stored(docs.select(fingerprint(docs["text"]).alias("fp"), "doc_id", F.struct(hashes[0].alias("r1"), hashes[1].alias("r2")).alias("row")), "prints")
    found = fingerprint_components(prints, most)
    one, two = fresh(docs, "r1"), fresh(docs, "r2")
    first = prints.join(found, "fp").filter("doc_id <=> component_id").groupBy("root").agg(F.min("row").alias("row"))
    first = first.select(F.col("row.r1").alias(one), F.col("row.r2").alias(two))
    # Copies of one row would all carry its hashes: a last pass leaves one.
    return docs.withColumns({one: hashes[0], two: hashes[1]}).join(first, [one, two], "left_semi").dropDuplicates([one, two]).drop(one, two)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
