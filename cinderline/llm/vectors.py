"""Near-duplicate vectors: randomised-rotation binary codes with stored correction factors."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import partitions, stored, table
from cinderline.llm.graph import components

AT_LEAST = 0.95
#: Chance that a pair exactly at the threshold meets in no table.
MISS = 1e-4
#: Members of a bucket that are compared in one task; larger buckets are cut into pairs of blocks.
_BLOCK = 4096
_SIGMAS = 5.0


def rotation(dim: int, seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(1000 * seed + dim).normal(size=(dim, dim)))[0]


def plan(n: int, at_least: float = AT_LEAST, target: int = 1024) -> tuple[int, int]:
    """Bits and number of tables: buckets of about ``target`` vectors, and enough tables that a pair at the threshold is missed
    with chance ``MISS``. A random direction parts two vectors with chance ``angle / pi``."""
    bits = max(0, math.ceil(math.log2(max(1, n) / target)))
    same = (1 - math.acos(at_least) / math.pi) ** bits
    return bits, 1 if bits == 0 else math.ceil(math.log(MISS) / math.log(1 - same))


def table_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys ``(vectors, tables)`` from signs of random directions; the first tables do not depend on their number."""
    if bits == 0:
        return np.zeros((len(x), tables), np.int64)
    directions = np.random.default_rng(77 + x.shape[1]).normal(size=(tables * bits, x.shape[1]))
    signs = (x @ directions.T > 0).reshape(len(x), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


class Codes:
    """One bit per dimension of the rotated unit vectors, and what unbiased estimates need.

    With ``code`` the unit vector of signs, ``factor = <code, x>`` and any ``y``: ``<code, y> / factor`` estimates
    ``<x, y>`` without bias, with deviation ``sqrt((1 / factor**2 - 1) / (dim - 1))``. ``y`` is rounded at random to 4 bits, which keeps
    the estimate unbiased; products are then counts of common bits.
    """

    def __init__(self, x: np.ndarray, turn: np.ndarray, factor: np.ndarray | None = None):
        self.dim = x.shape[1]
        r = x @ turn
        self.words = -(-self.dim // 64)
        self.signs = r > 0
        self.factor = np.abs(r).sum(axis=1) / math.sqrt(self.dim) if factor is None else factor
        self.bits = self._pack(self.signs)
        self.ones = self.signs.sum(axis=1)
        low, high = r.min(axis=1), r.max(axis=1)
        self.low, self.step = low, np.maximum((high - low) / 15, 1e-30)
        level = np.floor((r - low[:, None]) / self.step[:, None] + np.random.default_rng(5).random(r.shape)).clip(0, 15).astype(np.uint8)
        self.planes = [self._pack((level >> j & 1).astype(bool)) for j in range(4)]
        self.sum = level.sum(axis=1, dtype=np.int64) * self.step + self.dim * low

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), 64 * self.words), bool)
        wide[:, : self.dim] = bits
        return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)

    def upper(self, i: slice, other: "Codes", j: slice, sigmas: float = _SIGMAS) -> np.ndarray:
        """Upper confidence bounds of ``<x_i, y_j>``, codes of the one against rounded vectors of the other."""
        common = np.zeros((len(self.bits[i]), len(other.bits[j])), np.int64)
        for k, plane in enumerate(other.planes):
            for w in range(self.words):
                common += np.bitwise_count(self.bits[i, w][:, None] & plane[j, w][None, :]).astype(np.int64) << k
        inner = common * other.step[j][None, :] + self.ones[i][:, None] * other.low[j][None, :]
        estimate = (2 * inner - other.sum[j][None, :]) / math.sqrt(self.dim) / self.factor[i][:, None]
        spread = np.sqrt(np.maximum(0, 1 / self.factor[i] ** 2 - 1) / max(1, self.dim - 1))
        rounding = other.step[j] / 2 / self.factor[i].min(initial=1.0)
        return estimate + sigmas * (spread[:, None] + rounding[None, :])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    from cinderline.llm.simhash import _Forest

    forest = _Forest(n)
    forest.add(a, b)
    every = np.arange(n)
    roots = forest.root(every)
    return every[roots != every], roots[roots != every]


def compare(x: np.ndarray, y: np.ndarray | None, fx: np.ndarray, fy: np.ndarray | None, mine: int, bits: int, tables: int, at_least: float):
    """Links ``(i, j, counts)`` among ``x`` (``y`` None) or between ``x`` and ``y``, all in one bucket of table ``mine``.

    Estimates decide which pairs are computed again in double precision. ``counts`` marks the pairs that meet in no earlier
    table, so that each is counted once over all tables.
    """
    turn = rotation(x.shape[1], 0)
    own = y is None
    cx, kx = Codes(x, turn, fx), table_keys(x, bits, mine)
    y, cy, ky = (x, cx, kx) if own else (y, Codes(y, turn, fy), table_keys(y, bits, mine))
    out = []
    for s in range(0, len(x), 512):
        for t in range(s if own else 0, len(y), 2048):
            si, sj = slice(s, min(s + 512, len(x))), slice(t, min(t + 2048, len(y)))
            i, j = np.nonzero(cx.upper(si, cy, sj) >= at_least)
            i, j = i + s, j + t
            if own:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                near = np.einsum("ij,ij->i", x[a], y[b]) >= at_least
                a, b = a[near], b[near]
                seen = np.zeros(len(a), bool)
                for c in range(mine):
                    seen |= kx[a, c] == ky[b, c]
                out.append((a, b, ~seen))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(p) for p in zip(*out))


def near_vectors(vectors: DataFrame, at_least: float = AT_LEAST) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``(vec_id, embedding)``.

    Rows link if their cosine, in double precision, is ``at_least`` or more; ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest non-null ``vec_id`` reachable (itself included), ``kept`` is ``vec_id = component_id`` (false for a null id).
    Null and empty arrays, zero vectors and ones with null or non-finite parts link with nothing. Vectors of different length never link.

    Equal arrays are one row with a weight. Each is written to a few dozen tables of buckets (signs of random directions); buckets
    are compared by codes with correction factors. Only counts and spanning links leave a task, however dense a bucket is.
    """
    value = F.transform("embedding", lambda v: v.cast("double"))
    good = (F.size("v") > 0) & ~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("v", lambda v: v != 0)
    rows = vectors.select("vec_id", value.alias("v")).select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.col("v")).alias("v"))
    classes = stored(
        rows.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first"))
        .withColumn("c", F.monotonically_increasing_id()), "vectors",
    )
    bits, tables = plan(classes.count(), at_least)

    def deal(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["v"].map(len)):
                x = np.stack(part["v"].to_numpy())
                x = x / np.abs(x).max(axis=1)[:, None]
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                keys = table_keys(x, bits, tables)
                factor = np.abs(x @ rotation(dim, 0)).sum(axis=1) / math.sqrt(dim)
                data = [r.tobytes() for r in x]
                for t in range(tables):
                    yield pd.DataFrame({"t": t, "key": keys[:, t], "dim": dim, "c": part["c"].array, "w": part["w"].array, "factor": factor, "x": data})

    dealt = classes.select("c", "w", "v").mapInPandas(deal, "t int, key long, dim int, c long, w long, factor double, x binary")
    bucket = ["t", "key", "dim"]
    sizes = dealt.select(*bucket).groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(f"n > {_BLOCK}").withColumn("blocks", F.ceil(F.col("n") / _BLOCK))
    blocked = (
        dealt.join(sizes.select(*bucket, "blocks"), bucket, "left").withColumn("own", F.pmod(F.xxhash64("c"), F.coalesce("blocks", F.lit(1))))
        .withColumn("pair", F.explode(F.expr(
            "transform(sequence(0L, coalesce(blocks, 1L) - 1L), k -> struct(least(own, k) as a, greatest(own, k) as b))"
        ))).select(*bucket, "pair.a", "pair.b", "own", "c", "w", "factor", "x")
    )

    def join_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, t = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0]), int(pdf["t"].iloc[0])
        pdf = pdf.sort_values(["own", "c"], ignore_index=True)
        x = np.frombuffer(b"".join(pdf["x"]), float).reshape(len(pdf), -1)
        c, w, f = (pdf[k].to_numpy() for k in ("c", "w", "factor"))
        if a == b:
            i, j, once = compare(x, None, f, None, t, bits, tables, at_least)
        else:
            cut = int((pdf["own"] == a).sum())
            i, j, once = compare(x[:cut], x[cut:], f[:cut], f[cut:], t, bits, tables, at_least)
            j = j + cut
        linked = np.bincount(i[once], w[j[once]], len(c)) + np.bincount(j[once], w[i[once]], len(c))
        some = np.flatnonzero(linked)
        p, q = _forest(i, j, len(c))
        return pd.concat([
            pd.DataFrame({"a": c[some], "b": pd.array([pd.NA] * len(some), "Int64"), "n": linked[some].astype(np.int64)}),
            pd.DataFrame({"a": c[p], "b": pd.array(c[q], "Int64"), "n": 0}),
        ])

    found = stored(
        blocked.repartition(2 * partitions(vectors.sparkSession), *bucket, "a", "b").groupBy(*bucket, "a", "b")
        .applyInPandas(join_bucket, "a long, b long, n long"), "links",
    )
    counts = found.filter("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("b is not null").select("a", "b")).select(F.col("id").alias("c"), "component")
    judged = classes.join(counts, "c", "left").join(comp, "c", "left").select(
        "v", "first", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "c").alias("root")
    )
    least = judged.groupBy("root").agg(F.min("first").alias("component_id"))
    full = judged.join(least, "root").select("v", "n_links", "component_id")
    linked = rows.filter("v is not null").join(full, "v").select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
