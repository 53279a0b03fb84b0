"""Repeated byte strings across documents: refinement of q-gram buckets at selected positions."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderline.llm.common import Gram, mix, stored, table

SIZE = 400
_Q = 100
_LANES = (11, 23)
_RUN = "r1 long, r2 long, start long, end long, bucket long, id long, inner boolean"
#: Windows of a run are refined in groups by their distance to the q-gram.
_GROUP = 16


def _sliding(a: np.ndarray, w: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``w`` neighbours, from running values of blocks in both directions."""
    n = len(a)
    pad = -n % w
    b = np.concatenate([a, np.full(pad, a[-1], a.dtype)]).reshape(-1, w)
    right = of.accumulate(b, axis=1).ravel()
    left = of.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(left[: n - w + 1], right[w - 1 : n])


class _Hasher:
    """q-gram buckets of a text and their refinement."""

    def __init__(self):
        self.grams = [Gram(s) for s in _LANES]

    def runs(self, data: np.ndarray, size: int, q: int):
        """Maximal runs of windows (strings of ``size`` bytes) with the same least q-gram bucket.

        Equal windows have the same least bucket, wherever they are, so only runs of one bucket need comparing.
        Per run: first and last window, bucket, a second hash of all its bytes, whether the q-gram occurs in it twice.
        """
        bucket = self.grams[0].window(self.grams[0].sums(data), q)
        w = size - q + 1
        least = _sliding(bucket, w, np.minimum)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        ends = np.concatenate([starts[1:], [len(least)]]) - 1
        zeros = np.zeros(w - 1, np.uint64)
        picked = np.flatnonzero(_sliding(np.concatenate([zeros, least, zeros]), w, np.maximum) == bucket)
        twin = np.concatenate([[0], np.cumsum(bucket[picked[1:]] == bucket[picked[:-1]])])
        low = np.searchsorted(picked, starts)
        high = np.searchsorted(picked, ends + w - 1, side="right") - 1
        again = twin[np.maximum(high, low)] > twin[low]
        ids = self.grams[1].pieces(self.grams[1].sums(data), starts, ends + size)
        return starts, ends, least[starts], ids, again

    def windows(self, data: np.ndarray, size: int, q: int) -> list[np.ndarray]:
        """Identifiers of all windows: q-gram buckets refined by the buckets of later offsets, each result used again.

        ``bucket(2h, i)`` comes from ``bucket(h, i)`` and ``bucket(h, i + h)``; a last step at a smaller offset reaches ``size``.
        """
        out = []
        for g in self.grams:
            b, h = g.window(g.sums(data), q), q
            while h < size:
                step = min(h, size - h)
                b = mix(b[:-step] * g.base + b[step:])
                h += step
            out.append(b)
        return out


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """Two hashes stand for a row; rows alike in ``doc_id`` and ``text`` are one document here and get the same result."""
    return docs.select(
        F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("r2"), "text", *more
    )


def _intervals(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]


def _run_rows(hasher: _Hasher, data: np.ndarray, size: int, q: int) -> dict:
    """Runs of one text; and, where a q-gram occurs twice in a run, the windows that repeat inside it (``inner``)."""
    starts, ends, bucket, ids, again = hasher.runs(data, size, q)
    inner = np.zeros(len(starts), bool)
    if again.any():
        w = hasher.windows(data, size, q)
        key = mix(w[0]) + w[1]
        at = np.flatnonzero(np.repeat(again, ends - starts + 1))
        ordered = np.sort(key[at])
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        at = at[np.isin(key[at], twice)]
        if len(at):
            a, b = _intervals(at)
            starts, ends, inner = np.concatenate([starts, a]), np.concatenate([ends, b]), np.concatenate([inner, np.ones(len(a), bool)])
            zero = np.zeros(len(a), np.uint64)
            bucket, ids = np.concatenate([bucket, zero]), np.concatenate([ids, zero])
    return {"start": starts, "end": ends, "bucket": bucket.view(np.int64), "id": ids.view(np.int64), "inner": inner}


def _frame(parts: list[dict]) -> pd.DataFrame:
    """One table of many small ones: arrays are laid end to end, a single value holds for all rows of its part."""
    many = [k for k, v in parts[0].items() if isinstance(v, np.ndarray)]
    sizes = [len(p[many[0]]) for p in parts]
    return pd.DataFrame({k: np.concatenate([p[k] for p in parts]) if k in many else np.repeat([p[k] for p in parts], sizes) for k in parts[0]})


def _groups(hasher: _Hasher, data: np.ndarray, bucket: int, size: int, q: int) -> dict:
    """Windows of one run, in groups of ``_GROUP`` distances to their first q-gram of the run's bucket.

    Per group: the distance, first and last window, hashes of the bytes that all possible windows of the group share (``c``), and of
    all bytes of its windows if it is complete (``f``; else a value of its own).
    """
    second = hasher.grams[1].sums(data)
    at = np.flatnonzero(hasher.grams[0].window(hasher.grams[0].sums(data), q) == np.uint64(bucket % (1 << 64)))
    windows = np.arange(len(data) - size + 1)
    gram = at[np.minimum(np.searchsorted(at, windows), len(at) - 1)]
    group = (gram - windows) // _GROUP
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (gram[1:] != gram[:-1])]))
    last = np.concatenate([first[1:], [len(windows)]]) - 1
    gram, group = gram[first], group[first]
    low, high = group * _GROUP, np.minimum(group * _GROUP + _GROUP - 1, size - q)
    full = (gram - high == first) & (gram - low == last)
    c, f = hasher.grams[1].pieces(second, gram - low, gram - high + size), hasher.grams[1].pieces(second, first, last + size)
    return {"distance": group, "first": first, "last": last, "full": full, "c": c.view(np.int64), "f": f.view(np.int64)}


def repeated_windows(docs: DataFrame, size: int = SIZE, q: int = _Q) -> DataFrame:
    """``r1, r2, starts, ends``: per document the windows whose string also starts elsewhere, as runs.

    1. Initial buckets: each text becomes runs of windows with one least q-gram bucket, where it is read, about one row in 150 bytes.
       A run equal to another (pre-aggregated by hash) is repeated as a whole; of equal runs one goes on. A run alone in its bucket is
       unique but for what repeats inside it, which is found at once.
    2. What shares a bucket without being equal (the edges of copied passages) is refined by the bytes at later and earlier offsets, in
       groups of windows: a group whose common bytes occur once is unique, one whose bytes all occur twice is repeated.
    3. Groups still open are refined to single windows.
    Each step is an aggregate by hash, and only what it leaves open goes on.
    """

    def find_runs(batches):
        hasher = _Hasher()
        for pdf in batches:
            parts = []
            for r1, r2, text in zip(pdf["r1"], pdf["r2"], pdf["text"]):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                parts.append({"r1": r1, "r2": r2} | _run_rows(hasher, data, size, q))
                if len(parts) >= 300:
                    yield _frame(parts)
                    parts = []
            if parts:
                yield _frame(parts)

    def slices(batches):
        for pdf in batches:
            rows = []
            for r1, r2, text, starts, ends, buckets in zip(*(pdf[k] for k in ("r1", "r2", "text", "starts", "ends", "buckets"))):
                data = text.encode("utf-8", "surrogatepass")
                rows += [(r1, r2, a, u, data[a : b + size]) for a, b, u in zip(starts.tolist(), ends.tolist(), buckets.tolist())]
            yield pd.DataFrame(rows, columns=["r1", "r2", "start", "bucket", "data"])

    def group(batches):
        hasher = _Hasher()
        for pdf in batches:
            parts = []
            for r1, r2, start, bucket, data in zip(*(pdf[k] for k in ("r1", "r2", "start", "bucket", "data"))):
                own = _groups(hasher, np.frombuffer(data, np.uint8), bucket, size, q)
                parts.append({"r1": r1, "r2": r2, "start": start, "bucket": bucket} | own)
            if parts:
                yield _frame(parts)

    def refine(batches):
        hasher = _Hasher()
        for pdf in batches:
            parts = []
            for r1, r2, start, data, firsts, lasts in zip(*(pdf[k] for k in ("r1", "r2", "start", "data", "firsts", "lasts"))):
                w1, w2 = (w.view(np.int64) for w in hasher.windows(np.frombuffer(data, np.uint8), size, q))
                at = np.concatenate([np.arange(a, b + 1) for a, b in zip(firsts, lasts)])
                parts.append({"r1": r1, "r2": r2, "at": start + at, "w1": w1[at], "w2": w2[at]})
            if parts:
                yield _frame(parts)

    one = F.count(F.lit(1))
    long = F.octet_length("text") >= size
    found = stored(_keyed(docs).filter(long).mapInPandas(find_runs, _RUN), "runs")
    runs, inner = found.filter("not inner"), found.filter("inner").select("r1", "r2", "start", "end")
    same = ["bucket", "id"]
    classes = runs.groupBy(*same).agg(one.alias("n"), F.min(F.struct("r1", "r2", "start", "end")).alias("one"))
    judged = stored(classes.join(classes.groupBy("bucket").agg(one.alias("kinds")), "bucket"), "classes")
    whole = runs.join(judged.filter("n > 1").select(*same), same, "left_semi").select("r1", "r2", "start", "end")

    asked = judged.filter("kinds > 1").select("one.*", "bucket").groupBy("r1", "r2").agg(
        F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"), F.collect_list("bucket").alias("buckets")
    )
    texts = _keyed(docs).filter(long).join(asked, ["r1", "r2"]).select("r1", "r2", "text", "starts", "ends", "buckets")
    open_ = stored(texts.mapInPandas(slices, "r1 long, r2 long, start long, bucket long, data binary"), "slices")
    spec = "r1 long, r2 long, start long, bucket long, distance long, first long, last long, full boolean, c long, f long"
    # An incomplete group is no copy of another: its place stands in for the hash.
    own = F.when(F.col("full"), F.col("f")).otherwise(F.xxhash64("r1", "r2", "start", "first"))
    groups = stored(open_.mapInPandas(group, spec).withColumn("f", own).drop("full"), "groups")
    core, all_ = ["bucket", "distance", "c"], ["f"]
    kinds = groups.groupBy(*core, *all_).agg(one.alias("n"), F.min(F.struct("r1", "r2", "start", "first", "last")).alias("one"))
    many = kinds.groupBy(*core).agg(one.alias("kinds")).filter("kinds > 1")
    settled = groups.join(kinds.filter("n > 1").select(*core, *all_), core + all_, "left_semi").select(
        "r1", "r2", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last")).alias("end")
    )
    still = kinds.join(many, core).select("one.*").groupBy("r1", "r2", "start").agg(
        F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")
    )
    windows = stored(open_.join(still, ["r1", "r2", "start"]).mapInPandas(refine, "r1 long, r2 long, at long, w1 long, w2 long"), "windows")
    twice = windows.groupBy("w1", "w2").agg(one.alias("n")).filter("n > 1").select("w1", "w2")
    single = windows.join(twice, ["w1", "w2"], "left_semi").select("r1", "r2", F.col("at").alias("start"), F.col("at").alias("end"))
    return (
        whole.unionAll(inner).unionAll(settled).unionAll(single)
        .groupBy("r1", "r2").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    )


def remove_repeats(docs: DataFrame, size: int = SIZE, q: int = _Q) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row: texts as UTF-8 bytes without what is repeated.

    A byte goes if a string of ``size`` bytes that covers it also starts anywhere else, overlaps included; strings are judged on the
    input and never cross documents. ``kept`` (binary) has the other bytes in order, ``n_spans`` counts maximal removed runs. Null text is empty.
    Rows alike in ``doc_id`` and ``text`` are copies of each other. An empty table gives no rows.
    """

    kind = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

    @F.pandas_udf(kind)
    def cut(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for t, a, b in zip(text, starts, ends):
            data = (t or "").encode("utf-8", "surrogatepass")
            if a is None:
                out.append((0, 0, data))
                continue
            step = np.zeros(len(data) + 1, np.int64)
            np.add.at(step, np.asarray(a, np.int64), 1)
            np.add.at(step, np.asarray(b, np.int64) + size, -1)
            gone = np.cumsum(step)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    found = repeated_windows(docs, size, q)
    joined = _keyed(docs, "doc_id").join(found, ["r1", "r2"], "left")
    return joined.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), cut("text", "starts", "ends").alias("c")
    ).select("doc_id", "n_bytes", "c.*")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
