"""Hard-negative mining: a vertical (BOND) scan of columnar blocks of vectors by each anchor."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderline.llm.common import partitions, stored, table

#: Components are scaled, rounded down and held within this bound, so that products of up to 2**14 of them fit a long.
LARGEST = 1 << 24
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least LOW/100 of its positive's.
LOW = 80
#: Rows of a block: 1 MB for 64 dimensions.
_BLOCK = 4096
_ANCHORS = 4096
#: Dimensions read between two looks at the bounds.
_STEP = 8
_WINDOWS = "array<struct<score: bigint, id: bigint, place: int>>"
_BLOCKS = "label long, dim int, block long, n int, ids binary, low binary, high binary, cells binary"


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(id, label, dim, v)`` of the rows that take part: id, label and vector not null, no null or non-finite component."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("x", lambda v: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(v * scale).cast("double"))).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.filter("id is not null and label is not null and x is not null").filter(~bad)
    return rows.select("id", "label", F.size("x").alias("dim"), whole.alias("v"))


def _to_blocks(batches):
    """Rows sorted by ``(dim, label)`` as blocks of one label, dimension by dimension, with the range of each dimension."""

    def out(t):
        dim = t["dim"][0].as_py()
        cells = np.ascontiguousarray(pa.concat_arrays(t["v"].chunks).flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim).T.astype(np.int32))
        return {
            "label": t["label"][0].as_py(), "dim": dim, "block": t["row"][0].as_py(), "n": len(t),
            "ids": np.stack([t["id"].to_numpy(), t["row"].to_numpy()]).astype(np.int64).tobytes(),
            "low": cells.min(axis=1, initial=LARGEST).tobytes(), "high": cells.max(axis=1, initial=-LARGEST).tobytes(), "cells": cells.tobytes(),
        }

    held = None
    schema = pa.schema([("label", pa.int64()), ("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32())] + [(k, pa.binary()) for k in ("ids", "low", "high", "cells")])
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        key = np.stack([held["dim"].to_numpy(), held["label"].to_numpy()])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        ends = [0, *cuts.tolist(), held.num_rows]
        for a, b in zip(ends, ends[1:]):
            last = b == held.num_rows
            whole = range(a, b - _BLOCK + 1, _BLOCK) if last else range(a, b, _BLOCK)
            for i in whole:
                yield pa.RecordBatch.from_pylist([out(held.slice(i, min(_BLOCK, b - i)))], schema)
            if last:
                held = held.slice(a + len(whole) * _BLOCK)
    if held is not None and held.num_rows:
        yield pa.RecordBatch.from_pylist([out(held)], schema)


class Block:
    def __init__(self, row: dict):
        self.label, self.n, dim = row["label"], row["n"], row["dim"]
        self.ids, self.rows = np.frombuffer(row["ids"], np.int64).reshape(2, self.n)
        self.low, self.high = (np.frombuffer(row[k], np.int32).astype(np.int64) for k in ("low", "high"))
        self.cells = np.frombuffer(row["cells"], np.int32).reshape(dim, self.n)

    def scan(self, q: np.ndarray, alive):
        """``(rows, scores)`` of the rows that ``alive`` leaves, after all dimensions of the anchor ``q`` are read.

        Dimensions come in the order of the anchor's magnitudes. ``alive(low, high)`` is asked between steps with bounds of the
        scores of the rows still in: what is read so far and the least and most that the remaining dimensions of this block can add.
        """
        order = np.argsort(-np.abs(q), kind="stable")
        a, b = q * self.low, q * self.high
        least, most = (np.concatenate([np.cumsum(f(a, b)[order][::-1])[::-1], [0]]) for f in (np.minimum, np.maximum))
        rows, score = np.arange(self.n), np.zeros(self.n, np.int64)
        for i in range(0, max(1, len(q)), _STEP):
            dims = order[i : i + _STEP]
            score = score + (q[dims] @ (self.cells[dims] if len(rows) == self.n else self.cells[np.ix_(dims, rows)])) if len(dims) else score
            left = min(i + _STEP, len(q))
            keep = alive(score + least[left], score + most[left])
            if not keep.all():
                rows, score = rows[keep], score[keep]
            if not len(rows):
                break
        return rows, score


def _best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int):
    """The first ``most`` by descending score, then id and row."""
    if len(score) > 4 * most:
        near = score >= np.partition(score, len(score) - most)[len(score) - most]
        score, ids, rows = score[near], ids[near], rows[near]
    order = np.lexsort((rows, ids, -score))[:most]
    return score[order], ids[order], rows[order]


def _least(scores: np.ndarray, most: int) -> int:
    """What a score must reach to be among the first ``most``."""
    return np.partition(scores, len(scores) - most)[len(scores) - most] if len(scores) >= most else np.iinfo(np.int64).min


class Positives:
    """The first rows of an anchor's own label, over all blocks seen so far."""

    same_label = True

    def __init__(self, most: int):
        self.most, self.found = most, (np.zeros(0, np.int64),) * 3

    def meet(self, q, own_row, block: Block):
        seen = self.found[0]

        def alive(low, high):  # low holds for the anchor's own row too, if it is here: one more is needed
            return high >= max(_least(seen, self.most), _least(low, self.most + 1))

        rows, score = block.scan(q, alive)
        other = block.rows[rows] != own_row
        rows, score = rows[other], score[other]
        self.found = _best(*(np.concatenate(x) for x in zip(self.found, (score, block.ids[rows], block.rows[rows]))), self.most)

    def results(self):
        for s, i, r in zip(*(x.tolist() for x in self.found)):
            yield {"other": i, "other_row": r, "score": s}


class Negatives:
    """The first rows in each window ``LOW * positive <= 100 * score <= 100 * positive``, over all blocks seen so far."""

    same_label = False

    def __init__(self, windows, most: int, low: int):
        self.top = np.array([s for s, _, _ in windows], np.int64)
        self.floor = -((-low * self.top) // 100)
        self.windows, self.most = windows, most
        self.found = [(np.zeros(0, np.int64),) * 3 for _ in windows]

    def meet(self, q, own_row, block: Block):
        reach = [max(f, _least(found[0], self.most)) for f, found in zip(self.floor, self.found)]

        def alive(low, high):
            keep = np.zeros(len(low), bool)
            for floor, top, least in zip(self.floor, self.top, reach):
                if floor <= top:
                    sure = low[(low >= floor) & (high <= top)]
                    keep |= (high >= max(least, _least(sure, self.most))) & (low <= top)
            return keep

        rows, score = block.scan(q, alive)
        for k, (floor, top) in enumerate(zip(self.floor, self.top)):
            inside = (score >= floor) & (score <= top)
            if inside.any():
                new = (score[inside], block.ids[rows[inside]], block.rows[rows[inside]])
                self.found[k] = _best(*(np.concatenate(x) for x in zip(self.found[k], new)), self.most)

    def results(self):
        for (_, _, place), found in zip(self.windows, self.found):
            for s, i, r in zip(*(x.tolist() for x in found)):
                yield {"other": i, "other_row": r, "score": s, "place": place}


def _task(make):
    """One group of anchors, then the blocks of one stripe one after the other; groups of a task follow each other."""

    def run(batches):
        key, anchors = None, []

        def out():
            rows = [{"anchor_row": a["row"], "place": 0} | r for a, _, state in anchors for r in state.results()]
            return pd.DataFrame(rows, columns=["anchor_row", "place", "other", "other_row", "score"])

        for pdf in batches:
            for row in pdf.to_dict("records"):
                if (row["part"], row["stripe"]) != key:
                    if anchors:
                        yield out()
                    key, anchors = (row["part"], row["stripe"]), []
                if row["kind"] == 0:
                    anchors.append((row, np.frombuffer(row["cells"], np.int32).astype(np.int64), make(row)))
                else:
                    block = Block(row)
                    for a, q, state in anchors:
                        if len(q) == len(block.cells) and (a["label"] == block.label) == state.same_label:
                            state.meet(q, a["row"], block)
        if anchors:
            yield out()

    return run


def _meet(anchors: DataFrame, blocks: DataFrame, groups: int, stripes: int, make) -> DataFrame:
    """Groups of anchors by stripes of blocks (about 16 MB), each pair of them in one task; as many tasks as pairs."""
    b = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int").alias("stripe"), F.lit(1).alias("kind"),
        F.col("block").alias("row"), "label", "dim", "n", "ids", "low", "high", "cells", F.expr(f"cast(null as {_WINDOWS}) as windows"),
    )
    a = anchors.select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("kind"), "row", "label", "dim", F.lit(1).alias("n"),
        *(F.lit(None).cast("binary").alias(k) for k in ("ids", "low", "high")), "cells", "windows",
    )
    spark = anchors.sparkSession
    dealt = a.unionByName(b).repartition(max(4 * partitions(spark), groups * stripes), "part", "stripe").sortWithinPartitions("part", "stripe", "kind", "row")
    return dealt.mapInPandas(_task(make), "anchor_row long, place int, other long, other_row long, score long")


def _first(found: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "other", "other_row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, per_group: int = _ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from rows ``(row, id, label, dim, v)`` of integers.

    ``anchors`` are some of the rows. Scores are integer inner products among vectors of one length; higher ones come first, ties by
    the smaller id. An anchor's positives are its first other rows of the same label. For each, the first rows of other labels
    with ``low * positive <= 100 * negative <= 100 * positive``. Rows that repeat an id count as rows of their own. An anchor without
    positives, or a positive without negatives, gives no row; an empty table gives none.

    Every row is in a columnar block of one label (at most 4,096 rows, so a hot label is many blocks). Anchors in groups meet the blocks in
    tasks that hold one block at a time: those of their own label first, then the others, with the windows that the positives set.
    Only the first rows of each window leave a task.
    """
    spark = rows.sparkSession
    dealt = rows.repartition(partitions(spark), F.xxhash64("row")).sortWithinPartitions("dim", "label", "row")
    blocks = stored(dealt.select("row", "id", "label", "dim", "v").mapInArrow(_to_blocks, _BLOCKS), "vector-blocks")
    groups = max(1, -(-anchors.count() // per_group))
    stripes = max(-(-2 * partitions(spark) // groups), -(-blocks.count() // 16))
    pack = F.udf(lambda v: np.array(v, np.int32).tobytes(), "binary", useArrow=True)
    part = F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part")
    asking = stored(anchors.select("row", "id", "label", "dim", part, pack("v").alias("cells")), "anchors")
    near = _meet(asking.withColumn("windows", F.expr(f"cast(null as {_WINDOWS})")), blocks, groups, stripes, lambda a: Positives(positives))
    near = stored(_first(near, positives).select("anchor_row", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    sets = near.groupBy("anchor_row").agg(F.collect_list(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("id"), "place")).alias("windows"))
    far = _meet(
        asking.join(sets, F.col("row") == F.col("anchor_row")).drop("anchor_row"), blocks, groups, stripes,
        lambda a: Negatives([(w["score"], w["id"], w["place"]) for w in a["windows"]], negatives, low),
    )
    best = _first(far, negatives).select("anchor_row", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(best, ["anchor_row", "place"]).join(asking.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scaled(table(spark, sf_dir, "embeddings"))
    turned = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stored(rows.withColumn("label", turned).withColumn("row", F.monotonically_increasing_id()), "vectors")
    return hard_negatives(rows, rows.filter("id % 100 = 0"))
