"""Mixing sources to target weights: weighted fair queueing by virtual finish times."""

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cinderline.llm.common import WORD, fresh, n_words, numbered, stored, table, unit

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Most times a document may be used.
EPOCHS = 3
#: Long documents are queued in packets of so many words, so the queue serves sources evenly.
PACKET = 256
_GROUP = 4096
_MOST_RANGES = 65_536


def source_targets(rows: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, n_docs, target`` from rows ``(source, size)``: shares of all words by weight, none above
    ``epochs`` times its source's words; the excess is shared again by weight among the others.

    The common level ``words per weight`` rises until no further source is full; each step is one aggregate over the
    source table.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "sources")
    ladder = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", ladder).withColumn("most", epochs * F.col("source_size")), "weights")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        is_full = F.lit(level) * F.col("weight") >= F.col("most") if full >= 0 else F.lit(False)
        used, weight, count = ranked.agg(
            F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(is_full.cast("long")), F.lit(0)),
        ).first()
        if count == full or weight == 0:
            break
        level, full = (total - used) / weight, count
    return ranked.select("source", "source_size", "n_docs", F.least(F.col("most").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def fair_queue(rows: DataFrame, targets: DataFrame, epochs: int = EPOCHS, packet: int = PACKET) -> DataFrame:
    """``(rid, taken)`` for rows ``(rid, source, size, h)``; rows with nothing taken are absent.

    Within a source, documents follow the hash ``h``. A packet's virtual finish time is the words its source has queued up to and
    including it, over the source's target; later epochs queue the source again. All packets are sorted by
    finish time in ranges of equal virtual time, which hold about equally many words whatever the sources' sizes, and the
    queue ends where the total of all words is reached (inside a packet if need be).
    """
    sized = rows.join(targets, F.col("source").eqNullSafe(F.col("__s")))
    group = F.floor(unit(F.col("h")) * F.ceil(F.col("n_docs") / _GROUP)).cast("long")
    sized = sized.filter("size > 0 and target > 0").select("rid", "source", "size", "h", "source_size", "target", group.alias("group"))
    groups = sized.groupBy("source", "group").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select(F.col("source").alias("__s"), F.col("group").alias("__g"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    own = Window.partitionBy("source", "group").orderBy("h", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    queued = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("__s")) & (F.col("group") == F.col("__g")))
        .select("rid", "source", "size", "h", "target", "source_size", (F.col("offset") + F.col("inside")).alias("before"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("begin", F.col("before") + F.col("epoch") * F.col("source_size")).filter("begin < target")
        .withColumn("packet", F.explode(F.expr(f"sequence(0L, (size - 1) div {packet}L)")))
        .withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("packet") * packet))
        .withColumn("begin", F.col("begin") + F.col("packet") * packet).filter("begin < target")
        .select("rid", "source", "h", "begin", "words", ((F.col("begin") + F.col("words")) / F.col("target")).alias("finish"))
    )
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    ranges = max(1, min(_MOST_RANGES, budget // (packet * _GROUP)))
    queued = queued.withColumn("range", F.floor(F.col("finish") * ranges).cast("long"))
    totals = queued.groupBy("range").agg(F.sum("words").alias("words"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most _MOST_RANGES and a few rows
    starts = totals.select(F.col("range").alias("__r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("served"))
    order = Window.partitionBy("range").orderBy("finish", "source", "h", "begin", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        queued.withColumn("inside", F.coalesce(F.sum("words").over(order), F.lit(0))).join(starts, F.col("range") == F.col("__r"))
        .withColumn("taken", F.least("words", F.lit(budget) - F.col("served") - F.col("inside"))).filter("taken > 0")
        .groupBy("rid").agg(F.sum("taken").alias("taken"))
    )


def _with_targets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    targets = stored(source_targets(rows), "targets").withColumnRenamed("source", "__s")
    return targets, fair_queue(rows, targets)


def _rows(docs: DataFrame, rid: str = "rid") -> DataFrame:
    return docs.select(F.col(rid).alias("rid"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("h"))


def mix_sizes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    Null and empty texts have size 0 and are never taken. A null source is a source, the last in order. Repeated rows queue each.
    """
    rows = stored(_rows(docs.withColumn("rid", F.monotonically_increasing_id())), "sizes")
    targets, taken = _with_targets(rows)
    return (
        rows.join(targets, F.col("source").eqNullSafe(F.col("__s"))).join(taken, "rid", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


@F.pandas_udf(T.StringType())
def _first_words(text: pd.Series, count: pd.Series) -> pd.Series:
    """The text up to the end of its ``count``-th word; null stays null."""
    word = re.compile(WORD)

    def cut(t, n):
        for k, m in enumerate(word.finditer(t), 1):
            if k == n:
                return t[: m.end()]
        return t

    return pd.Series([None if t is None else cut(t, n) for t, n in zip(text, count)], dtype=object)


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row per whole copy, and one cut after its last taken word where the budget ends.

    Columns stay those of ``docs``; ``n_chars``, if there, follows a cut text.
    """
    rid, words = fresh(docs, "rid"), fresh(docs, "words")
    kept = stored(docs.withColumn(rid, F.monotonically_increasing_id()), "mixed")
    rows = stored(_rows(kept, rid), "sizes")
    _, taken = _with_targets(rows)
    copies = (
        rows.select("rid", "size").join(taken, "rid")
        .withColumn("copy", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
        # Null: the whole text.
        .select(F.col("rid").alias(rid), F.when(F.expr("copy * size > taken"), F.expr("taken - (copy - 1) * size")).alias(words))
    )
    is_cut = F.col(words).isNotNull()
    out = kept.join(copies, rid)
    out = out.withColumn("text", F.coalesce(_first_words(F.when(is_cut, F.col("text")), F.col(words)), "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(is_cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
