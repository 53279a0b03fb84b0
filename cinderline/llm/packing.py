"""Best-fit packing of token sequences: bulk-synchronous rounds of distributed successor sweeps."""

import re
import threading
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cinderline.llm.common import portions, stored, table

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a Python worker keeps; beyond it the store starts anew.
CACHED_WORDS = 800_000
IDLE_SECONDS = 3.0
_KEPT: dict = {}
_SPECIAL = "<|"
#: Letters that lower-casing and composition leave as they are.
_PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch
#: Plain letters and a run of ASCII marks but the apostrophe, which may begin a token with letters.
_MARKED = r"\A(?P<word>[a-zß-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]+)\z"


def vocabulary() -> str:
    """Path of the vocabulary file; the package of public tokenizers is installed where tasks run."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts, word by word.

    The vocabulary splits at white space before anything else and lower-cases, so the ids of a text are those of its space
    or line separated chunks in order, and each distinct chunk needs encoding once. Letters and marks never share a
    token, so a chunk of letters and a last run of marks is its two halves, and only halves are kept. Texts that may hold special tokens
    are encoded whole.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = self.plain = Tokenizer.from_file(path or vocabulary())
        if path is None:
            # Plain letters are normalized, and of the pattern only white space matters between them.
            self.plain = Tokenizer.from_file(vocabulary())
            self.plain.normalizer = normalizers.Sequence([])
            letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), letters])
        self.known: dict[str, bytes] = {}
        words = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(words.values()) + 1, bool)
        self.ends_word[[i for w, i in words.items() if w.endswith("</w>")]] = True

    @staticmethod
    @contextmanager
    def of(path: str | None):
        """One per Python worker and path. It is kept for the next task of the stage, and goes when none begins within ``IDLE_SECONDS``."""
        if _KEPT.get("release"):
            _KEPT.pop("release").cancel()
        if _KEPT.get("path", ()) != path:
            _KEPT.update(path=path, encoder=Encoder(path))
        encoder = _KEPT["encoder"]
        try:
            yield encoder
        finally:
            _KEPT["release"] = threading.Timer(IDLE_SECONDS, _KEPT.clear)
            _KEPT["release"].daemon = True
            _KEPT["release"].start()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of words of plain letters: encoded in one text, taken apart where a token ends a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return self._encode(words)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[i:j] for i, j in zip([0, *ends], ends)]

    def _learn(self, words: list[str]) -> None:
        plain, other = [], []
        for w in words:
            (plain if _PLAIN(w) else other).append(w)
        for encode, some, many in ((self._encode_words, plain, 1000), (self._encode, other, 10_000)):
            for i in range(0, len(some), many):
                part = some[i : i + many]
                self.known.update(zip(part, encode(part)))

    def _ids(self, words: pa.Array) -> pa.Array:
        """Of each word; Python sees a distinct one once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        unknown = [w for w, ids in zip(distinct, found) if ids is None]
        if unknown:
            if len(self.known) + len(unknown) > CACHED_WORDS:
                self.known, unknown = {}, distinct
            self._learn(unknown)
            found = list(map(self.known.__getitem__, distinct))
        return pa.array(found, pa.large_binary()).take(coded.indices)

    def batch(self, texts: pa.Array) -> list[memoryview]:
        """Little-endian unsigned 32-bit ids of each text. Texts are taken apart and ids laid out by Arrow."""
        special = pc.match_substring(texts, _SPECIAL)
        lower = pc.ascii_lower(pc.if_else(special, pa.scalar("", texts.type), texts))
        split = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        halves = pc.extract_regex(coded.dictionary, _MARKED)
        word, marks = pc.coalesce(pc.struct_field(halves, "word"), coded.dictionary), pc.fill_null(pc.struct_field(halves, "marks"), "")
        laid = pc.binary_join_element_wise(self._ids(word), self._ids(marks), pa.scalar(b"", pa.large_binary())).take(coded.indices)
        _, offsets, data = laid.buffers()
        ends = np.frombuffer(offsets, np.int64)[laid.offset :][split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        out = [data[i:j] for i, j in zip(ends, ends[1:])]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = memoryview(self._encode([texts[i].as_py()])[0])
        return out


def cut_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32``, made where the text is read.

    A document is its token ids and then id 1 (null and empty texts: only that). Documents above ``capacity`` are cut into
    full pieces and a last, shorter one.
    """

    def cut(batches):
        end = np.array([END_ID], "<u4").tobytes()
        with Encoder.of(path) as encoder:
            for batch in batches:
                texts = pc.fill_null(batch["text"], "")
                for some in portions([range(n) for n in pc.binary_length(texts).to_pylist()], 4_000_000):
                    rows = []
                    for row, ids in enumerate(encoder.batch(texts[some])):
                        data = bytes(ids) + end
                        for k, i in enumerate(range(0, len(data), 4 * capacity)):
                            part = data[i : i + 4 * capacity]
                            rows.append((row, k, i // 4, len(part) // 4, zlib.crc32(part)))
                    row, piece, *more = zip(*rows)
                    doc = batch["doc_id"][some].take(pa.array(row)).cast(pa.int64())
                    yield pa.record_batch([doc, pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in more)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_CLASSES = T.StructType([T.StructField(c, T.LongType()) for c in ("kind", "size", "part", "before")])
_ROWS_PER_PART = 20_000
#: A gap is offered as several slots if the longest item fits so many times.
_SEVERAL = 4
_MOST_PARTS = 50_000


def _parts(counts: dict) -> dict:
    """Into how many parts the rows of each class are ranked: one but for hot classes."""
    per = max(_ROWS_PER_PART, sum(counts.values()) // _MOST_PARTS)
    return {k: -(-n // per) for k, n in counts.items() if n > per}


def _sweep(items: DataFrame, gaps: DataFrame, counts: dict) -> DataFrame:
    """Match each item to the smallest free gap that holds it, every gap once; ``counts`` by ``(kind, size)``.

    Rows are in one order: size falling, gaps (kind 0) before items (kind 1). Read as brackets, a gap opens and an item closes;
    the item takes the gap opened last, which is the smallest one left. Brackets that belong together have the same depth, and
    depth is a prefix sum: rows before the class, known from the counts, and the rank inside the class. So one
    exchange by depth pairs them all; a depth holds at most one row of each class.

    The result has all rows: items with ``bin`` (null: no gap left), gaps with the ``filled`` length.
    """
    spark = items.sparkSession
    parts = _parts(counts)
    rows = gaps.select(F.lit(0).alias("kind"), F.col("slot").alias("size"), F.col("bin").alias("id"), "bin").unionAll(
        items.select(F.lit(1).alias("kind"), F.col("length").alias("size"), F.col("item").alias("id"), F.lit(None).cast("long").alias("bin"))
    )
    part = F.lit(0).cast("long")
    for (kind, size), n in parts.items():
        part = F.when(F.expr(f"kind = {kind} and size = {size}"), F.pmod(F.xxhash64("id"), F.lit(n))).otherwise(part)
    rows = rows.withColumn("part", part)
    if parts:
        table_ = [(r["kind"], r["size"], r["part"], r["n"]) for r in rows.groupBy("kind", "size", "part").agg(F.count(F.lit(1)).alias("n")).collect()]
    else:
        table_ = [(kind, size, 0, n) for (kind, size), n in counts.items()]
    before, classes = 0, []
    for kind, size, p, n in sorted(table_, key=lambda x: (-x[1], x[0], x[2])):
        classes.append((kind, size, p, before))
        before += n if kind == 0 else -n
    # One row per size and kind (and per 20,000 rows of a hot one): bounded by the capacity.
    known = F.broadcast(spark.createDataFrame(classes, _CLASSES))
    rank = F.row_number().over(Window.partitionBy("kind", "size", "part").orderBy("id"))
    leveled = rows.join(known, ["kind", "size", "part"]).withColumn(
        "depth", F.when(F.col("kind") == 0, F.col("before") + rank).otherwise(F.col("before") - rank + 1)
    )
    along = Window.partitionBy("depth").orderBy(F.col("size").desc(), "kind")
    return (
        leveled.select(
            "kind", "size", "id", "bin",
            F.lag(F.struct("kind", "bin")).over(along).alias("prior"), F.lead(F.struct("kind", "size")).over(along).alias("later"),
        ).select(
            "kind", "size", "id",
            F.when(F.col("kind") == 0, F.col("bin")).when(F.col("prior.kind") == 0, F.col("prior.bin")).alias("bin"),
            F.when((F.col("kind") == 0) & (F.col("later.kind") == 1), F.col("later.size")).alias("filled"),
        )
    )


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(item, bin, round)`` for rows ``(item, length)`` with lengths from 1 below ``capacity``: few bins, none over capacity.

    Each round sweeps all unplaced items against all gaps at once, then updates the gaps. A gap that holds the longest item several times
    is offered as several slots, so many short items need few rounds. New bins open for items longer than every gap: at first as many
    as all tokens fill, later as many as those items fill. The driver only sees counts by length and gap, at most
    twice the capacity of them.
    """
    spark = items.sparkSession
    counted = items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    lengths = {r["length"]: r["n"] for r in counted}
    free: dict[int, int] = {}
    gaps = spark.createDataFrame([], "bin long, gap long")
    placed, bins, turn = [], 0, 0
    while lengths:
        longest, shortest = max(lengths), min(lengths)
        widest = max((g for g in free if free[g]), default=0)
        if longest > widest:
            new = -(-sum(k * n for k, n in lengths.items() if k > widest) // capacity)
            gaps = gaps.unionByName(spark.range(bins, bins + new).select(F.col("id").alias("bin"), F.lit(capacity).cast("long").alias("gap")))
            bins += new
            free[capacity] = free.get(capacity, 0) + new
        counts = {(1, k): n for k, n in lengths.items()}
        for gap, n in free.items():
            slots = gap // longest if gap // longest >= _SEVERAL else 1
            for size, many in ((longest, slots - 1), (gap - (slots - 1) * longest, 1)):
                if many and size >= shortest:
                    counts[0, size] = counts.get((0, size), 0) + many * n
        slotted = gaps.withColumn("many", F.expr(f"if(gap div {longest} >= {_SEVERAL}, gap div {longest}, 1L)")).select(
            "bin", F.explode(F.expr(f"transform(sequence(1L, many), i -> if(i < many, {longest}L, gap - (many - 1) * {longest}L))")).alias("slot")
        )
        outcome = stored(_sweep(items, slotted.filter(F.col("slot") >= shortest), counts).withColumn("round", F.lit(turn)), "round")
        placed.append(outcome.filter("kind = 1 and bin is not null").select(F.col("id").alias("item"), "bin", "round", F.col("size").alias("length")))
        items = outcome.filter("kind = 1 and bin is null").select(F.col("id").alias("item"), F.col("size").alias("length"))
        # Slots too small for any item are not in the outcome: no later item is shorter than the shortest now.
        gaps = (
            outcome.filter("kind = 0").groupBy("bin").agg(F.sum(F.col("size") - F.coalesce("filled", F.lit(0))).alias("gap")).filter("gap > 0")
        )
        left = items.groupBy(F.lit(1).alias("kind"), F.col("length").alias("size")).agg(F.count(F.lit(1)).alias("n")).unionAll(
            gaps.groupBy(F.lit(0).alias("kind"), F.col("gap").alias("size")).agg(F.count(F.lit(1)).alias("n"))
        ).collect()
        lengths = {r["size"]: r["n"] for r in left if r["kind"] == 1}
        free = {r["size"]: r["n"] for r in left if r["kind"] == 0}
        turn += 1
    if not placed:
        return spark.createDataFrame([], "item long, bin long, round int, length long")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionAll(more)
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; full pieces are sequences of their own, the others are packed."""
    kept = stored(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    packed = best_fit(kept.filter(F.col("length") < capacity).select("item", "length"), capacity)
    inside = Window.partitionBy("bin").orderBy("round", "item").rowsBetween(Window.unboundedPreceding, -1)
    placed = packed.select("item", "bin", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
    # Bins count from 0, so negative numbers are free for the full pieces.
    return (
        kept.join(placed, "item", "left")
        .withColumn("sequence_id", F.coalesce("bin", -1 - F.col("item"))).withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Repeated rows are packed each, with equal pieces; a null ``doc_id`` stays null. An empty table gives no rows.
    ``path`` names the vocabulary file.
    """
    return pack_pieces(cut_documents(docs, capacity, path), capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
