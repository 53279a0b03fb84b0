"""Line dedup: an exact set-similarity join of lines by prefix, length and positional filters."""

import gc
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderline.llm.common import WORD, Gram, drop_stored, fresh, mix, odd, portions, stored, table

#: Jaccard similarity as a fraction: 4/5.
NUM, DEN = 4, 5
#: Word frequencies are counted by so many bits of the words' hashes, so their table has a fixed size.
_BITS = 17
_MOST = np.uint64(2**64 - 1)
_LINES = "r1 long, r2 long, doc_id long, line int, size int, s1 long, s2 long, marks long, marks2 long, prefix array<long>"
#: Entries meet by word, or by two blocks of a word that has more than so many entries.
_GROUP = 4096
#: Characters of text that are taken apart at once (or one longer text).
_TEXT = 1_000_000
#: Cells of a table of rows by frequent words, and pairs of rows that are listed at once.
_CELLS = 16_000_000
#: Bits of the map that tells which lines may be wanted again; a false one costs a row in an exchange, nothing else.
_SPOTS, _STEP = 1 << 24, 40_503


def _words(texts: list[str], gram: Gram) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of ``texts`` laid end to end: hashes of the words, line of each word, text and number of each line."""
    data = np.frombuffer("\n".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = gram.pieces(gram.sums(data), start, end)
    line_of = np.searchsorted(np.flatnonzero(data == 10), start)
    per_text = np.array([t.count("\n") + 1 for t in texts])
    text_of = np.repeat(np.arange(len(texts)), per_text)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return hashes, line_of, text_of, number


def word_classes(docs: DataFrame) -> np.ndarray:
    """Rarity class of each hash bucket: the logarithm of how many words of all texts fall into it."""

    def count(batches):
        gram, total = Gram(31), np.zeros(1 << _BITS, np.int64)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in portions(texts, _TEXT):
                hashes = _words(texts[part], gram)[0]
                total += np.bincount((hashes >> np.uint64(64 - _BITS)).astype(np.int64), minlength=1 << _BITS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    counts = docs.select("text").filter("text is not null").mapInPandas(count, "bucket int, n long")
    rows = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2**_BITS rows
    out = np.zeros(1 << _BITS, np.uint64)
    out[rows["bucket"].to_numpy()] = np.log2(rows["n"].to_numpy(float)).astype(np.uint64) + np.uint64(1)
    return out


def _ids(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Identifiers of words: the rarity class above 58 bits of the hash, so sorting them sorts by rarity."""
    return (classes[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] << np.uint64(58)) | (hashes >> np.uint64(6))


def _line_sets(hashes: np.ndarray, line_of: np.ndarray, lines: int, classes: np.ndarray) -> dict:
    """Per line with a word: its number, set size, two hashes of the set, the parities of its words in 128 bits (two sets differ in at
    least as many words as parities differ), and the rarest words in order.

    Lines are sorted side by side with others of about their length.
    """
    ids = _ids(hashes, classes)
    counts = np.bincount(line_of, minlength=lines)
    first = np.cumsum(counts) - counts
    out = {k: [] for k in ("line", "size", "s1", "s2", "marks", "marks2", "cut", "prefix")}
    level = np.ceil(np.log2(np.maximum(counts, 1))).astype(int)
    for k in np.unique(level[counts > 0]):
        at = np.flatnonzero((level == k) & (counts > 0))
        column = np.arange(1 << k)[None, :]
        m = np.where(column < counts[at][:, None], ids[np.minimum(first[at][:, None] + column, len(ids) - 1)], _MOST)
        m.sort(axis=1)
        m[:, 1:][m[:, 1:] == m[:, :-1]] = _MOST
        m.sort(axis=1)
        real = m != _MOST
        size = real.sum(axis=1)
        cut = size - -(-NUM * size // DEN) + 1
        out["line"].append(at)
        out["size"].append(size)
        for name, seed in (("s1", 3), ("s2", 4)):
            out[name].append(np.where(real, mix(m * odd(seed)), 0).sum(axis=1, dtype=np.uint64))
        bit, upper = np.uint64(1) << (m & np.uint64(63)), (m >> np.uint64(6) & np.uint64(1)).astype(bool)
        for name, here in (("marks", real & ~upper), ("marks2", real & upper)):
            out[name].append(np.bitwise_xor.reduce(np.where(here, bit, np.uint64(0)), axis=1))
        out["cut"].append(cut)
        out["prefix"].append(m[column < cut[:, None]])
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k not in ("line", "size", "cut") else np.int64) for k, v in out.items()}


def line_table(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """One narrow row per line that has a word, made where the text is read."""

    def lines(batches):
        gram = Gram(31)
        for batch in batches:
            pdf = batch.to_pandas(integer_object_nulls=True)
            for part in portions(pdf["text"].tolist(), _TEXT):
                own = pdf.iloc[part]
                hashes, line_of, text_of, number = _words(own["text"].tolist(), gram)
                s = _line_sets(hashes, line_of, len(text_of), classes)
                text = text_of[s["line"]]
                offsets = np.concatenate([[0], np.cumsum(s["cut"])]).astype(np.int32)
                yield pa.record_batch([
                    pa.array(own["r1"].to_numpy(np.int64)[text]), pa.array(own["r2"].to_numpy(np.int64)[text]),
                    pa.array(own["doc_id"].array.astype("Int64").take(text)), pa.array(number[s["line"]].astype(np.int32)), pa.array(s["size"].astype(np.int32)),
                    *(pa.array(s[k].view(np.int64)) for k in ("s1", "s2", "marks", "marks2")),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(s["prefix"].view(np.int64))),
                ], names=["r1", "r2", "doc_id", "line", "size", "s1", "s2", "marks", "marks2", "prefix"])

    return _keyed(docs, "doc_id").filter("text is not null").mapInArrow(lines, _LINES)


def _keyed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(
        F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("r2"), "text", *[F.col(c).cast("long") for c in more]
    )


def _place():
    """Order of lines: by ``doc_id`` (null last) and line number."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2", "line")


def _whole_groups(batches, rows: int):
    """Batches sorted by ``key`` as tables that never cut a group of one key, sizes ascending in each, with the group number of each row.

    Spark sorts by one number only, which it does by radix; sizes are sorted here.
    """

    def numbers(t):
        v = t["key"].to_numpy()
        return np.cumsum(np.concatenate([[False], v[1:] != v[:-1]]))

    def by_size(t, group):
        return t.take(pa.array(np.lexsort((t["size"].to_numpy(), group)))), group

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            group = numbers(t)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield by_size(t.slice(0, last), group[:last])
            held = t.slice(last).to_batches()
            n = t.num_rows - last
    if n:
        t = pa.Table.from_batches(held)
        yield by_size(t, numbers(t))


def _near_rows(group: np.ndarray, size: np.ndarray):
    """Arrays ``(i, j)`` of rows of one group whose sizes allow the similarity; sizes ascend in a group."""
    i, d = np.arange(len(group)), 1
    while True:
        i = i[: np.searchsorted(i, len(group) - d)]
        i = i[(group[i + d] == group[i]) & (DEN * size[i] >= NUM * size[i + d])]
        if not len(i):
            return
        yield i, i + d
        d += 1


def _needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words that sets of ``a`` and ``b`` words must have."""
    return -(-NUM * (a + b) // (NUM + DEN))


def _meeting(batches):
    """Entries of a word that another entry of the word may match, by length, position and parity.

    A pair whose words before this one are the same has met there already and is passed over here.
    """
    for t, group in _whole_groups(batches, 50_000):
        size, at, marks, marks2, before, side = (t[k].to_numpy() for k in ("size", "at", "marks", "marks2", "before", "side"))
        size, at = size.astype(np.int64), at.astype(np.int64)
        live = np.zeros(len(group), bool)
        for i, j in _near_rows(group, size):
            need = _needed(size[i], size[j])
            ok = (np.minimum(size[i] - at[i], size[j] - at[j]) >= need) & ((before[i] != before[j]) | (before[i] == 0))
            odd_words = sum(np.bitwise_count((m[i] ^ m[j]).view(np.uint64)).astype(np.int64) for m in (marks, marks2))
            ok &= odd_words <= size[i] + size[j] - 2 * need
            ok &= (side[i] == 0) | (side[i] != side[j])
            live[i[ok]] = live[j[ok]] = True
        yield from t.select(["key", "side", "c", "at"]).filter(pa.array(live)).to_batches()


def _common(words: np.ndarray, first: np.ndarray, count: np.ndarray, home: np.ndarray, i: np.ndarray, j: np.ndarray):
    """Per pair of rows: number of common words, and whether the rarest of them is the row's ``home``.

    Row ``k`` has the ascending ``words[first[k] : first[k] + count[k]]``, numbered from 0 within the batch.
    """
    span = np.int64(words.max()) + 1
    keys = np.repeat(np.arange(len(first)), count) * span + words
    for at in range(0, len(i), 20_000):
        a, b = i[at : at + 20_000], j[at : at + 20_000]
        n = count[a]
        pair = np.repeat(np.arange(len(a)), n)
        w = words[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a], n)]
        sought = b[pair] * span + w
        hit = keys[np.minimum(np.searchsorted(keys, sought), len(keys) - 1)] == sought
        early = hit & (w < home[a][pair])
        yield a, b, np.bincount(pair, hit, len(a)).astype(np.int64), np.bincount(pair, early, len(a)) == 0


def _common_of_many(words: np.ndarray, count: np.ndarray, home: int):
    """As ``_common``, for all pairs of a large group, some rows at a time.

    Words of many rows are counted by products of 0/1 matrices of at most ``_CELLS`` cells, the others by listing the rows of each word.
    """
    n = len(count)
    row = np.repeat(np.arange(n), count)
    names, column, rows_of = np.unique(words, return_inverse=True, return_counts=True)
    frequent = np.argsort(-rows_of, kind="stable")[: max(1, _CELLS // n)]
    place = np.full(len(names), -1)
    place[frequent] = np.arange(len(frequent))
    dense = place[column] >= 0
    x = np.zeros((n, len(frequent)), np.float32)
    x[row[dense], place[column[dense]]] = 1
    before = names[frequent] < home  # rarer than the word they meet at
    sparse = np.flatnonzero(~dense & (rows_of[column] > 1))
    order = sparse[np.argsort(column[sparse], kind="stable")]
    first = np.searchsorted(column[order], np.arange(len(names) + 1))
    cost = np.zeros(n, np.int64)
    np.add.at(cost, row[sparse], rows_of[column[sparse]])
    at = 0
    while at < n:
        end = min(at + 256, n, max(at + 1, int(np.searchsorted(np.cumsum(cost[at:]), _CELLS // 4)) + at))
        own = sparse[(row[sparse] >= at) & (row[sparse] < end)]
        many = rows_of[column[own]]
        partner = row[order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[column[own]], many)]]
        cell, rare = np.repeat(row[own] - at, many) * n + partner, np.repeat(names[column[own]] < home, many)
        common = np.bincount(cell, minlength=(end - at) * n).reshape(-1, n) + (x[at:end] @ x.T).astype(np.int64)
        early = np.bincount(cell[rare], minlength=(end - at) * n).reshape(-1, n) + (x[at:end][:, before] @ x[:, before].T).astype(np.int64)
        a, b = np.nonzero(np.arange(n)[None, :] > np.arange(at, end)[:, None])
        yield a + at, b, common[a, b], early[a, b] == 0
        at = end


def _verified(batches):
    """Per row of a word: how many others it is similar to, and whether one of them is placed before it.

    A pair counts at its rarest common word only, so at one word and in one block of it.
    """
    for t, group in _whole_groups(batches, 4_000):
        t = t.combine_chunks()
        n = t.num_rows
        c, size, side = t["c"].to_numpy(), t["size"].to_numpy().astype(np.int64), t["side"].to_numpy()
        place = np.empty(n, np.int64)
        place[np.lexsort([t[k].to_numpy() for k in ("line", "r2", "r1", "doc_id")] + [t["no_id"].to_numpy(zero_copy_only=False)])] = np.arange(n)
        count = pc.list_value_length(t["w"]).to_numpy().astype(np.int64)
        names, words = np.unique(pc.list_flatten(t["w"]).to_numpy().view(np.uint64), return_inverse=True)
        first = np.cumsum(count) - count
        home = words[first + t["at"].to_numpy()]
        members = np.bincount(group)
        large = members[group] > 64
        i, j = (np.concatenate(x) for x in zip(*_near_rows(np.where(large, -np.arange(n) - 1, group), size), (np.zeros(0, np.int64),) * 2))
        found = list(_common(words, first, count, home, i, j))
        links, beaten = np.zeros(n, np.int64), np.zeros(n, bool)

        def add(a, b, common, here):
            ok = here & (DEN * common >= NUM * (count[a] + count[b] - common)) & ((side[a] == 0) | (side[a] != side[b])) & (home[a] == home[b])
            a, b = a[ok], b[ok]
            np.add(links, np.bincount(a, minlength=n) + np.bincount(b, minlength=n), out=links)
            beaten[np.where(place[a] > place[b], a, b)] = True

        for one in found:
            add(*one)
        starts = np.cumsum(members) - members
        for g in np.flatnonzero(members > 64):
            lo, hi = starts[g], starts[g] + members[g]
            for a, b, common, here in _common_of_many(words[first[lo] : first[hi - 1] + count[hi - 1]], count[lo:hi], home[lo]):
                add(a + lo, b + lo, common, here)
        some = links > 0
        yield pa.record_batch([pa.array(c[some]), pa.array(links[some]), pa.array(beaten[some])], names=["c", "n", "beaten"])


def _entries(classes: DataFrame) -> DataFrame:
    """``(key, side, c, size, marks, marks2, at, before)`` per set and word of its prefix.

    ``key`` is the word. One of more than ``_GROUP`` entries is cut into blocks: ``key`` is then a word and two of its blocks, ``side`` tells
    the two apart (-1 and 1; 0 within one). Words are counted one by one only where a hash bucket holds more than a group.
    """
    sets = classes.filter("size > 3")
    word = sets.select(F.explode("prefix").alias("word")).withColumn("bucket", F.expr(f"shiftright(word, 20) & {(1 << _BITS) - 1}"))
    full = word.groupBy("bucket").count().filter(F.col("count") > _GROUP).select("bucket")  # at most 2**_BITS rows
    hot = stored(
        word.join(F.broadcast(full), "bucket", "left_semi").groupBy("word").count().filter(F.col("count") > _GROUP)
        .select("word", F.ceil(F.col("count") / _GROUP).cast("int").alias("g")), "line-hot",
    )
    entries = sets.select("c", "size", "marks", "marks2", "prefix", F.posexplode("prefix").alias("at", "word")).select(
        "c", "size", "marks", "marks2", "at", "word", F.when(F.col("at") > 0, F.expr("prefix[at - 1]")).otherwise(F.lit(0)).alias("before")
    ).join(hot, "word", "left")
    own = F.pmod(F.xxhash64("c"), F.col("g")).cast("int")
    other = F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("g") - 1)))
    return entries.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other).select(
        F.when(F.col("g").isNull(), F.col("word")).otherwise(F.xxhash64("word", F.least("own", "other"), F.greatest("own", "other"))).alias("key"),
        F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "c", "size", "marks", "marks2", "at", "before",
    )


def _grouped(df: DataFrame) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key")


def _narrowed(df: DataFrame, *names: str) -> DataFrame:
    """A stored table without columns that are not needed any more: the wide one is deleted."""
    out = stored(df.drop(*names), "line-narrow")
    drop_stored(df)
    return out


def _release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that are stored by now; it waits for a collection otherwise.

    The first round frees the handles of plans, which takes a moment, the second the plans.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def distinct_sets(lines: DataFrame) -> DataFrame:
    """Distinct word sets ``(c, s1, s2, size, first, marks, marks2, prefix)`` with the place of their first line."""
    grouped = lines.groupBy("s1", "s2").agg(F.min(_place()).alias("first"), *(F.first(k).alias(k) for k in ("size", "marks", "marks2", "prefix")))
    return stored(grouped.withColumn("c", F.monotonically_increasing_id()), "line-classes")


def similar_lines(docs: DataFrame, classes: DataFrame, classes_of_words: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """``(classes, links)``: ``classes`` without the columns that only this join needs, and per set that is similar to others
    ``(c, n_links, beaten)``: their number, and whether one of them comes first.

    Each set is entered under its rarest words. Entries of a word meet in one task (a frequent word in blocks), where lengths, positions and
    parities must allow the similarity. Those that remain meet once more with all their words, where each pair is verified at its rarest common
    word. Only entries and counts are ever written, so a dense group costs rows by its size and not by its pairs.
    """
    live = stored(_grouped(_entries(classes)).mapInArrow(_meeting, "key long, side int, c long, at int"), "line-entries")
    classes = _narrowed(classes, "marks", "marks2", "prefix")
    _release(docs.sparkSession)
    asked = live.groupBy("c").agg(F.collect_list(F.struct("key", "side", "at")).alias("entries"))  # at most a prefix and its blocks
    wanted = stored(asked.join(classes, "c").select("c", "size", "first.*", "entries"), "line-wanted")
    spot = F.expr(f"((r1 & {_SPOTS - 1}) + bigint(line) * {_STEP} & {_SPOTS - 1}) + 1")  # maps count from 1
    bits = np.zeros(_SPOTS // 8, np.uint8)
    maps = wanted.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    for k, part in maps.collect():  # a fixed number of maps of 4 KB
        bits[(k - 1) * 4096 : k * 4096] = np.frombuffer(part, np.uint8)

    def take(batches):
        gram = Gram(31)
        for batch in batches:
            r1, r2, texts = batch["r1"].to_numpy(), batch["r2"].to_numpy(), batch["text"].to_pylist()
            for part in portions(texts, _TEXT):
                rows, number, of = [], [], []
                for k, text in enumerate(texts[part], part.start):
                    spots = (int(r1[k]) & _SPOTS - 1) + np.arange(text.count("\n") + 1) * _STEP & _SPOTS - 1
                    here = np.flatnonzero(bits[spots >> 3] >> (spots & 7) & 1)
                    if len(here):
                        own = text.split("\n")
                        rows += [own[x] for x in here]
                        number.append(here)
                        of.append(np.full(len(here), k))
                if rows:
                    hashes, line_of, _, _ = _words(rows, gram)
                    ids = _ids(hashes, classes_of_words)
                    order = np.lexsort((ids, line_of))
                    ids, line_of = ids[order], line_of[order]
                    new = np.ones(len(ids), bool)
                    new[1:] = (ids[1:] != ids[:-1]) | (line_of[1:] != line_of[:-1])
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(line_of[new], minlength=len(rows)))]).astype(np.int32)
                    of = np.concatenate(of)
                    yield pa.record_batch([
                        pa.array(r1[of]), pa.array(r2[of]), pa.array(np.concatenate(number).astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[new].view(np.int64))),
                    ], names=["r1", "r2", "line", "w"])

    words = _keyed(docs).filter("text is not null").mapInArrow(take, "r1 long, r2 long, line int, w array<long>")
    whole = wanted.join(words.dropDuplicates(["r1", "r2", "line"]), ["r1", "r2", "line"]).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    parts = _grouped(whole.select("*", F.inline("entries")).drop("entries")).mapInArrow(_verified, "c long, n long, beaten boolean")
    links = stored(parts.groupBy("c").agg(F.sum("n").alias("n_links"), F.max("beaten").alias("beaten")), "line-links")
    drop_stored(live)
    drop_stored(wanted)
    _release(docs.sparkSession)
    return classes, links


def judged_lines(docs: DataFrame) -> DataFrame:
    """One row per line with a word: ``r1, r2, doc_id, line, size, class_doc, class_line, n_links, kept``.

    Two lines are similar if the Jaccard similarity of their word sets is 4/5 or more. A line is kept if no similar line comes before it, in order
    of ``doc_id`` (null last) and line. ``class_*`` is the first line with the same word set, ``n_links`` the number of other
    word sets it is similar to. Rows alike in ``doc_id`` and ``text`` are one document and judged alike.
    """
    rarity = word_classes(docs)
    lines = stored(line_table(docs, rarity), "lines")
    classes = distinct_sets(lines)
    lines = _narrowed(lines, "marks", "marks2", "prefix")
    _release(docs.sparkSession)
    classes, links = similar_lines(docs, classes, rarity)
    verdicts = classes.select("c", "s1", "s2", "first").join(links, "c", "left").select(
        "s1", "s2", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"), (~F.coalesce("beaten", F.lit(False))).alias("leads")
    )
    return lines.join(verdicts, ["s1", "s2"]).select(
        "r1", "r2", "doc_id", "line", "size", F.col("first.doc_id").alias("class_doc"), F.col("first.line").alias("class_line"), "n_links",
        (F.col("leads") & (F.col("first") == _place())).alias("kept"),
    )


def drop_similar_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that come after a similar one; a document that loses all its words goes.

    Lines without a word stay where another line does. All columns are kept; ``n_chars``, if there, follows the text.
    """
    gone = judged_lines(docs).filter("not kept").groupBy("r1", "r2").agg(F.collect_set("line").alias("gone"))
    r1, r2, own = fresh(docs, "r1"), fresh(docs, "r2"), fresh(docs, "gone")
    keyed = docs.withColumns({r1: F.xxhash64("doc_id", "text"), r2: F.xxhash64(F.lit("second"), "text", "doc_id")})
    out = keyed.join(gone.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("gone").alias(own)), [r1, r2], "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(own, i)), "\n")
    cut = F.col(own).isNotNull()
    out = out.withColumn("text", F.when(cut, left).otherwise(F.col("text"))).filter(~cut | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("r1", "r2")
