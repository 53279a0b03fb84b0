"""Conversation prefix trie: a z-fast trie over sequences of turns, built in batches and read out node by node."""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderline.llm.common import stored, table

_MASK = (1 << 32) - 1
#: Ids of one string that is hashed piece by piece.
_PIECE = 50_000


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``df`` with running sums per ``key`` in the given order, without gathering a key's rows in one task.

    Rows are dealt by ranges of key and order. Sums run inside a range; a key that goes on in a later range (at most two a range)
    gets what came before from a table of as many rows as there are ranges.
    """
    ranges = stored(df.repartitionByRange(F.col(key), *order).withColumn("range", F.spark_partition_id()), label)
    totals = ranges.groupBy(key, "range").agg(*(F.sum(c).alias(f"before_{n}") for n, c in sums.items()), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "range", *(F.sum(f"before_{n}").over(earlier).alias(f"before_{n}") for n in sums)).dropna()
    own = Window.partitionBy("range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.join(F.broadcast(before), [key, "range"], "left")
    add = {n: F.sum(c).over(own) + F.coalesce(F.col(f"before_{n}"), F.lit(0)) for n, c in sums.items()}
    return out.select(*df.columns, *(c.alias(n) for n, c in add.items()))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, t1, t2, chars)``: turns in order of ``turn`` (null first; ties by role and text) from 1, as two hashes and code points.

    Null roles and texts are empty. Rows without a ``conv_id`` take no part; repeated rows are turns of their own.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).filter("conv_id is not null")
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("row")]
    placed = running(turns, "conv_id", order, {"pos": F.lit(1)}, "turns")
    return placed.select(
        "conv_id", "pos", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("second"), "text", "role").alias("t2"), F.length("text").cast("long").alias("chars")
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, s1, s2, chars)`` for turns ``(conv_id, depth, t1, t2, chars)``: 128 bits that stand for the first ``depth`` turns.

    They are sums of hashes of place and turn in four counters modulo 2**32, so any range of turns can be summed by itself.
    """
    one, two = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "depth", "t1")
    parts = {f"w{i}": F.shiftright(h, s).bitwiseAND(_MASK) for i, (h, s) in enumerate(((one, 0), (one, 32), (two, 0), (two, 32)))}
    summed = running(turns.withColumns(parts), "conv_id", [F.col("depth")], {f"sum{i}": F.col(f"w{i}") for i in range(4)} | {"upto": F.col("chars")}, "rebuilt")
    pair = lambda low, high: F.shiftleft(F.col(high).bitwiseAND(_MASK), 32).bitwiseOR(F.col(low).bitwiseAND(_MASK))
    return summed.select("conv_id", "depth", pair("sum0", "sum1").alias("s1"), pair("sum2", "sum3").alias("s2"), F.col("upto").alias("chars"))


def _fattest(a: str, b: str) -> Column:
    """The number in ``(a, b]`` that is divisible by the largest power of two."""
    return F.expr(f"shiftleft(shiftright({b}, length(bin({a} ^ {b})) - 1), length(bin({a} ^ {b})) - 1)")


class Trie:
    """Compacted nodes in a table, hashed by their handles and by their names.

    A node stands for the turns after its parent's depth ``p`` down to its own depth ``e``. Its extent (the turns from the root to
    ``e``) has the hash ``n1, n2``, its parent's extent ``q1, q2``; ``rep`` is a sequence that runs through it. The handle is the extent's prefix at
    the two-fattest depth ``f`` in ``(p, e]``, hashed ``f1, f2``; the name is its prefix at ``p + 1``, hashed ``a1, a2``.

    ``texts`` has a row ``(c, d, s1, s2, chars)`` per prefix of each distinct sequence, so sequences of any length are never put in one row.
    """

    def __init__(self, texts: DataFrame):
        self.texts = texts
        self.nodes = self._root(texts.sparkSession)
        self.empty = True

    @staticmethod
    def _root(spark: SparkSession) -> DataFrame:
        return spark.range(1).select(
            F.lit(0).cast("long").alias("e"), *(F.lit(0).cast("long").alias(k) for k in ("n1", "n2")), F.lit(-1).cast("long").alias("p"),
            *(F.lit(0).cast("long").alias(k) for k in ("q1", "q2", "rep", "f", "f1", "f2", "a1", "a2")),
        )

    def _at(self, df: DataFrame, c: str, d: str, names: tuple[str, str], how: str = "inner") -> DataFrame:
        """The hash of sequence ``c`` at depth ``d`` as two columns."""
        t = self.texts.select(F.col("c").alias("_c"), F.col("d").alias("_d"), F.col("s1").alias(names[0]), F.col("s2").alias(names[1]))
        return df.join(t, (F.col(c) == F.col("_c")) & (F.col(d) == F.col("_d")), how).drop("_c", "_d")

    def search(self, asked: DataFrame) -> DataFrame:
        """Where sequences ``(c, len, a)``, with a node on their path at depth ``a``, leave the trie.

        Adds the depth ``x`` down to which they follow it, and the node inside whose turns they leave (``ee, e1, e2, rep``; null if they
        leave at a node). A fat binary search asks for one handle per step and halves the depths that are left.
        """
        found = ["ne", "n1", "n2", "nrep", "nf"]
        state = asked.select("c", "len", F.col("a").alias("start"), "a", F.col("len").alias("b"), *(F.lit(None).cast("long").alias(k) for k in found))
        handles = self.nodes.filter("e > 0").select("f", F.col("f1").alias("s1"), F.col("f2").alias("s2"), F.col("e").alias("me"), F.col("n1").alias("m1"), F.col("n2").alias("m2"), F.col("rep").alias("mrep"))
        open_ = not self.empty
        while open_:
            probe = self._at(state.filter("a < b").withColumn("f", _fattest("a", "b")), "c", "f", ("s1", "s2")).join(handles, ["f", "s1", "s2"], "left")
            hit = F.col("me").isNotNull()
            stepped = probe.select(
                "c", "len", "start", F.coalesce("me", "a").alias("a"), F.when(hit, F.col("b")).otherwise(F.col("f") - 1).alias("b"),
                *(F.when(hit, F.col(m)).otherwise(F.col(k)).alias(k) for k, m in zip(found, ("me", "m1", "m2", "mrep", "f"))),
            )
            state = stored(stepped.unionByName(state.filter("a >= b")), "trie-search")
            open_ = not state.filter("a < b").isEmpty()
        # The last handle found is the exit node's unless its whole extent is a prefix; then a child may be the exit node.
        last = self._at(state, "c", "ne", ("s1", "s2"), "left")
        whole = F.coalesce((F.col("s1") == F.col("n1")) & (F.col("s2") == F.col("n2")), F.lit(False))
        last = last.select(
            "c", "len", F.when(whole, F.col("ne")).when(F.col("ne").isNull(), F.col("start")).alias("g"),
            *(F.when(~whole, F.col(k)).alias(k) for k in found),
        ).withColumn("next", F.col("g") + 1)
        names = self.nodes.filter("e > 0").select((F.col("p") + 1).alias("next"), F.col("a1").alias("s1"), F.col("a2").alias("s2"), F.col("e").alias("me"), F.col("n1").alias("m1"), F.col("n2").alias("m2"), F.col("rep").alias("mrep"))
        child = self._at(last.filter("next <= len"), "c", "next", ("s1", "s2")).join(names, ["next", "s1", "s2"], "left")
        exits = child.select("c", "len", "g", F.col("me").alias("ee"), F.col("m1").alias("e1"), F.col("m2").alias("e2"), F.col("mrep").alias("rep"), F.when(F.col("me").isNotNull(), F.col("next")).alias("low"))
        rest = last.filter("next is null or next > len").select("c", "len", "g", F.col("ne").alias("ee"), F.col("n1").alias("e1"), F.col("n2").alias("e2"), F.col("nrep").alias("rep"), F.col("nf").alias("low"))
        exits = stored(exits.unionByName(rest), "trie-exits")
        # Inside a node's turns: as many more as agree with those of its representative.
        mine = self.texts.select("c", "d", "s1", "s2")
        theirs = self.texts.select(F.col("c").alias("rep"), "d", F.col("s1").alias("r1"), F.col("s2").alias("r2"))
        inside = exits.filter("ee is not null").select("c", "rep", "low", "ee").join(mine, "c").filter("d > low and d <= ee")
        same = inside.join(theirs, ["rep", "d"]).filter("s1 = r1 and s2 = r2").groupBy("c").agg(F.count(F.lit(1)).alias("more"))
        return exits.join(same, "c", "left").withColumn("x", F.when(F.col("ee").isNull(), F.col("g")).otherwise(F.col("low") + F.coalesce("more", F.lit(0))))

    def _hashed(self, nodes: DataFrame) -> DataFrame:
        nodes = nodes.withColumn("f", _fattest("p", "e")).withColumn("next", F.col("p") + 1)
        return self._at(self._at(nodes, "rep", "f", ("f1", "f2")), "rep", "next", ("a1", "a2")).select(*self.nodes.columns)

    def insert(self, batch: DataFrame) -> DataFrame:
        """Insert what fits of the sequences ``(c, len, a)``; the others come back with a deeper ``a``.

        All sequences leave the trie by one search. Nodes are cut at every depth where one leaves inside; of those that go on
        with the same turn at the same place one, chosen by a hash, becomes a leaf, and the others meet it in the next batch. The expected
        number of batches is the logarithm of the largest group.
        """
        out = self._at(self.search(batch), "c", "x", ("x1", "x2"), "left").fillna(0, ["x1", "x2"]).withColumn("next", F.col("x") + 1)
        out = stored(self._at(out, "c", "next", ("y1", "y2"), "left"), "trie-batch")
        cuts = out.filter("ee is not null").select("ee", "e1", "e2", "x", "x1", "x2").distinct()
        edges = self.nodes.join(cuts, (F.col("e") == F.col("ee")) & (F.col("n1") == F.col("e1")) & (F.col("n2") == F.col("e2"))).drop("f", "f1", "f2", "a1", "a2")
        up = Window.partitionBy("e", "n1", "n2").orderBy("x")
        above = F.lag(F.struct(F.col("x").alias("p"), F.col("x1").alias("q1"), F.col("x2").alias("q2"))).over(up)
        upper = edges.withColumn("above", F.coalesce(above, F.struct("p", "q1", "q2"))).select(F.col("x").alias("e"), F.col("x1").alias("n1"), F.col("x2").alias("n2"), "above.*", "rep")
        lowest = edges.groupBy("e", "n1", "n2", "rep").agg(F.max(F.struct(F.col("x").alias("p"), F.col("x1").alias("q1"), F.col("x2").alias("q2"))).alias("above"))
        lowest = lowest.select("e", "n1", "n2", "above.*", "rep")
        place = [F.col("x").alias("p"), F.col("x1").alias("q1"), F.col("x2").alias("q2")]
        chosen = out.filter("x < len").groupBy(*place, "y1", "y2").agg(F.min(F.struct(F.xxhash64("c").alias("h"), "c", "len")).alias("one"))
        chosen = stored(chosen.select("p", "q1", "q2", F.col("one.c").alias("rep"), F.col("one.len").alias("e")), "trie-leaves")
        leaves = self._at(chosen, "rep", "e", ("n1", "n2")).select("e", "n1", "n2", "p", "q1", "q2", "rep")
        new = self._hashed(upper.unionByName(lowest).unionByName(leaves))
        kept = self.nodes.join(cuts.select(F.col("ee").alias("e"), F.col("e1").alias("n1"), F.col("e2").alias("n2")).distinct(), ["e", "n1", "n2"], "left_anti")
        self.nodes, self.empty = stored(kept.select(*self.nodes.columns).unionByName(new), "trie-nodes"), False
        return stored(out.filter("x < len").join(chosen.select(F.col("rep").alias("c")), "c", "left_anti").select("c", "len", F.col("x").alias("a")), "trie-pending")


def _subtree(ups: list[DataFrame], values: DataFrame, sums: list[str], least: list[str] = ()) -> DataFrame:
    """Sums and minima over all nodes below (itself included), by doubling: ``ups[k]`` leads ``2**k`` levels up."""
    for up in ups:
        add = up.join(values, "id").groupBy(F.col("up").alias("id")).agg(*(F.sum(k).alias(f"_{k}") for k in sums), *(F.min(k).alias(f"_{k}") for k in least))
        values = stored(values.join(add, "id", "left").select(
            "id", *((F.col(k) + F.coalesce(f"_{k}", F.lit(0))).alias(k) for k in sums), *(F.least(k, f"_{k}").alias(k) for k in least)
        ), "trie-sums")
    return values


def _id_hashes(ends: DataFrame) -> DataFrame:
    """``(id, sha)`` for ``(id, conv_id, many)``: the SHA-256 of the ids of each node, ascending and comma-joined.

    A node's ids are joined in pieces of bounded size by ranges; then one task feeds a node's pieces to the hash in order, one at a time.
    """
    single = ends.filter("not many").select("id", F.sha2(F.col("conv_id").cast("string"), 256).alias("sha"))

    def join(batches):
        for batch in batches:
            nodes, convs = batch["id"].to_pylist(), batch["conv_id"].to_pylist()
            start = 0
            for i in range(1, len(nodes) + 1):
                if i == len(nodes) or nodes[i] != nodes[start] or i - start == _PIECE:
                    yield pa.record_batch([pa.array([nodes[start]]), pa.array([convs[start]]), pa.array([",".join(map(str, convs[start:i]))])], names=["id", "first", "ids"])
                    start = i

    def feed(batches):
        node = digest = None
        for batch in batches:
            for n, ids in zip(batch["id"].to_pylist(), batch["ids"].to_pylist()):
                if n != node:
                    if digest:
                        yield pa.record_batch([pa.array([node]), pa.array([digest.hexdigest()])], names=["id", "sha"])
                    node, digest = n, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if digest:
            yield pa.record_batch([pa.array([node]), pa.array([digest.hexdigest()])], names=["id", "sha"])

    pieces = ends.filter("many").select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(join, "id long, first long, ids string")
    several = pieces.repartition("id").sortWithinPartitions("id", "first").mapInArrow(feed, "id long, sha string")
    return single.unionByName(several)


def conversation_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: ``convs(conv_id, len)`` with ``turns(conv_id, depth, t1, t2, chars)``, depth from 1 to ``len``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. Turns are alike if their 128-bit hashes are. Equal conversations are one sequence with a weight; no
    group of conversations or turns is gathered. No conversation: no row.
    """
    spark = convs.sparkSession
    before = stored(prefixes(turns), "prefixes")
    full = convs.join(before.select("conv_id", F.col("depth").alias("len"), "s1", "s2"), ["conv_id", "len"], "left").fillna(0, ["s1", "s2"])
    full = stored(full.select("conv_id", "len", "s1", "s2"), "sequences")
    classes = stored(full.groupBy("len", "s1", "s2").agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")), "classes")
    texts = stored(before.join(classes.select(F.col("c").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "s1", "s2", "chars"), "texts")
    trie = Trie(texts)
    pending = classes.filter("len > 0").select("c", "len", F.lit(0).cast("long").alias("a"))
    while not pending.isEmpty():
        pending = trie.insert(pending)

    nodes = stored(trie.nodes.select("e", "n1", "n2", "p", "q1", "q2", "rep", F.monotonically_increasing_id().alias("id")), "trie")
    key = lambda i, e, a, b: nodes.select(F.col("id").alias(i), F.col("e").alias(e), F.col("n1").alias(a), F.col("n2").alias(b))
    chars = lambda d, name: texts.select(F.col("c").alias("rep"), F.col("d").alias(d), F.col("chars").alias(name))
    kids = nodes.groupBy(F.col("p").alias("e"), F.col("q1").alias("n1"), F.col("q2").alias("n2")).agg(F.count(F.lit(1)).alias("kids"))
    ended = classes.select(F.col("len").alias("e"), F.col("s1").alias("n1"), F.col("s2").alias("n2"), F.col("c").alias("first"), "n")
    nodes = stored(
        nodes.join(key("up", "p", "q1", "q2"), ["p", "q1", "q2"], "left").join(kids, ["e", "n1", "n2"], "left").join(ended, ["e", "n1", "n2"], "left")
        .join(chars("e", "ce"), ["rep", "e"], "left").join(chars("p", "cp"), ["rep", "p"], "left").fillna(0, ["kids", "n", "ce", "cp"]), "trie-rows",
    )
    up, ups = nodes.filter("up is not null").select("id", "up"), []
    while not up.isEmpty():
        ups.append(stored(up, "trie-up"))
        up = ups[-1].join(ups[-1].select(F.col("id").alias("up"), F.col("up").alias("above")), "up").select("id", F.col("above").alias("up"))
    leaf = F.when(F.col("kids") == 0, 1).otherwise(0).cast("long").alias("leaves")
    counts = _subtree(ups, nodes.select("id", F.col("n").alias("convs"), leaf, "first"), ["convs", "leaves"], ["first"])
    counted = stored(nodes.drop("first", "n").join(counts, "id"), "trie-counts")
    saved = _subtree(ups, counted.select("id", F.when(F.col("e") > 0, (F.col("convs") - 1) * (F.col("ce") - F.col("cp"))).otherwise(F.lit(0)).alias("saved")), ["saved"])
    ids = full.join(key("id", "len", "s1", "s2"), ["len", "s1", "s2"]).join(classes.select("len", "s1", "s2", (F.col("n") > 1).alias("many")), ["len", "s1", "s2"])
    sha = _id_hashes(stored(ids.select("id", "conv_id", "many"), "ends"))
    done = counted.join(saved, "id").join(sha, "id", "left").join(counts.select(F.col("id").alias("up"), F.col("first").alias("up_first")), "up", "left")

    nothing = hashlib.sha256(b"").hexdigest()
    lowest = F.col("depth") == F.col("e")
    last = lambda of_node, inner: F.when(lowest, F.col(of_node)).otherwise(F.lit(inner))
    opened = done.filter("e > 0").withColumn("depth", F.explode(F.sequence(F.col("p") + 1, F.col("e")))).withColumn("above", F.col("depth") - 1)
    opened = opened.join(chars("above", "ca"), ["rep", "above"], "left").fillna(0, ["ca"])
    rows = opened.select(
        F.col("first").alias("conv_id"), "depth", F.when(F.col("above") == F.col("p"), F.col("up_first")).otherwise(F.col("first")).alias("parent_conv_id"),
        F.col("convs").alias("n_convs"), last("kids", 1).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("convs") - 1) * (F.col("ca") - F.col("cp"))).alias("saved_tokens"), F.coalesce(last("sha", nothing), F.lit(nothing)).alias("ends_sha256"),
    )
    root = done.filter("e = 0 and convs > 0").select(
        F.col("first").alias("conv_id"), F.col("e").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"),
    )
    return rows.unionByName(root)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(convs, turns)`` of the rebuilt conversations: the first turns of conversation ``c - c % 100``, then the own ones after as many.

    ``turns`` are those of ``numbered_turns``. How many is ``crc32`` of the id modulo 6.
    """
    turns = stored(turns, "numbered")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("in_base")), "base", "left")
    convs = stored(convs.withColumn("k", F.least("h", F.coalesce("in_base", F.lit(0)))).withColumn("len", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "conversations")
    first = turns.filter("pos < 6 and conv_id % 100 = 0").withColumnRenamed("conv_id", "base")  # at most five rows a base
    heads = convs.select("conv_id", "base", "k").join(first, "base").filter("pos <= k").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "chars")
    tails = turns.filter(F.col("pos") > head).join(convs.select("conv_id", "k", "h"), "conv_id").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "t1", "t2", "chars")
    return convs.select("conv_id", "len"), heads.unionByName(tails)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations"))))
