"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.llm.common import drop_stored, stored


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges ``(a, b)`` with ``a > b``.

    The least neighbour of each node is found by a pre-aggregated minimum and joined back, so a hub's links are never
    gathered in one task.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = (
        both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a > b").distinct()
    )
    own = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = (
        large.join(own, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionAll(own.select(F.col("u").alias("a"), F.col("m").alias("b")))
    )
    return small.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``: the least id reachable. Self-links and repeats are allowed.

    Alternating stars until nothing changes (about the logarithm of the longest chain), each round written to the
    shared folder. Null ends are ignored.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).alias("mark")
    edges = stored(
        links.dropna(subset=["a", "b"]).filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges",
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    seen, now = None, edges.agg(mark).first()[0]
    current = edges
    while now != seen:
        following = stored(_star(current), "star")
        if current is not edges:
            drop_stored(current)
        current, seen, now = following, now, following.agg(mark).first()[0]
    return nodes.join(current, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))
