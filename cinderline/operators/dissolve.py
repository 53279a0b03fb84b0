"""Polygons of a group put together: borders that two of them share go, and what is left is assembled to rings."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderline.operators.overlay import TURN, oriented
from cinderline.operators.spatial import edges, grid_pieces, point_in_polygon
from cinderline.sources.tables import cut_lineage

_ENDS = ["x1", "y1", "x2", "y2"]


def _cancel(e: DataFrame) -> DataFrame:
    """Edges without those that another one runs along the other way. Counted map-side, by edge."""
    back = "x1 > x2 or (x1 = x2 and y1 > y2)"
    one_way = e.where("x1 <> x2 or y1 <> y2").select(
        "g", *[F.expr(f"case when {back} then {c}{3 - n} else {c}{n} end").alias(f"{c}{n}") for n in (1, 2) for c in "xy"],
        F.expr(f"case when {back} then -1 else 1 end").alias("way"),
    )
    left = one_way.groupBy("g", *_ENDS).agg(F.sum("way").alias("way")).where("way <> 0")
    return left.select("g", *[F.expr(f"case when way < 0 then {c}{3 - n} else {c}{n} end").alias(f"{c}{n}") for n in (1, 2) for c in "xy"])


def _cut_at_vertices(e: DataFrame, tile: float, tolerance: float) -> DataFrame:
    """Edges cut at every vertex of their group that lies on them.

    Edges and vertices meet in tiles; a vertex at a tile's border goes to the tiles on both sides.
    """
    near = lambda v: f"array_distinct(array(cast(floor(({v} - {tolerance!r}D) / {tile!r}D) as bigint), cast(floor(({v} + {tolerance!r}D) / {tile!r}D) as bigint)))"
    points = (
        e.selectExpr("g", "x1 as x", "y1 as y").distinct()
        .withColumn("cx", F.expr(f"explode({near('x')})")).withColumn("cy", F.expr(f"explode({near('y')})"))
    )
    on = (
        f"abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) <= {tolerance!r}D * hypot(x2 - x1, y2 - y1) "
        f"and (x2 - x1) * (x - x1) + (y2 - y1) * (y - y1) > {tolerance!r}D * hypot(x2 - x1, y2 - y1) "
        f"and (x2 - x1) * (x2 - x) + (y2 - y1) * (y2 - y) > {tolerance!r}D * hypot(x2 - x1, y2 - y1)"
    )
    met = grid_pieces(e, tile).drop("__p").join(points, ["g", "cx", "cy"]).where(on).select("g", *_ENDS, "x", "y").distinct()
    along = "transform(array_sort(collect_list(named_struct('t', (x2 - x1) * (x - x1) + (y2 - y1) * (y - y1), 'x', x, 'y', y))), p -> named_struct('x', p.x, 'y', p.y))"
    stops = met.groupBy("g", *_ENDS).agg(F.expr(f"{along} as stops"))
    path = "concat(array(named_struct('x', x1, 'y', y1)), stops, array(named_struct('x', x2, 'y', y2)))"
    parts = stops.withColumn("p", F.expr(path)).select("g", F.expr("explode(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> named_struct('a', a, 'b', b))) as s"))
    whole = e.join(stops, ["g", *_ENDS], "left_anti")
    return whole.unionByName(parts.selectExpr("g", "s.a.x as x1", "s.a.y as y1", "s.b.x as x2", "s.b.y as y2"))


def _following(e: DataFrame) -> DataFrame:
    """``id, ptr``: the edge that goes on from the end of each edge, along the same piece of the inside.

    Round a vertex, the inside left of an edge that comes in reaches clockwise to the next edge that goes out.
    """
    out = e.selectExpr("g", "x1 as x", "y1 as y", "atan2(y2 - y1, x2 - x1) as angle", "id", "true as leaves")
    into = e.selectExpr("g", "x2 as x", "y2 as y", "atan2(y1 - y2, x1 - x2) as angle", "id", "false as leaves")
    at = Window.partitionBy("g", "x", "y").orderBy("angle", "leaves")
    leaving = F.when(F.col("leaves"), F.col("id"))
    before = F.last(leaving, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    wrapped = F.last(leaving, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.unionByName(into).withColumn("ptr", F.coalesce(before, wrapped)).where("not leaves").select("id", "ptr")


def cycles(following: DataFrame) -> DataFrame:
    """List ranking of the cycles of a permutation ``id, ptr``: ``id, cycle, ahead``.

    ``cycle`` is the least id of the cycle and ``ahead`` the number of steps to it. Pointer jumping: each round joins every id with the
    one as far ahead as it has seen, so a cycle of n ids takes about log2(n) rounds. All joins are on unique ids.
    """
    state, span = cut_lineage(following.selectExpr("id", "ptr", "id as cycle", "0L as ahead", "true as moved")), 1
    while not state.where("moved").isEmpty():
        far = state.selectExpr("id as ptr", "ptr as ptr2", "cycle as cycle2", "ahead as ahead2")
        state = cut_lineage(state.join(far, "ptr").selectExpr(
            "id", "ptr2 as ptr", "least(cycle, cycle2) as cycle",
            f"case when cycle2 < cycle then {span}L + ahead2 else ahead end as ahead", "cycle2 < cycle as moved",
        ))
        span *= 2
    return state.select("id", "cycle", "ahead")


def dissolve_polygons(
    polys: DataFrame, keys: Sequence[str], geom: str = "geom", tile: float = 50000.0, tolerance: float = 1e-6, strip: float = 100000.0,
) -> DataFrame:
    """One row per group: ``keys, geom``, the polygons of the group put together, with holes.

    Shared borders go also where only one of the neighbours has a vertex (within ``tolerance``). Each polygon of the result is a closed
    ring counterclockwise and its holes clockwise; parts that touch in a point are polygons of their own, and a hole that touches the outside in a
    point is part of the outer ring. Polygons of a group may touch but not overlap; exact copies count once. Null keys are a
    group; groups without an area (null and empty geometries) have no row. ``tile`` deals out the search for vertices on edges: take it
    so that a few thousand edges meet in one.

    Edges are cancelled by counting and rings found by pointer jumping, so only the finished rings of a group meet in one row.
    """
    polys = polys.select(F.struct(*keys).alias("g"), F.col(geom).alias("geom")).distinct()
    single = cut_lineage(_cancel(edges(oriented(polys, "g", "geom"), "g")))
    kept = cut_lineage(_cancel(_cut_at_vertices(single, tile, tolerance)).withColumn("id", F.monotonically_increasing_id()))
    following = cut_lineage(_following(kept))
    if not following.groupBy("ptr").count().where("ptr is null or count > 1").isEmpty():
        raise ValueError("polygons of a group overlap: their borders do not close to rings")
    rings = (
        cycles(following).join(kept, "id").groupBy("g", "cycle")
        .agg(F.expr("array_sort(collect_list(named_struct('o', case when ahead = 0 then 0 else 1 end, 'n', -ahead, 'x', x1, 'y', y1))) as r"))
        .selectExpr("g", "cycle", "transform(r, p -> named_struct('x', p.x, 'y', p.y)) as r")
    )
    rings = cut_lineage(rings.selectExpr("g", "cycle", "concat(r, slice(r, 1, 1)) as ring", f"{TURN} as turn"))
    shells = rings.where("turn > 0").selectExpr("g", "cycle as shell", "turn", "array(array(ring)) as geom")
    holes = rings.where("turn < 0").selectExpr("g as hole_of", "cycle as hole", "ring", "(ring[0].x + ring[1].x) / 2 as x", "(ring[0].y + ring[1].y) / 2 as y")
    inside = (
        point_in_polygon(holes, shells, "shell", strip, attributes=["g", "turn"]).where("g <=> hole_of")
        .groupBy("hole").agg(F.min_by("shell", F.struct("turn", "shell")).alias("shell"), F.first("ring").alias("ring"))
        .groupBy("shell").agg(F.expr("transform(array_sort(collect_list(named_struct('hole', hole, 'ring', ring))), h -> h.ring) as holes"))
    )
    parts = shells.join(inside, "shell", "left").select("g", "shell", F.expr("concat(geom[0], coalesce(holes, cast(array() as array<array<struct<x: double, y: double>>>))) as part"))
    whole = parts.groupBy("g").agg(F.expr("transform(array_sort(collect_list(named_struct('shell', shell, 'part', part))), p -> p.part) as geom"))
    return whole.select("g.*", "geom")
