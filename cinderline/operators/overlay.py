"""Exact areas: polygons cut by tiles, the area of each in a tile, and the overlap of two layers.

A tile is only a unit of work. A polygon in a tile is the pieces of its edges there and, on the tile's left border, the stretches where the
border is inside: with these, whether a point is inside follows from what lies to its left in the same tile.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderline.operators.spatial import edges, grid_pieces
from cinderline.sources.tables import cut_lineage

#: Edges of one layer that meet in one task; more of them in a tile are dealt over several, by polygon.
_EDGES = 20_000
#: Edges of polygon pairs that are swept together.
_SWEEP = 200_000


def tile_pieces(polys: DataFrame, key: str, tile: float, x0: float = 0.0, y0: float = 0.0, geom: str = "geom") -> DataFrame:
    """``key, cx, cy, x1, y1, x2, y2, border``: edge pieces (none horizontal) and inside stretches of left borders (``border``).

    The even-odd rule holds over all rings of a polygon. Null and empty geometries have no piece.
    """
    e = edges(polys, key, geom)
    at = lambda c, t: f"{c}1 + {t} * ({c}2 - {c}1)"
    end = lambda c, t, other: f"case when {t} = {other} then {c}{2 if other else 1} else {at(c, t)} end"
    pieces = grid_pieces(e.where("y1 <> y2"), tile, x0, y0).selectExpr(
        f"`{key}`", "cx", "cy", f"{end('x', '__p.a', 0)} as px1", f"{end('y', '__p.a', 0)} as py1", f"{end('x', '__p.b', 1)} as px2", f"{end('y', '__p.b', 1)} as py2",
    ).where("py1 <> py2").selectExpr(f"`{key}`", "cx", "cy", "px1 as x1", "py1 as y1", "px2 as x2", "py2 as y2", "false as border")
    line = lambda v: f"cast(floor(({v} - {x0!r}D) / {tile!r}D) as bigint)"
    row = lambda v: f"cast(floor(({v} - {y0!r}D) / {tile!r}D) as bigint)"
    # A line is crossed where one end is left of it and the other is not.
    crossed = e.where(f"{line('x1')} <> {line('x2')}").withColumn("cx", F.expr(f"explode(sequence({line('least(x1, x2)')} + 1, {line('greatest(x1, x2)')}))"))
    crossed = crossed.withColumn("x", F.expr(f"{x0!r}D + cx * {tile!r}D")).selectExpr(f"`{key}`", "cx", "x", "y1 + (x - x1) * (y2 - y1) / (x2 - x1) as y")
    along = Window.partitionBy(key, "cx").orderBy("y")
    inside = crossed.withColumns({"n": F.row_number().over(along), "to": F.lead("y").over(along)}).where("n % 2 = 1 and to > y")
    borders = inside.withColumn("cy", F.expr(f"explode(sequence({row('y')}, {row('to')}))")).selectExpr(
        f"`{key}`", "cx", "cy", "x as x1", f"greatest(y, {y0!r}D + cy * {tile!r}D) as y1", "x as x2", f"least(to, {y0!r}D + (cy + 1) * {tile!r}D) as y2", "true as border",
    ).where("y2 > y1")
    return pieces.unionByName(borders)


#: Twice the signed area of a ring ``r``, positive where it runs counterclockwise.
TURN = "aggregate(zip_with(r, concat(slice(r, 2, greatest(size(r) - 1, 0)), slice(r, 1, 1)), (a, b) -> (a.x - r[0].x) * (b.y - r[0].y) - (b.x - r[0].x) * (a.y - r[0].y)), 0D, (s, v) -> s + v)"


def oriented(polys: DataFrame, key: str, geom: str) -> DataFrame:
    """Polygons whose rings run so that the inside lies to the left: first rings counterclockwise, holes clockwise."""
    ring = f"case when size(r) > 0 and ({TURN} < 0) = (i = 0) then reverse(r) else r end"
    return polys.select(key, F.expr(f"transform(`{geom}`, p -> transform(p, (r, i) -> {ring}))").alias("geom"))


def cover_area(polys: DataFrame, key: str, size: float, x0: float = 0.0, y0: float = 0.0, geom: str = "geom") -> DataFrame:
    """``key, cx, cy, area``: every grid cell that a polygon covers some of, with the covered area, exact but for rounding.

    A boundary integral: each edge piece adds or takes away what lies to its right in the cell, and a left border adds the cell's width
    where it is inside. Rings of one polygon must not overlap but for holes in their first ring.
    """
    right = f"({x0!r}D + (cx + 1) * {size!r}D)"
    p = tile_pieces(oriented(polys, key, geom), key, size, x0, y0)
    share = F.expr(f"case when border then (y2 - y1) * {size!r}D else (y1 - y2) * ({right} - (x1 + x2) / 2) end")
    return p.groupBy(key, "cx", "cy").agg(F.sum(share).alias("area")).where(f"area > {size * size * 1e-9!r}D")


# --- overlap of two layers -----------------------------------------------------------------------------

def _strip_areas(slab, low, high, side, height, right, n):
    """Area per slab where both layers are inside; no two edges of a slab cross. ``low``/``high`` are an edge's x at the slab's ends."""
    middle = (low + high) / 2
    order = np.lexsort((middle, slab))
    slab, middle, side = slab[order], middle[order], side[order]
    first = np.concatenate([[True], slab[1:] != slab[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(slab)), 0))
    both = np.ones(len(slab), bool)
    for s in (0, 1):
        seen = np.cumsum(side == s)
        both &= (seen - (seen - (side == s))[start]) % 2 == 1
    following = np.concatenate([middle[1:], [0]])
    last = np.concatenate([first[1:], [True]])
    width = np.where(last, right[slab], following) - middle
    return np.bincount(slab, np.where(both, width, 0), n) * height


def sweep(pair, x1, y1, x2, y2, side, low, high, right):
    """Overlap area per pair of polygons, by slabs between the heights of all ends and crossings.

    Edges ``(pair, x1, y1, x2, y2)`` of the two polygons (``side`` 0 and 1) of each pair; of pair ``k`` the heights from ``low[k]`` to ``high[k]`` count,
    up to ``right[k]``. In a slab the edges keep their order, so areas are widths at half height times heights.
    """
    up = y1 < y2
    x1, y1, x2, y2 = np.where(up, x1, x2), np.where(up, y1, y2), np.where(up, x2, x1), np.where(up, y2, y1)
    a, b = np.maximum(y1, low[pair]), np.minimum(y2, high[pair])
    some = a < b
    pair, x1, y1, x2, y2, side, a, b = (v[some] for v in (pair, x1, y1, x2, y2, side, a, b))
    if not len(pair):
        return np.zeros(len(low))
    slope = (x2 - x1) / (y2 - y1)
    xa, xb = np.where(a == y1, x1, x1 + (a - y1) * slope), np.where(b == y2, x2, x1 + (b - y1) * slope)
    of, height = np.concatenate([pair, pair]), np.concatenate([a, b])
    order = np.lexsort((height, of))
    new = np.ones(len(of), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (height[order][1:] != height[order][:-1])
    event = np.empty(len(of), np.int64)
    event[order] = np.cumsum(new) - 1
    level, owner = height[order][new], of[order][new]
    begin, end = event[: len(pair)], event[len(pair) :]
    many = end - begin
    edge = np.repeat(np.arange(len(pair)), many)
    slab = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    to = np.minimum(slab + 1, len(level) - 1)
    at = lambda y, e: np.where(y == a[e], xa[e], np.where(y == b[e], xb[e], xa[e] + (y - a[e]) * slope[e]))
    xl, xh, s = at(level[slab], edge), at(level[to], edge), side[edge]
    tall = np.concatenate([np.diff(level), [0.0]])
    area = _strip_areas(slab, xl, xh, s, tall, right[owner], len(level))
    # Slabs in which edges change their order are cut again, at their crossings.
    order = np.lexsort(((xl + xh) / 2, slab))
    near = 1e-9 * (np.abs(xl).max() + np.abs(xh).max())
    i, j = order[:-1], order[1:]
    wrong = np.unique(slab[i][(slab[i] == slab[j]) & ((xl[i] > xl[j] + near) | (xh[i] > xh[j] + near))])
    for k in range(0, len(wrong), 2000):
        part = wrong[k : k + 2000]
        rows = order[np.isin(slab[order], part)]
        own = np.searchsorted(part, slab[rows])
        held = np.bincount(own, minlength=len(part))
        first = np.cumsum(held) - held
        n = held[own]
        p = np.repeat(np.arange(len(rows)), n)
        q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)
        p, q = p[p < q], q[p < q]
        below, above = xl[rows[p]] - xl[rows[q]], xh[rows[p]] - xh[rows[q]]
        cross = below * above < 0
        cut = np.concatenate([own[p][cross], np.arange(len(part)), np.arange(len(part))])
        share = np.concatenate([(below / (below - above + (below == above)))[cross], np.zeros(len(part)), np.ones(len(part))])
        cut, share = np.unique(np.stack([cut, share]), axis=1)
        cut = cut.astype(np.int64)
        inner = np.flatnonzero(cut[1:] == cut[:-1])  # sub-slabs from here to the next share
        subs = np.bincount(cut[inner], minlength=len(part))
        begin = np.cumsum(subs) - subs
        n = subs[own]
        r = np.repeat(np.arange(len(rows)), n)
        sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
        t, u = share[inner][sub], share[inner + 1][sub]
        lo, hi = xl[rows[r]], xh[rows[r]]
        fine = _strip_areas(sub, lo + t * (hi - lo), lo + u * (hi - lo), s[rows[r]], (share[inner + 1] - share[inner]) * tall[part[cut[inner]]], right[owner[part[cut[inner]]]], len(inner))
        area[part] = np.bincount(cut[inner], fine, len(part))
    return np.bincount(owner, area, len(low))


def _sides(pdf: pd.DataFrame):
    """Edges of one layer ordered by polygon: polygons, where each begins, edges, and boxes."""
    pdf = pdf.sort_values("poly", kind="stable")
    names, first, count = np.unique(pdf["poly"].to_numpy(), return_index=True, return_counts=True)
    e = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
    box = {"x": np.minimum.reduceat(np.minimum(e[:, 0], e[:, 2]), first), "y": np.minimum.reduceat(np.minimum(e[:, 1], e[:, 3]), first), "top": np.maximum.reduceat(np.maximum(e[:, 1], e[:, 3]), first)}
    return names, first, count, e, box


def _overlaps(tile: float, x0: float):
    def run(left: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(other):
            return pd.DataFrame({"a": [], "b": [], "area": []})
        right = x0 + (float(left["cx"].iloc[0]) + 1) * tile
        (an, af, ac, ae, abox), (bn, bf, bc, be, bbox) = _sides(left), _sides(other)
        out, held, size = [], [], 0

        def flush():
            i, j = (np.concatenate(x) for x in zip(*held))
            pair = np.arange(len(i))
            p, rows = [], []
            for s, (k, first, count, e) in enumerate(((i, af, ac, ae), (j, bf, bc, be))):
                n = count[k]
                p.append(np.repeat(pair, n))
                rows.append(np.column_stack([e[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k], n)], np.full(n.sum(), s)]))
            p, rows = np.concatenate(p), np.concatenate(rows)
            low, high = np.maximum(abox["y"][i], bbox["y"][j]), np.minimum(abox["top"][i], bbox["top"][j])
            area = sweep(p, *rows[:, :4].T, rows[:, 4].astype(int), low, high, np.full(len(i), right))
            some = area > 0
            out.append(pd.DataFrame({"a": an[i[some]], "b": bn[j[some]], "area": area[some]}))
            held.clear()

        for k in range(len(an)):
            j = np.flatnonzero((bbox["y"] < abox["top"][k]) & (bbox["top"] > abox["y"][k]))
            if len(j):
                held.append((np.full(len(j), k), j))
                size += int(bc[j].sum()) + len(j) * int(ac[k])
            if held and (size > _SWEEP or k == len(an) - 1):
                flush()
                size = 0
        if held:
            flush()
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "area": []})

    return run


def overlay(a: DataFrame, a_key: str, b: DataFrame, b_key: str, tile: float = 400000.0, share: float = 1e-12) -> DataFrame:
    """Pairs of polygons that overlap, with the exact area of the overlap (even-odd rule): ``a_key, b_key, area``.

    Both layers are cut by tiles, and a slab sweep adds up the overlap per tile. ``tile`` only deals out the work: take it a little larger than
    most polygons of the finer layer. Polygons of a crowded tile are dealt over several tasks by polygon, those of the other layer copied
    to each. Keys tell polygons apart; null ones take no part. Polygons that only touch (up to rounding: ``share`` of a tile's area)
    do not overlap.
    """
    cut = lambda df, key: cut_lineage(  # read twice
        tile_pieces(df.where(F.col(key).isNotNull()), key, tile).select(F.col(key).alias("poly"), "cx", "cy", "x1", "y1", "x2", "y2")
    )
    one, two = cut(a, a_key), cut(b, b_key)
    parts = lambda df, n: df.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / _EDGES).cast("int").alias(n))
    tiles = parts(one, "na").join(parts(two, "nb"), ["cx", "cy"])  # tiles that both layers reach
    part = lambda n: F.pmod(F.xxhash64("poly"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    work = ["cx", "cy", "pa", "pb"]
    left = one.join(tiles, ["cx", "cy"]).withColumn("pa", part("na")).withColumn("pb", every("nb")).drop("na", "nb")
    right = two.join(tiles, ["cx", "cy"]).withColumn("pb", part("nb")).withColumn("pa", every("na")).drop("na", "nb")
    kinds = [df.schema[n].dataType.simpleString() for df, n in ((a, a_key), (b, b_key))]
    found = left.groupBy(*work).cogroup(right.groupBy(*work)).applyInPandas(_overlaps(tile, 0.0), f"a {kinds[0]}, b {kinds[1]}, area double")
    out = found.groupBy("a", "b").agg(F.sum("area").alias("area")).where(f"area > {share * tile * tile!r}D")
    return out.select(F.col("a").alias(a_key), F.col("b").alias(b_key), "area")
