"""Rasters as cell tables ``(cx, cy, value[, year])``."""

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.operators.spatial import box_polygon, cover, point_in_polygon
from cinderline.sources.tables import cut_lineage

XY = ["cx", "cy"]


def to_points(cells: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0, value: str = "value") -> DataFrame:
    """Cell centres of the cells that hold a value."""
    return cells.where(F.col(value).isNotNull()).withColumns(
        {"x": x0 + (F.col("cx") + 0.5) * size, "y": y0 + (F.col("cy") + 0.5) * size}
    )


def divide(a: DataFrame, b: DataFrame, name: str = "value") -> DataFrame:
    """Cell-wise ratio where both layers have the cell; a zero divisor gives a missing cell."""
    return a.select(*XY, F.col("value").alias("__a")).join(b.select(*XY, F.col("value").alias("__b")), XY).select(
        *XY, F.try_divide("__a", "__b").alias(name)
    )


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell-wise sum over the union of both extents, missing counted as zero."""
    return mosaic([a, b])


def mosaic(layers: Sequence[DataFrame], blank: DataFrame | None = None) -> DataFrame:
    """Sum of layers per cell; with a template, exactly its cells, zero where nothing falls."""
    every = reduce(lambda p, q: p.unionByName(q), [t.select(*XY, "value") for t in layers])
    summed = every.groupBy(*XY).agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("value"))
    if blank is None:
        return summed
    return blank.select(*XY).join(summed, XY, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def blank(cells: DataFrame) -> DataFrame:
    return cells.select(*XY).distinct().withColumn("value", F.lit(0.0))


def drop_below(cells: DataFrame, threshold: float, value: str = "value") -> DataFrame:
    """Left-closed reclassification: values below the threshold become missing."""
    return cells.withColumn(value, F.when(F.col(value) >= threshold, F.col(value)))


def crop(cells: DataFrame, cx: tuple[int, int], cy: tuple[int, int]) -> DataFrame:
    return cells.where(F.col("cx").between(*cx) & F.col("cy").between(*cy))


def squares(cells: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Each cell as a square polygon."""
    lo = lambda c, o: o + F.col(c) * size
    return cells.withColumn("geom", box_polygon(lo("cx", x0), lo("cy", y0), lo("cx", x0) + size, lo("cy", y0) + size))


def rasterize(polys: DataFrame, key: str, attribute: str, order: str, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Attribute of the polygon over each cell centre; overlaps go to the last polygon by ``order``."""
    c = cover(polys, key, size, x0, y0).join(polys.select(key, attribute, order), key)
    return c.groupBy(*XY).agg(F.max_by(F.col(attribute), F.col(order)).alias("value"))


def zonal_sum(points: DataFrame, zone: Sequence[Column], values: dict[str, str]) -> DataFrame:
    """Sums per zone expression, missing values skipped."""
    return points.groupBy(*zone).agg(*[F.sum(v).alias(a) for a, v in values.items()])


def zonal_sum_polygons(points: DataFrame, polys: DataFrame, key: str, values: dict[str, str], strip: float = 100000.0) -> DataFrame:
    return zonal_sum(point_in_polygon(points, polys, key, strip), [F.col(key)], values)


def stack(layers: dict[int, DataFrame]) -> DataFrame:
    """One table from layers by year."""
    return reduce(lambda p, q: p.unionByName(q), [d.withColumn("year", F.lit(y)) for y, d in layers.items()])


# --- connected regions --------------------------------------------------------------------------

_SHIFT = 1 << 31
_HALF = 1 << 30


def _cell_id() -> Column:
    return (F.col("cx") + _HALF) * _SHIFT + F.col("cy") + _HALF


def _label_tile(size: int, diagonal: bool):
    moves = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        gx, gy = (pdf["cx"] % size).to_numpy(), (pdf["cy"] % size).to_numpy()
        codes = pd.factorize(pdf["value"])[0]
        grid = np.full((size, size), -1, dtype=np.int64)
        grid[gx, gy] = codes
        parent = np.arange(size * size)
        at = np.arange(size * size).reshape(size, size)
        links = []
        for dx, dy in moves:
            a = (slice(0, size - dx), slice(max(0, -dy), size - max(0, dy)))
            b = (slice(dx, size), slice(max(0, dy), size - max(0, -dy)))
            same = (grid[a] == grid[b]) & (grid[a] >= 0)
            links.append(np.stack([at[a][same], at[b][same]]))
        u, v = np.concatenate(links, axis=1)
        while True:
            pu, pv = parent[u], parent[v]
            if (pu == pv).all():
                break
            np.minimum.at(parent, np.maximum(pu, pv), np.minimum(pu, pv))
            while True:
                jumped = parent[parent]
                if (jumped == parent).all():
                    break
                parent = jumped
        root = parent[at[gx, gy]]
        ids = (pdf["cx"].to_numpy() + _HALF) * _SHIFT + pdf["cy"].to_numpy() + _HALF
        first = pd.Series(ids).groupby(root).transform("min").to_numpy()
        return pd.DataFrame({"cx": pdf["cx"], "cy": pdf["cy"], "value": pdf["value"], "region": first})

    return label


def _stars(edges: DataFrame) -> DataFrame:
    """A large and a small star step on edges ``(a, b)`` with ``a > b``; least neighbours are pre-aggregated."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.first("a"), F.min("b")).alias("m"))
    large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    small = large.join(own, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return small.unionByName(own.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def label_components(links: DataFrame) -> DataFrame:
    """Smallest reachable node per node of an undirected graph ``(a, b)``: ``node, label``.

    Alternating large and small stars until every node hangs on its label only; there is no limit of rounds, and long
    chains take about the logarithm of their length. A hub's links are never gathered: they meet one row, its least
    neighbour, in a join that AQE can split. Links with a null end are ignored.
    """
    links = links.dropna(subset=["a", "b"])
    nodes = cut_lineage(links.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    state = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ends = lambda df: df.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(
        df.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("top"))
    ).groupBy("n").agg(F.sum("up").alias("up"), F.max("top").alias("top"))
    while not ends(state).where("up > 1 or (up = 1 and top = 1)").isEmpty():
        state = cut_lineage(_stars(state))
    return nodes.join(state, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("label"))


def raster_regions(cells: DataFrame, connectivity: int = 4, mask: DataFrame | None = None, tile: int = 256) -> DataFrame:
    """Connected cells of equal value: ``cx, cy, value, region`` (region = its smallest cell id).

    Tiles of ``tile * tile`` cells are labelled on their own; only labels that touch across a
    tile border enter the distributed component search.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    src = cells.select(*XY, "value").where(F.col("value").isNotNull())
    if mask is not None:
        src = src.join(mask.where(F.col("value") != 0).select(*XY), XY, "left_semi")
    schema = src.select(F.col("cx").cast("long"), F.col("cy").cast("long"), "value").withColumn("region", F.lit(0).cast("long")).schema
    local = cut_lineage(
        src.withColumns({"cx": F.col("cx").cast("long"), "cy": F.col("cy").cast("long")})
        .groupBy(F.floor(F.col("cx") / tile), F.floor(F.col("cy") / tile))
        .applyInPandas(_label_tile(tile, connectivity == 8), schema)
    )
    moves = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    rim = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    on_edge = local.where(rim("cx") | rim("cy"))
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in moves]))
    out = on_edge.withColumn("__m", step).select(
        (F.col("cx") + F.col("__m.dx")).alias("cx"), (F.col("cy") + F.col("__m.dy")).alias("cy"), "value", F.col("region").alias("a")
    )
    links = out.join(on_edge.select(*XY, "value", F.col("region").alias("b")), [*XY, "value"]).where("a <> b").select("a", "b").distinct()
    labels = label_components(links)
    return local.join(labels, F.col("region") == F.col("node"), "left").select(
        *XY, "value", F.coalesce("label", "region").alias("region")
    )


def region_features(regions: DataFrame) -> DataFrame:
    """Per region: value, cell count and number of cell sides on its boundary."""
    step = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 1), (1, 0))]))
    shared = (
        regions.withColumn("__m", step)
        .select((F.col("cx") + F.col("__m.dx")).alias("cx"), (F.col("cy") + F.col("__m.dy")).alias("cy"), "region")
        .join(regions.select(*XY, "region"), [*XY, "region"]).groupBy("region").agg(F.count(F.lit(1)).alias("__shared"))
    )
    sizes = regions.groupBy("region").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("n_cells"))
    return sizes.join(shared, "region", "left").select(
        "region", "value", "n_cells", (F.col("n_cells") * 4 - 2 * F.coalesce("__shared", F.lit(0))).alias("boundary_edges")
    )
