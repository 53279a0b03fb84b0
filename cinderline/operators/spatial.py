"""Points, lines and polygons as nested arrays, and the joins between them.

Every spatial join is an equi-join on cells or strips plus a residual test, so Spark can
hash, broadcast or split it like any other join.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderline.functions.columns import M_PER_KM
from cinderline.operators.keys import join_keys

# The spherical equal-area projection used by every layer.
LAEA_LAT0 = 45.0
LAEA_LON0 = -100.0
LAEA_RADIUS = 6370997.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- coordinates --------------------------------------------------------------------------

def to_laea(lon, lat) -> Column:
    """Lon/lat degrees to projected metres as ``struct(x, y)``."""
    lam, phi = F.radians(_c(lon) - LAEA_LON0), F.radians(_c(lat))
    s0, c0 = F.sin(F.radians(F.lit(LAEA_LAT0))), F.cos(F.radians(F.lit(LAEA_LAT0)))
    k = LAEA_RADIUS * F.sqrt(F.try_divide(F.lit(2.0), 1 + s0 * F.sin(phi) + c0 * F.cos(phi) * F.cos(lam)))
    return F.struct(
        (k * F.cos(phi) * F.sin(lam)).alias("x"),
        (k * (c0 * F.sin(phi) - s0 * F.cos(phi) * F.cos(lam))).alias("y"),
    )


def from_laea(x, y) -> Column:
    """Projected metres to lon/lat degrees as ``struct(lon, lat)``."""
    x, y = _c(x), _c(y)
    s0, c0 = F.sin(F.radians(F.lit(LAEA_LAT0))), F.cos(F.radians(F.lit(LAEA_LAT0)))
    rho = F.hypot(x, y)
    c = 2 * F.asin(rho / (2 * LAEA_RADIUS))
    phi = F.asin(F.cos(c) * s0 + F.coalesce(F.try_divide(y * F.sin(c) * c0, rho), F.lit(0.0)))
    lam = F.atan2(x * F.sin(c), rho * c0 * F.cos(c) - y * s0 * F.sin(c))
    return F.struct((LAEA_LON0 + F.degrees(lam)).alias("lon"), F.degrees(phi).alias("lat"))


def reproject(geom, transform) -> Column:
    """Apply a point transform to every vertex of a polygon."""
    point = lambda p: transform(p["x"], p["y"])
    return F.transform(_c(geom), lambda part: F.transform(part, lambda ring: F.transform(ring, point)))


def as_point(x, y) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


def point_columns(df: DataFrame, point: str, names: Sequence[str] = ("x", "y")) -> DataFrame:
    """Coordinates as two columns, replacing columns of the same names."""
    return df.withColumns({names[0]: F.col(f"{point}.x"), names[1]: F.col(f"{point}.y")})


def explode_points(df: DataFrame, geom: str, name: str = "point") -> DataFrame:
    return df.withColumn(name, F.explode(geom)).drop(geom) if geom != name else df.withColumn(name, F.explode(geom))


# --- measures, computed inside the row ------------------------------------------------------

# Geometry arguments below are SQL text: a column name or any expression. One parsed text per
# measure is far quicker to build than the same tree of Column calls.

def _steps(ring: str) -> str:
    """Consecutive vertex pairs of a ring; an open ring is closed."""
    closed = f"(case when element_at({ring}, 1) = element_at({ring}, -1) then {ring} else concat({ring}, slice({ring}, 1, 1)) end)"
    return f"transform(array({closed}), c -> {_pairs('c')})[0]"


def _pairs(points: str) -> str:
    n = f"greatest(size({points}) - 1, 0)"
    return (
        f"zip_with(slice({points}, 1, {n}), slice({points}, 2, {n}), "
        "(a, b) -> named_struct('x1', a.x, 'y1', a.y, 'x2', b.x, 'y2', b.y))"
    )


def _moments(geom: str) -> str:
    """Area and first moments per ring, about the ring's first vertex; holes count negative."""
    cross = "((e.x1 - o.x) * (e.y2 - o.y) - (e.x2 - o.x) * (e.y1 - o.y))"
    total = lambda term: f"aggregate(s, 0D, (acc, e) -> acc + {term})"
    raw = (
        f"transform(array(named_struct('s', {_steps('r')}, 'o', r[0])), q -> transform(array(q.s), s -> transform(array(q.o), o -> named_struct("
        f"'a', {total(cross)}, 'mx', {total(cross + ' * (e.x1 + e.x2 - 2 * o.x)')}, 'my', {total(cross + ' * (e.y1 + e.y2 - 2 * o.y)')}, 'o', o))[0])[0])[0]"
    )
    signed = (
        "transform(array(named_struct('m', {raw}, 'h', case when i = 0 then 1D else -1D end)), z -> named_struct("
        "'a', signum(z.m.a) * z.h * z.m.a / 2, "
        "'mx', signum(z.m.a) * z.h * (z.m.mx / 6 + z.m.o.x * z.m.a / 2), "
        "'my', signum(z.m.a) * z.h * (z.m.my / 6 + z.m.o.y * z.m.a / 2)))[0]"
    ).format(raw=raw)
    return f"flatten(transform({geom}, p -> transform(p, (r, i) -> {signed})))"


def _total(moments: str, name: str) -> str:
    return f"aggregate({moments}, 0D, (acc, w) -> acc + w.{name})"


def area(geom: str) -> Column:
    return F.expr(_total(_moments(geom), "a"))


def centroid(geom: str) -> Column:
    part = lambda n: f"try_divide({_total('g', n)}, {_total('g', 'a')})"
    return F.expr(f"transform(array({_moments(geom)}), g -> named_struct('x', {part('mx')}, 'y', {part('my')}))[0]")


def line_length(line: str) -> Column:
    return F.expr(f"aggregate({_pairs(line)}, 0D, (acc, e) -> acc + hypot(e.x2 - e.x1, e.y2 - e.y1))")


def bounding_box(df: DataFrame, geom: str) -> DataFrame:
    """One row: the box over every vertex of every polygon, with its corner ring as ``geom``."""
    pts = F.flatten(F.flatten(F.col(geom)))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    v = df.select(F.array_min(xs).alias("a"), F.array_min(ys).alias("b"), F.array_max(xs).alias("c"), F.array_max(ys).alias("d")).agg(
        F.min("a").alias("xmin"), F.min("b").alias("ymin"), F.max("c").alias("xmax"), F.max("d").alias("ymax")
    )
    return v.withColumn("geom", box_polygon(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def box_polygon(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(xmin, ymin), p(xmax, ymin), p(xmax, ymax), p(xmin, ymax), p(xmin, ymin))
    return F.array(F.array(ring))


def remove_holes(geom: str) -> Column:
    return F.expr(f"transform({geom}, p -> slice(p, 1, 1))")


def vertices(df: DataFrame, key: str, geom: str = "geom", attributes: Sequence[str] = ()) -> DataFrame:
    """One row per vertex; attributes ride along, which saves joining them back."""
    return (
        df.select(key, *attributes, F.posexplode(geom).alias("part", "__p"))
        .select(key, *attributes, "part", F.posexplode("__p").alias("ring", "__r"))
        .select(key, *attributes, "part", "ring", F.posexplode("__r").alias("seq", "__v"))
        .select(key, *attributes, "part", "ring", "seq", "__v.x", "__v.y")
    )


def edges(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """One row per edge; rings without a vertex have none."""
    return (
        df.select(key, F.posexplode(geom).alias("part", "__p"))
        .select(key, "part", F.posexplode("__p").alias("ring", "__r")).where("size(__r) > 0")
        .select(key, "part", "ring", F.posexplode(F.expr(_steps("__r"))).alias("seq", "__e"))
        .select(key, "part", "ring", "seq", "__e.*")
    )


def segments(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """Lines as one row per straight segment."""
    return df.select(key, F.posexplode(F.expr(_pairs(geom))).alias("seq", "__e")).select(key, "seq", "__e.*")


# --- grids ----------------------------------------------------------------------------------

def cell_index(v, origin: float, size: float) -> Column:
    return F.floor((_c(v) - origin) / size)


def with_cell(points: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    return points.withColumns({"cx": cell_index(x, x0, size), "cy": cell_index(y, y0, size)})


def fishnet(spark, xmin: float, ymin: float, xmax: float, ymax: float, size: float) -> DataFrame:
    """Regular grid over a box. Cells are numbered row by row from 1, before any clipping."""
    nx, ny = max(1, -int(-(xmax - xmin) // size)), max(1, -int(-(ymax - ymin) // size))
    ids = spark.range(nx * ny)
    return ids.select(
        (F.col("id") + 1).alias("cell_id"),
        (F.col("id") % nx).alias("cx"), F.floor(F.col("id") / nx).alias("cy"),
    ).withColumns({"x": xmin + (F.col("cx") + 0.5) * size, "y": ymin + (F.col("cy") + 0.5) * size})


# --- point in polygon -------------------------------------------------------------------------

def polygon_index(polys: DataFrame, key: str, strip: float, geom: str = "geom") -> DataFrame:
    """Polygon edges by horizontal strip and column: ``key, __s, __c, __edges``.

    A point only has to meet the edges of its own strip, of polygons that reach its column.
    """
    at = lambda v: f"cast(floor({v} / {strip!r}D) as bigint)"
    e = edges(polys, key, geom).where("y1 <> y2")
    by_strip = e.withColumn("__s", F.expr(f"explode(sequence({at('least(y1, y2)')}, {at('greatest(y1, y2)')}))")).groupBy(key, "__s").agg(
        F.expr("collect_list(named_struct('x1', x1, 'y1', y1, 'x2', x2, 'y2', y2)) as __edges"),
        F.expr("min(least(x1, x2)) as __lo"), F.expr("max(greatest(x1, x2)) as __hi"),
    )
    return by_strip.select(key, "__s", F.expr(f"explode(sequence({at('__lo')}, {at('__hi')})) as __c"), "__edges")


# Even-odd rule, half-open: a border point belongs to exactly one of two neighbours.
_INSIDE = (
    "size(filter(__edges, e -> (e.y1 <= `{y}`) <> (e.y2 <= `{y}`) "
    "and `{x}` < e.x1 + (`{y}` - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1))) % 2 = 1"
)


def point_in_polygon(
    points: DataFrame, polys: DataFrame, key: str, strip: float = 100000.0, how: str = "inner",
    x: str = "x", y: str = "y", attributes: Sequence[str] = (),
) -> DataFrame:
    """Points joined to the polygons that contain them (``how``: inner, or left to keep the others).

    Points are never grouped: the parity test runs inside the join, so a dense strip can be split.
    """
    index = polygon_index(polys, key, strip)
    if attributes:
        index = join_keys(index, polys.select(key, *attributes), [key], "inner")
    at = lambda c: F.expr(f"cast(floor(`{c}` / {strip!r}D) as bigint)")
    p = points.withColumns({"__ps": at(y), "__pc": at(x)})
    cond = F.expr("__ps = __s and __pc = __c and " + _INSIDE.format(x=x, y=y))
    return p.join(index, cond, how).drop("__ps", "__pc", "__s", "__c", "__edges")


def count_in_polygons(polys: DataFrame, key: str, points: DataFrame, strip: float = 100000.0, name: str = "n") -> DataFrame:
    hits = point_in_polygon(points.select("x", "y"), polys, key, strip).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return join_keys(polys, hits, [key], "left").withColumn(name, F.coalesce("__n", F.lit(0))).drop("__n")


# --- covers: polygons as the grid cells whose centre they contain --------------------------------

def cover(polys: DataFrame, key: str, size: float, x0: float = 0.0, y0: float = 0.0, geom: str = "geom") -> DataFrame:
    """``key, cx, cy``. Edges meet the cell rows they cross; crossings pair up into runs of cells."""
    centre = lambda v, o: f"cast(ceil(({v} - {o!r}D) / {size!r}D - 0.5D) as bigint)"
    lo, hi = centre("least(y1, y2)", y0), centre("greatest(y1, y2)", y0) + " - 1"
    rows = edges(polys, key, geom).where(f"{hi} >= {lo}").withColumn("cy", F.expr(f"explode(sequence({lo}, {hi}))"))
    cross = f"x1 + ({y0!r}D + (cy + 0.5D) * {size!r}D - y1) * (x2 - x1) / (y2 - y1)"
    runs = rows.groupBy(key, "cy").agg(F.expr(f"sort_array(collect_list({cross})) as __x"))
    pairs = (
        f"transform(sequence(0, cast(floor(size(__x) / 2) as int) - 1), i -> named_struct("
        f"'lo', {centre('get(__x, i * 2)', x0)}, 'hi', {centre('get(__x, i * 2 + 1)', x0)} - 1))"
    )
    spans = runs.select(key, "cy", F.expr(f"explode({pairs}) as __r")).where("__r.hi >= __r.lo")
    return spans.select(key, F.expr("explode(sequence(__r.lo, __r.hi)) as cx"), "cy")


def dissolve(covers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return covers.select(*keys, "cx", "cy").distinct()


def clip_to_cover(df: DataFrame, mask: DataFrame, *columns: str) -> DataFrame:
    """Rows in cells of the mask; with ``columns`` of the mask, one row per cell and mask row."""
    return df.join(mask.select("cx", "cy", *columns), ["cx", "cy"], "inner" if columns else "left_semi")


def clip_to_box(df: DataFrame, xmin, ymin, xmax, ymax, x: str = "x", y: str = "y") -> DataFrame:
    return df.where((F.col(x) >= xmin) & (F.col(x) <= xmax) & (F.col(y) >= ymin) & (F.col(y) <= ymax))


# --- lines on a grid -------------------------------------------------------------------------------

def grid_pieces(segs: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Every segment cut at grid lines: input columns plus ``cx, cy`` and the piece ``__p(a, b)`` as shares of the segment."""
    def crossings(a, b, o):
        lo, hi = (f"cast({f}(({g}({a}, {b}) - {o!r}D) / {size!r}D) as bigint)" for f, g in (("ceil", "least"), ("floor", "greatest")))
        # An ascending sequence is required even where the branch is not taken.
        ts = f"transform(sequence({lo}, greatest({lo}, {hi})), k -> try_divide({o!r}D + k * {size!r}D - {a}, {b} - {a}))"
        return f"case when {a} <> {b} and {hi} >= {lo} then {ts} else cast(array() as array<double>) end"

    at = lambda v, o: f"floor(({v} - {o!r}D) / {size!r}D)"
    one_cell = " and ".join(f"{at(f'{c}1', o)} = {at(f'{c}2', o)}" for c, o in (("x", x0), ("y", y0)))
    cuts = f"array_sort(array_distinct(filter(concat(array(0D, 1D), {crossings('x1', 'x2', x0)}, {crossings('y1', 'y2', y0)}), v -> v >= 0 and v <= 1)))"
    t = f"case when {one_cell} then array(0D, 1D) else {cuts} end"
    pieces = "zip_with(slice(__t, 1, size(__t) - 1), slice(__t, 2, size(__t) - 1), (a, b) -> named_struct('a', a, 'b', b))"
    cell = lambda a, b, o: F.expr(f"cast(floor(({a} + (__p.a + __p.b) / 2 * ({b} - {a}) - {o!r}D) / {size!r}D) as bigint)")
    return (
        segs.withColumn("__t", F.expr(t)).withColumn("__p", F.expr(f"explode({pieces})"))
        .withColumns({"cx": cell("x1", "x2", x0), "cy": cell("y1", "y2", y0)}).drop("__t")
    )


def split_on_grid(segs: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Every segment cut at grid lines: input columns plus ``cx, cy, piece_m``."""
    pieces = grid_pieces(segs, size, x0, y0).withColumn("piece_m", F.expr("(__p.b - __p.a) * hypot(x2 - x1, y2 - y1)"))
    return pieces.where("piece_m > 0").drop("__p")


def line_km_per_cell(segs: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    return split_on_grid(segs, size, x0, y0).groupBy("cx", "cy").agg((F.sum("piece_m") / M_PER_KM).alias("km"))
