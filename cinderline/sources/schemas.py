"""Declared schemas. Geometry is nested arrays: polygon parts > rings > points."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
POLYGON = T.ArrayType(T.ArrayType(T.ArrayType(POINT)))


def _schema(spec, geom=None):
    fields = [T.StructField(n, t()) for n, t in spec]
    if geom is not None:
        fields.append(T.StructField("geom", geom))
    return T.StructType(fields)


_S, _I, _L, _D, _DT = T.StringType, T.IntegerType, T.LongType, T.DoubleType, T.DateType

FIRE_EVENTS = _schema(
    [
        ("ignition_year", _I), ("ignition_month", _I), ("ignition_doy", _I), ("ignition_date", _DT),
        ("l1_eco", _S), ("l1_ecoregion", _S), ("lc_name", _S),
        ("fsr_ha_per_day", _D), ("fsr_km2_per_day", _D), ("fsr_acres_per_day", _D),
        ("max_growth_ha", _D), ("max_growth_km2", _D),
        ("total_area_ha", _D), ("total_area_km2", _D), ("duration", _I),
    ],
    POLYGON,
)
DAILY_GROWTH = _schema(
    [
        ("id", _L), ("date", _S), ("event_day", _I), ("duration", _I), ("pixels", _L),
        ("cum_pixels", _L), ("cum_area_km2", _D), ("l1_ecoregion", _S), ("lc_name", _S),
    ]
)
STATES = _schema([("statefp", _S), ("stusps", _S)], POLYGON)
ECOREGIONS = _schema(
    [("us_l3name", _S), ("na_l2name", _S), ("na_l1name", _S), ("region", _S)], POLYGON
)
PERIMETERS = _schema(
    [("fire_id", _S), ("fire_name", _S), ("year", _I), ("startmonth", _I), ("startday", _I),
     ("acres", _D)],
    POLYGON,
)
FISHNET = _schema([("fishid50k", _I)], POLYGON)
COUNTIES = _schema([("geoid", _S), ("statefp", _I)], POLYGON)
ROADS = _schema([("geoid", _S)], LINE)
CELLS = _schema([("cx", _L), ("cy", _L), ("value", _D)])
CELL_STACK = _schema([("cx", _L), ("cy", _L), ("value", _D), ("year", _I)])
LANDCOVER_CLASSES = _schema([("value", _D), ("name", _S)])
