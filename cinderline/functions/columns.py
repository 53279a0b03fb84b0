"""Column expressions with the missing-value and rounding rules of the studies they serve.

Missing is NULL. Comparisons with NULL yield NULL, rounding is half-even, and ratios
with a zero denominator are NULL.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class ladders (break points, then labels).
SPREAD_BREAKS = [15, 40, 100, 400]
SPREAD_LABELS = ["< 15", "15 - 40", "40 - 100", "100 - 400", "> 400"]
FREQUENCY_BREAKS = [25, 100, 250, 500]
FREQUENCY_LABELS = ["1 - 25", "25 - 100", "100 - 250", "250 - 500", "> 500"]
MEAN_GROWTH_BREAKS = [100, 200, 500, 2000]
MEAN_GROWTH_LABELS = ["< 100", "100 - 200", "200 - 500", "500 - 2000", "> 2000"]
PEAK_GROWTH_BREAKS = [200, 500, 2000, 10000]
PEAK_GROWTH_LABELS = ["< 200", "200 - 500", "500 - 2,000", "2,000 - 10,000", "> 10,000"]
HOMES_PER_ROAD_BREAKS = [0, 5, 10, 20, 50, 100, 100000000]
HOMES_PER_ROAD_LABELS = ["0-5", "5-10", "10-20", "20-50", "50-100", "100+"]
HOMES_INTERVALS = [0, 10, 20, 50, 100, 500, 1000, 100000]

# Level-1 regions by part of the country; anything else is Central.
EAST_REGIONS = ["EASTERN TEMPERATE FORESTS", "TROPICAL WET FORESTS", "NORTHERN FORESTS"]
WEST_REGIONS = [
    "NORTH AMERICAN DESERTS", "SOUTHERN SEMI-ARID HIGHLANDS", "TEMPERATE SIERRAS",
    "MEDITERRANEAN CALIFORNIA", "NORTHWESTERN FORESTED MOUNTAINS", "MARINE WEST COAST FOREST",
]

# Landcover classes merged for the growth curves, and classes left out of them.
MERGED_LANDCOVER = {
    "Cropland/Natural  Vegetation  Mosaics": "Crops/Natural Veg",
    "Woody Savannas": "Savannas",
    "Closed Shrublands": "Shrublands",
    "Open Shrublands": "Shrublands",
    "Deciduous Broadleaf Forests": "Broadleaf Forests",
    "Evergreen Broadleaf Forests": "Broadleaf Forests",
    "Evergreen Needleleaf Forests": "Conifer Forests",
}
SHORT_REGION_NAMES = {"Northwestern Forested Mountains": "Northwestern Forested Mtns"}
CURVE_EXCLUDED = [
    "Permanent Snow and Ice", "Water Bodies", "Urban and Built-up Lands", "Barren", "Permanent Wetlands",
]

# Unit factors and the dividing meridian.
HA_PER_ACRE = 0.404686
HA_PER_M2 = 0.0001
M_PER_KM = 1000.0
M2_PER_KM2 = 1e6
DIVIDING_LONGITUDE = -97.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def classify(col, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed classes: ``labels[0]`` below the first break, the last at or above the last one."""
    col = _c(col)
    out = F.when(col.isNull(), None)
    for upper, label in zip(breaks, labels):
        out = out.when(col < upper, label)
    return out.otherwise(labels[-1])


def classify_spread(col) -> Column:
    return classify(col, SPREAD_BREAKS, SPREAD_LABELS)


def classify_frequency(col) -> Column:
    """Counts; 25 itself belongs to the first class and values below 1 have no class."""
    col = _c(col)
    return (
        F.when(col < 1, None)
        .when(col == FREQUENCY_BREAKS[0], FREQUENCY_LABELS[0])
        .otherwise(classify(col, FREQUENCY_BREAKS, FREQUENCY_LABELS))
    )


def classify_mean_growth(col) -> Column:
    return classify(col, MEAN_GROWTH_BREAKS, MEAN_GROWTH_LABELS)


def classify_peak_growth(col) -> Column:
    return classify(col, PEAK_GROWTH_BREAKS, PEAK_GROWTH_LABELS)


def cut(col, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins ``(b[i], b[i+1]]``; outside every bin is NULL."""
    col = _c(col)
    out = F.when(col.isNull() | (col <= breaks[0]) | (col > breaks[-1]), None)
    for upper, label in zip(breaks[1:], labels):
        out = out.when(col <= upper, label)
    return out


def interval_index(col, breaks: Sequence[float]) -> Column:
    """1-based index of ``[b[i], b[i+1])``, the last interval closed; outside is NULL."""
    col = _c(col)
    out = F.when(col.isNull() | (col < breaks[0]) | (col > breaks[-1]), None)
    for i, upper in enumerate(breaks[1:], start=1):
        out = out.when(col <= upper if i == len(breaks) - 1 else col < upper, i)
    return out


def recode(col, mapping: Mapping[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(pairs, _c(col)), _c(col))


def when_equal(col, value, replacement) -> Column:
    """Replace one value, pass everything else through."""
    return F.when(_c(col) == value, F.lit(replacement)).otherwise(_c(col))


def not_in(col, values: Sequence) -> Column:
    """NOT IN where a missing value is simply not in the list, so its row stays."""
    return ~_c(col).isin(*values) | _c(col).isNull()


def all_different(col, values: Sequence) -> Column:
    """Conjunction of ``col != v``; a missing value drops the row."""
    return ~_c(col).isin(*values)


def part_of_country(col) -> Column:
    return F.when(_c(col).isin(*EAST_REGIONS), "East").when(_c(col).isin(*WEST_REGIONS), "West").otherwise("Central")


def east_or_west(lon, meridian: float = DIVIDING_LONGITUDE) -> Column:
    return F.when(_c(lon).isNull(), None).when(_c(lon) < meridian, "West").otherwise("East")


def decade(year, split: int = 2010, labels: Sequence[str] = ("2000-2009", "2010-2019")) -> Column:
    return F.when(_c(year).isNull(), None).when(_c(year) < split, labels[0]).otherwise(labels[1])


def level_order(col, levels: Sequence[str]) -> Column:
    """1-based position in an ordered category, NULL for other values."""
    arr = F.array(*[F.lit(v) for v in levels])
    return F.nullif(F.array_position(arr, _c(col)), F.lit(0).cast("long"))


def number_or_null(col, to: str = "double") -> Column:
    return _c(col).try_cast(to)


def substring_at(col, start: int, end: int) -> Column:
    """Characters ``start..end``, inclusive; negative positions count from the end."""
    return F.substring(_c(col), start, end - start + 1)


def extract_or_null(col, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(_c(col), pattern, group), F.lit(""))


def title_case(col) -> Column:
    """First letter of every word in upper case; words also start after ``/``, ``-`` and ``(``."""
    words = F.split(F.lower(_c(col)), r"(?<=[ /(-])")
    return F.array_join(F.transform(words, lambda w: F.initcap(w)), "")


def field(col, sep: str, i: int) -> Column:
    """The ``i``-th (0-based) part of a separated string, NULL past the end."""
    return F.get(F.split(_c(col), sep), F.lit(i))


def date_of(year, month, day) -> Column:
    return F.try_to_date(F.concat_ws("-", _c(year), _c(month), _c(day)), "yyyy-M-d")


def date_parts(date, prefix: str) -> dict[str, Column]:
    date = _c(date)
    return {
        f"{prefix}_date": date, f"{prefix}_year": F.year(date), f"{prefix}_day": F.day(date),
        f"{prefix}_month": F.month(date), f"{prefix}_doy": F.dayofyear(date),
    }


def half_even(col, digits: int = 0) -> Column:
    return F.bround(_c(col), digits)


def ratio(a, b) -> Column:
    return F.try_divide(_c(a), _c(b))


def rounded_percent(part, whole) -> Column:
    return half_even(ratio(part, whole) * 100)


def log_or_null(col) -> Column:
    return F.when(_c(col) > 0, F.ln(_c(col)))


def geometric_mid(col) -> Column:
    """Aggregate: the middle of ``[1, max]`` on a log scale."""
    return F.exp(F.ln(F.max(_c(col))) / 2)


def zero_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(0).cast("double"))


def null_to_zero(col) -> Column:
    return F.coalesce(_c(col), F.lit(0.0))


def p_label(p, digits: int = 3) -> Column:
    return F.concat(F.lit("p = "), half_even(p, digits).cast("string"))


def thousands(n) -> Column:
    return F.format_number(_c(n), 0)


def rename_lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def within(df: DataFrame, **ranges) -> DataFrame:
    """Keep rows whose named columns lie in closed ranges."""
    for name, (lo, hi) in ranges.items():
        df = df.where(F.col(name).between(lo, hi))
    return df


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "var", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, value)
