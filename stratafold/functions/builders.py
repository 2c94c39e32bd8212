"""Reusable feature builders: each returns one Column (or a list of aliased Columns)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, permutations, product
from operator import mul

from pyspark.sql import Column, functions as F

from .scalar import (
    ColumnLike,
    clip,
    col,
    cut,
    divide,
    dummies,
    floored_mod,
    log1p_clipped,
    num,
    row_max,
    row_mean,
    row_min,
    row_range,
    row_std,
    row_sum,
    square,
    total,
)

# Eight compass sectors of 45 degrees, north first.
COMPASS_LABELS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
COMPASS_EDGES = [0, 45, 90, 135, 180, 225, 270, 315, 360]

# Sun altitude and the morning, noon and afternoon azimuths of the two hillshade forms.
SUN = {
    "A": {"altitude": 45, "azimuths": {"9am": 315, "Noon": 180, "3pm": 225}},
    "B": {"altitude": 60, "azimuths": {"9am": 105, "Noon": 180, "3pm": 255}},
}

ROW_STATS = {"sum": row_sum, "mean": row_mean, "min": row_min, "max": row_max, "range": row_range, "std": row_std}


def euclidean(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sqrt(square(a) + square(b))


def manhattan(a: ColumnLike, b: ColumnLike) -> Column:
    return F.abs(num(a)) + F.abs(num(b))


def angle(c: ColumnLike, period: float = 360.0) -> Column:
    """Radians of a value that runs once around in ``period`` units."""
    x = num(c)
    return F.radians(x if period == 360.0 else x * F.lit(360.0 / period))


def cyclical(c: str, period: float = 360.0) -> list[Column]:
    return [F.sin(angle(c, period)).alias(f"{c}_sin"), F.cos(angle(c, period)).alias(f"{c}_cos")]


def combine(terms: dict[str, float] | list[ColumnLike]) -> Column:
    """Sum of columns, or a signed / weighted sum when given {column: factor}."""
    if isinstance(terms, dict):
        return total([num(c) * F.lit(float(k)) if k not in (1, -1) else (num(c) if k == 1 else -num(c)) for c, k in terms.items()])
    return total(terms)


def interaction(*cols: ColumnLike) -> Column:
    return reduce(mul, [num(c) for c in cols])


def pairwise_products(cols: list[str]) -> list[Column]:
    return [interaction(a, b).alias(f"{a}_x_{b}") for a, b in combinations(cols, 2)]


def pairwise_ratios(cols: list[str], eps: float = 1e-6) -> list[Column]:
    return [ratio(a, b, eps).alias(f"{a}_div_{b}") for a, b in permutations(cols, 2)]


def ratio(a: ColumnLike, b: ColumnLike, eps: float = 1e-6) -> Column:
    """a / (b + eps). A zero denominator gives a signed infinity or NaN, as in floating point."""
    return divide(a, num(b) + F.lit(float(eps)))


def power(c: ColumnLike, degree: int = 2) -> Column:
    return reduce(mul, [num(c)] * degree)


def polynomial(cols: list[str], degree: int = 2) -> list[Column]:
    return [power(c, d).alias(f"{c}_pow{d}") for d in range(2, degree + 1) for c in cols]


def row_stats(cols: list[ColumnLike], kinds: list[str], prefix: str) -> list[Column]:
    return [ROW_STATS[kind](cols).alias(f"{prefix}_{kind}") for kind in kinds]


def log1p_nonneg(*cols: ColumnLike) -> Column:
    """log(1 + max(0, x)); for several columns the sum of their logs."""
    return reduce(lambda a, b: a + b, [log1p_clipped(c) for c in cols])


def hillshade(aspect: ColumnLike, slope: ColumnLike, azimuth: float, altitude: float, form: str = "B") -> Column:
    """Illumination index in 0..255 for a sun position.

    Form B is the usual formula; form A swaps the sine and cosine of the altitude between the two terms.
    """
    a, s = F.radians(num(aspect)), F.radians(num(slope))
    alt, az = F.radians(F.lit(float(altitude))), F.radians(F.lit(float(azimuth)))
    flat, tilted = (F.sin(s), F.cos(s)) if form == "A" else (F.cos(s), F.sin(s))
    by_flat, by_tilt = (F.cos(alt), F.sin(alt)) if form == "A" else (F.sin(alt), F.cos(alt))
    return clip(F.lit(255.0) * (by_flat * flat + by_tilt * tilted * F.cos(az - a)), 0, 255)


def hillshades(aspect: ColumnLike, slope: ColumnLike, form: str = "B", prefix: str = "Hillshade") -> list[Column]:
    """Morning, noon and afternoon hillshade with the sun positions of the form."""
    sun = SUN[form]
    return [hillshade(aspect, slope, az, sun["altitude"], form).alias(f"{prefix}_{t}") for t, az in sun["azimuths"].items()]


def northness(aspect: ColumnLike, slope: ColumnLike) -> Column:
    return F.cos(angle(aspect)) * F.sin(angle(slope))


def eastness(aspect: ColumnLike, slope: ColumnLike) -> Column:
    return F.sin(angle(aspect)) * F.sin(angle(slope))


def slope_weighted(aspect: ColumnLike, slope: ColumnLike, trig: str) -> Column:
    """Slope times the sine ('sin') or cosine ('cos') of the aspect."""
    return num(slope) * (F.sin if trig == "sin" else F.cos)(angle(aspect))


def bearing(y: ColumnLike, x: ColumnLike) -> Column:
    return F.atan2(num(y), num(x))


def compass_bin(c: ColumnLike) -> Column:
    """Compass sector of an angle in degrees, sectors centred on their direction."""
    return cut(floored_mod(num(c) + F.lit(22.5), 360), COMPASS_EDGES, COMPASS_LABELS)


def compass_dummies(c: ColumnLike, prefix: str) -> list[Column]:
    return dummies(compass_bin(c), COMPASS_LABELS, prefix)


def scale_by(c: ColumnLike, constant: float) -> Column:
    return num(c) / F.lit(float(constant))


def indicator_cross(group_a: list[str], group_b: list[str]) -> list[Column]:
    """Product of every pair from two groups of columns, as one list for a single select."""
    return [(col(a) * col(b)).alias(f"{a}_x_{b}") for a, b in product(group_a, group_b)]


MAX_CROSSES = 1_000_000  # width of a sparse cross


def sparse_cross(group_a: list[str], group_b: list[str]) -> Column:
    """The same products as one sparse value (size, indices, values), without a column for each pair.

    Pair (i, j) has index i * len(group_b) + j. Only what is not 0 is there, so a row costs its non-zero pairs and not the width; missing values count as 0.
    """
    width = len(group_a) * len(group_b)
    if not 0 < width <= MAX_CROSSES:
        raise ValueError(f"a cross has between 1 and {MAX_CROSSES} columns, not {width}")

    def present_of(group: list[str]) -> Column:
        every = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(num(c), F.lit(0.0)).alias("x")) for i, c in enumerate(group)])
        return F.filter(every, lambda e: e["x"] != 0)

    pairs = F.flatten(F.transform(present_of(group_a), lambda a: F.transform(present_of(group_b), lambda b: F.struct((a["i"] * len(group_b) + b["i"]).alias("i"), (a["x"] * b["x"]).alias("x")))))
    return F.struct(F.lit(width).alias("size"), F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["x"]).alias("values"))


def to_radians(cols: list[str]) -> list[Column]:
    return [F.radians(num(c)).alias(f"{c}_rad") for c in cols]
