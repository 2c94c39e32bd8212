"""Feature builders on line items: quantity * 7.2 stands for an aspect in degrees, tax * 500 for a slope."""

from pyspark.sql import functions as F

from stratafold.functions import builders as b
from stratafold.functions import scalar as s
from stratafold.plans import terrain

from .base import LINE_KEY, LK, Checks, r, rounded, table

CHECKS = Checks()

_A, _S = "radians(l_quantity * 7.2)", "radians(l_tax * 500)"
_ASPECT, _SLOPE = "aspect", "slope"


def _lines(spark, sf_dir, *cols):
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, *cols)


def _angles(spark, sf_dir):
    return _lines(spark, sf_dir, (F.col("l_quantity") * 7.2).alias(_ASPECT), (F.col("l_tax") * 500).alias(_SLOPE))


def _out(df, columns, digits=6):
    """Key and the given aliased columns, rounded, in one projection."""
    derived = df.select(*LINE_KEY, *columns)
    return derived.select(*LINE_KEY, *[rounded(c, digits).alias(c) for c in derived.columns if c not in LINE_KEY])


def _sql(exprs, digits=6, source="lineitem"):
    return f"SELECT {LK}, " + ", ".join(f'{r(e, digits)} AS "{n}"' for n, e in exprs.items()) + f" FROM {source}"


@CHECKS.add(
    f"""SELECT o_orderkey, {r('sqrt(c_acctbal * c_acctbal + o_totalprice * o_totalprice)', 3)} AS euclidean,
        {r('abs(c_acctbal) + abs(o_totalprice)', 3)} AS manhattan, {r('atan2(o_totalprice, c_acctbal)')} AS bearing
        FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def distances_and_bearing(spark, sf_dir):
    """The price of an order and its customer's balance as two signed offsets."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select(
        "o_orderkey",
        rounded(b.euclidean("c_acctbal", "o_totalprice"), 3).alias("euclidean"),
        rounded(b.manhattan("c_acctbal", "o_totalprice"), 3).alias("manhattan"),
        rounded(b.bearing("o_totalprice", "c_acctbal")).alias("bearing"),
    )


@CHECKS.add(_sql({"aspect_sin": f"sin({_A})", "aspect_cos": f"cos({_A})", "aspect_rad": _A, "slope_rad": _S}))
def cyclical_angles(spark, sf_dir):
    return _out(_angles(spark, sf_dir), b.cyclical(_ASPECT) + b.to_radians([_ASPECT, _SLOPE]))


@CHECKS.add(
    _sql(
        {
            "total": "l_quantity + l_extendedprice + l_tax",
            "signed": "l_extendedprice - l_quantity - 2 * l_tax",
            "pair": "l_quantity * l_discount",
            "triple": "l_quantity * l_discount * l_tax",
            "scaled": "l_quantity / 360",
        },
        5,
    )
)
def combine_and_interaction(spark, sf_dir):
    lines = _lines(spark, sf_dir, "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    columns = [
        b.combine(["l_quantity", "l_extendedprice", "l_tax"]).alias("total"),
        b.combine({"l_extendedprice": 1, "l_quantity": -1, "l_tax": -2}).alias("signed"),
        b.interaction("l_quantity", "l_discount").alias("pair"),
        b.interaction("l_quantity", "l_discount", "l_tax").alias("triple"),
        b.scale_by("l_quantity", 360).alias("scaled"),
    ]
    return _out(lines, columns, 5)


_TRIO = ["l_quantity", "l_discount", "l_tax"]


@CHECKS.add(
    _sql({f"{x}_x_{y}": f"{x} * {y}" for i, x in enumerate(_TRIO) for y in _TRIO[i + 1 :]} | {f"{x}_pow2": f"{x} * {x}" for x in _TRIO}, 5)
)
def pairwise_products_and_squares(spark, sf_dir):
    return _out(_lines(spark, sf_dir, *_TRIO), b.pairwise_products(_TRIO) + b.polynomial(_TRIO), 5)


@CHECKS.add(_sql({f"{x}_div_{y}": f"{x} / ({y} + 0.001::DOUBLE)" for x in _TRIO for y in _TRIO if x != y}, 4))
def pairwise_ratios(spark, sf_dir):
    return _out(_lines(spark, sf_dir, *_TRIO), b.pairwise_ratios(_TRIO, eps=1e-3), 4)


@CHECKS.add(
    f"""SELECT {LK}, CASE WHEN l_linenumber = 4 AND l_quantity = 10 THEN 'nan'::DOUBLE
          WHEN l_linenumber = 4 AND l_quantity > 10 THEN 'inf'::DOUBLE WHEN l_linenumber = 4 THEN '-inf'::DOUBLE
          ELSE {r('(l_quantity - 10) / (l_linenumber - 4)')} END AS ratio FROM lineitem"""
)
def ratio_with_zero_denominator(spark, sf_dir):
    """The denominator plus epsilon hits zero: signed infinities and NaN, as in floating point."""
    lines = _lines(spark, sf_dir, "l_quantity")
    value = b.ratio(F.col("l_quantity") - 10, F.col("l_linenumber") - 5, eps=1.0)
    shown = F.when(s.is_finite(value), rounded(value)).otherwise(value)
    return lines.select(*LINE_KEY, shown.alias("ratio"))


_SHADES = ["q", "d", "t"]
_SHADE_SQL = f"(SELECT {LK}, l_quantity AS q, l_discount * 100 AS d, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax * 100 END AS t FROM lineitem)"


@CHECKS.add(
    f"""SELECT {LK}, {r('q + d + t', 4)} AS s_sum, {r('list_avg([q, d, t])', 4)} AS s_mean, {r('list_min([q, d, t])', 4)} AS s_min,
        {r('list_max([q, d, t])', 4)} AS s_max, {r('list_max([q, d, t]) - list_min([q, d, t])', 4)} AS s_range,
        {r('list_stddev_samp([q, d, t])', 4)} AS s_std FROM {_SHADE_SQL}"""
)
def row_statistics(spark, sf_dir):
    """Statistics along a row; one of the three values is missing in some rows."""
    lines = _lines(
        spark,
        sf_dir,
        F.col("l_quantity").alias("q"),
        (F.col("l_discount") * 100).alias("d"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 100).alias("t"),
    )
    return _out(lines, b.row_stats(_SHADES, ["sum", "mean", "min", "max", "range", "std"], "s"), 4)


@CHECKS.add(
    f"""SELECT c_custkey, {r('ln(1 + greatest(c_acctbal, 0))')} AS one, {r('ln(1 + greatest(c_acctbal, 0)) + ln(1 + greatest(c_nationkey, 0))')} AS two,
        least(greatest(c_acctbal, -100), 5000) AS clipped, greatest(c_acctbal, 0) AS floored FROM customer"""
)
def log1p_and_clip(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        rounded(b.log1p_nonneg("c_acctbal")).alias("one"),
        rounded(b.log1p_nonneg("c_acctbal", "c_nationkey")).alias("two"),
        b.clip("c_acctbal", -100, 5000).alias("clipped"),
        b.clip("c_acctbal", low=0).alias("floored"),
    )


def _shade_sql(form, az, alt):
    flat, tilt = ("sin", "cos") if form == "A" else ("cos", "sin")
    by_flat, by_tilt = ("cos", "sin") if form == "A" else ("sin", "cos")
    return (
        f"greatest(least(255 * ({by_flat}(radians({alt})) * {flat}({_S}) + {by_tilt}(radians({alt})) * {tilt}({_S}) * cos(radians({az}) - {_A})), 255), 0)"
    )


@CHECKS.add(
    _sql(
        {f"A_{t}": _shade_sql("A", az, 45) for t, az in [("9am", 315), ("Noon", 180), ("3pm", 225)]}
        | {f"B_{t}": _shade_sql("B", az, 60) for t, az in [("9am", 105), ("Noon", 180), ("3pm", 255)]},
        5,
    )
)
def hillshade(spark, sf_dir):
    """Both forms of the hillshade at three times of day."""
    return _out(_angles(spark, sf_dir), b.hillshades(_ASPECT, _SLOPE, "A", "A") + b.hillshades(_ASPECT, _SLOPE, "B", "B"), 5)


@CHECKS.add(
    _sql({"north": f"cos({_A}) * sin({_S})", "east": f"sin({_A}) * sin({_S})", "slope_sin": f"l_tax * 500 * sin({_A})", "slope_cos": f"l_tax * 500 * cos({_A})"})
)
def northness_eastness(spark, sf_dir):
    columns = [
        b.northness(_ASPECT, _SLOPE).alias("north"),
        b.eastness(_ASPECT, _SLOPE).alias("east"),
        b.slope_weighted(_ASPECT, _SLOPE, "sin").alias("slope_sin"),
        b.slope_weighted(_ASPECT, _SLOPE, "cos").alias("slope_cos"),
    ]
    return _out(_angles(spark, sf_dir), columns)


_SHIFTED = "(((l_quantity * 15 - 300 + 22.5) % 360) + 360) % 360"
_SECTOR = f"CAST(floor({_SHIFTED} / 45) AS INTEGER)"


@CHECKS.add(
    f"SELECT {LK}, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][{_SECTOR} + 1] AS direction, "
    + ", ".join(f"CAST({_SECTOR} = {i} AS INTEGER) AS dir_{d}" for i, d in enumerate(b.COMPASS_LABELS))
    + " FROM lineitem"
)
def compass_bins(spark, sf_dir):
    """Eight sectors with a half-sector shift and their indicators; angles run from negative to beyond a full turn."""
    angle = F.col("l_quantity") * 15 - 300
    return _lines(spark, sf_dir, "l_quantity").select(
        *LINE_KEY, b.compass_bin(angle).alias("direction"), *b.compass_dummies(angle, "dir")
    )


@CHECKS.add(
    f"""SELECT {LK}, CASE WHEN l_quantity < 5 OR l_quantity >= 40 THEN NULL WHEN l_quantity < 20 THEN 'low' WHEN l_quantity < 30 THEN 'mid'
        ELSE 'high' END AS bin FROM lineitem"""
)
def cut_bins(spark, sf_dir):
    """Right-open bins; outside them there is no label."""
    lines = _lines(spark, sf_dir, "l_quantity")
    return lines.select(*LINE_KEY, s.cut("l_quantity", [5, 20, 30, 40], ["low", "mid", "high"]).alias("bin"))


_FLAGS, _STATES = ["A", "N", "R"], ["F", "O"]


@CHECKS.add(
    f"SELECT {LK}, "
    + ", ".join(
        [f"CAST(l_returnflag = '{f}' AND l_linestatus = '{t}' AS INTEGER) AS flag_{f}_x_state_{t}" for f in _FLAGS for t in _STATES]
        + [f"CASE WHEN l_returnflag = '{f}' THEN l_quantity ELSE 0 END AS flag_{f}_x_l_quantity" for f in _FLAGS]
    )
    + " FROM lineitem"
)
def indicator_cross(spark, sf_dir):
    """Every pair of two indicator groups, and indicators times a measure."""
    lines = _lines(spark, sf_dir, "l_quantity", *s.dummies("l_returnflag", _FLAGS, "flag"), *s.dummies("l_linestatus", _STATES, "state"))
    flags, states = [f"flag_{f}" for f in _FLAGS], [f"state_{t}" for t in _STATES]
    return lines.select(*LINE_KEY, *b.indicator_cross(flags, states), *b.indicator_cross(flags, ["l_quantity"]))


# --- the terrain recipes, on line items in the role of the terrain table ----------------------

_TERRAIN = {
    "Elevation": "l_extendedprice / 25",
    "Aspect": "l_quantity * 7.2",
    "Slope": "l_tax * 500",
    "Horizontal_Distance_To_Hydrology": "l_discount * 1000",
    "Vertical_Distance_To_Hydrology": "l_quantity * 8 - 150",
    "Horizontal_Distance_To_Roadways": "l_extendedprice / 16",
    "Hillshade_9am": "l_quantity * 5",
    "Hillshade_Noon": "l_discount * 2000",
    "Hillshade_3pm": "l_tax * 3000",
    "Horizontal_Distance_To_Fire_Points": "l_quantity * l_linenumber",
}
_TERRAIN_SQL = f"(SELECT {LK}, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _TERRAIN.items()) + " FROM lineitem)"


def _terrain(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*LINE_KEY, *[F.expr(e).cast("double").alias(c) for c, e in _TERRAIN.items()])


_HH, _VH = "Horizontal_Distance_To_Hydrology", "Vertical_Distance_To_Hydrology"
_ROAD, _FIRE = "Horizontal_Distance_To_Roadways", "Horizontal_Distance_To_Fire_Points"
_W = f"sqrt({_HH} * {_HH} + {_VH} * {_VH})"
_H = ["Hillshade_9am", "Hillshade_Noon", "Hillshade_3pm"]
_HLIST = "[" + ", ".join(_H) + "]"


def _log(c):
    return f"ln(1 + greatest({c}, 0))"


def _div(a, c, eps="1e-6"):
    return f"({a}) / ({c} + {eps}::DOUBLE)"


_DISTANCE_SQL = {
    "Euclidean_Distance_To_Hydrology": _W,
    "Manhattan_Distance_To_Hydrology": f"abs({_HH}) + abs({_VH})",
    "Accessibility_Index_To_Hydrology": f"{_HH} + abs({_VH})",
    "Accessibility_Index": f"{_ROAD} + {_FIRE} + {_W}",
    "Total_Distance_to_Infrastructure": f"{_W} + {_ROAD}",
    "Human_Proximity_Index": f"{_ROAD} + {_FIRE}",
    "Total_Horizontal_Distance": f"{_HH} + {_ROAD} + {_FIRE}",
    "Total_Horizontal_Distance_logs": f"{_log(_HH)} + {_log(_ROAD)} + {_log(_FIRE)}",
    "log1p_Total_Horizontal_Distance": _log(f"{_HH} + {_ROAD} + {_FIRE}"),
    "Proximity_to_Infrastructure": f"least({_ROAD}, {_FIRE})",
    "Min_Distance_to_Major_Features": f"least({_HH}, {_ROAD}, {_FIRE})",
    "Hydrology_Angle": f"atan2({_VH}, {_HH})",
    "Relative_Elevation_to_Hydrology": f"Elevation - {_VH}",
    "Elevation_Vertical_Hydrology": f"Elevation + {_VH}",
    "Elevation_HD_Roadways": f"Elevation + {_ROAD}",
    "Elevation_HD_Firepoints": f"Elevation + {_FIRE}",
    "Elevation_Road_Diff": f"Elevation - {_ROAD}",
    "Hydro_Difference": f"{_HH} - {_VH}",
    "Hydro_Sum": f"{_HH} + {_VH}",
    "Horizontal_Distance_To_Hydrology_log": _log(_HH),
    "Horizontal_Distance_To_Roadways_log": _log(_ROAD),
    "Horizontal_Distance_To_Fire_Points_log": _log(_FIRE),
}

_SHADE_RECIPES_SQL = {
    "Hillshade_Index": " + ".join(_H),
    "Hillshade_Diff_9_Noon": f"{_H[0]} - {_H[1]}",
    "Hillshade_9am_Noon_diff": f"{_H[1]} - {_H[0]}",
    "Hillshade_Diff_Noon_3pm": f"{_H[1]} - {_H[2]}",
    "Hillshade_Diff_9_3pm": f"{_H[0]} - {_H[2]}",
    "Hillshade_Daily_Range": f"abs({_H[0]} - {_H[2]})",
    "Hillshade_Night": f"({_H[0]} + {_H[2]}) / 2 - {_H[1]}",
    "Hillshade_composite": f"({_H[0]} + {_H[1]} + {_H[2]}) / 3",
    "Hillshade_Range": f"list_max({_HLIST}) - list_min({_HLIST})",
    "Hillshade_Variation": f"list_stddev_samp({_HLIST})",
    "Aspect_rad": "radians(Aspect)",
    "Slope_rad": "radians(Slope)",
    "Aspect_sin": "sin(radians(Aspect))",
    "Aspect_cos": "cos(radians(Aspect))",
    "Slope_sin": "sin(radians(Slope))",
    "Slope_cos": "cos(radians(Slope))",
    "Aspect_normalized": "Aspect / 360",
    "Aspect_shifted": "(Aspect + 22.5) % 360",
    "Northness": "cos(radians(Aspect)) * sin(radians(Slope))",
    "Eastness": "sin(radians(Aspect)) * sin(radians(Slope))",
    "Slope_Aspect_sin": "Slope * sin(radians(Aspect))",
    "Slope_Aspect_cos": "Slope * cos(radians(Aspect))",
    "Elevation_Slope_Aspect_Interaction_sin": "Elevation * Slope * sin(radians(Aspect))",
    "Elevation_Slope_Aspect_Interaction_cos": "Elevation * Slope * cos(radians(Aspect))",
}

_PRODUCT_SQL = {
    "Elevation_x_Slope": "Elevation * Slope",
    "Elevation_x_Hydrology_Distance": f"Elevation * {_W}",
    "Elevation_x_Fire_Distance": f"Elevation * {_FIRE}",
    "Elevation_HDTH": f"Elevation * {_HH}",
    "Elevation_x_Aspect": "Elevation * Aspect",
    "Elevation_x_Vertical_Hydrology": f"Elevation * {_VH}",
    "Elevation_x_Hillshade_Index": f"Elevation * ({' + '.join(_H)})",
    "Roadways_Elevation_Interaction": f"{_ROAD} * Elevation",
    "Slope_x_Aspect": "Slope * Aspect",
    "Slope_x_Hydrology_Distance": f"Slope * {_W}",
    "Slope_x_Hillshade_Index": f"Slope * ({' + '.join(_H)})",
    "Slope_x_Horizontal_Distance_To_Hydrology": f"Slope * {_HH}",
    "Slope_x_Vertical_Distance_To_Hydrology": f"Slope * {_VH}",
    "Aspect_x_Hydrology_Distance": f"Aspect * {_W}",
    "Aspect_x_Hillshade_Index": f"Aspect * ({' + '.join(_H)})",
    "Hydro_Horizontal_Interaction": f"{_HH} * {_VH}",
    "Hydro_Road_Proximity": f"{_HH} * {_ROAD}",
    "Hydro_Road_Interaction_log": f"{_HH} * {_log(_ROAD)}",
    "Road_Fire_Interaction": f"{_ROAD} * {_FIRE}",
    "Elevation_squared": "Elevation * Elevation",
    "Slope_squared": "Slope * Slope",
    "Hydrology_Distance_squared": f"{_HH} * {_HH} + {_VH} * {_VH}",
    "Hydro_Horizontal_Squared": f"{_HH} * {_HH}",
    "Hydro_Vertical_Squared": f"{_VH} * {_VH}",
    "Hillshade_9am_squared": f"{_H[0]} * {_H[0]}",
    "Hillshade_Noon_squared": f"{_H[1]} * {_H[1]}",
    "Hillshade_3pm_squared": f"{_H[2]} * {_H[2]}",
}

_RATIO_SQL = {
    "Elevation_to_Hydrology_Ratio": _div("Elevation", _W),
    "Hydrology_Road_Ratio": _div(_W, _ROAD),
    "Steepness_Near_Water": _div("Slope", _W),
    "Elevation_Gradient_to_Roads": _div("Elevation", _ROAD),
    "Hydrology_Fire_Risk": _div(_FIRE, _HH, "1"),
    "Hydro_Road_Proximity_Ratio": _div(_HH, _ROAD),
}


def _recipes(spark, sf_dir, names, digits):
    derived = terrain.derive(_terrain(spark, sf_dir), list(names))
    return derived.select(*LINE_KEY, *[rounded(n, digits).alias(n) for n in names])


@CHECKS.add(_sql(_DISTANCE_SQL, 8, _TERRAIN_SQL))
def terrain_distances(spark, sf_dir):
    return _recipes(spark, sf_dir, _DISTANCE_SQL, 8)


@CHECKS.add(_sql(_SHADE_RECIPES_SQL, 5, _TERRAIN_SQL))
def terrain_shades_and_angles(spark, sf_dir):
    return _recipes(spark, sf_dir, _SHADE_RECIPES_SQL, 5)


@CHECKS.add(_sql(_PRODUCT_SQL, 6, _TERRAIN_SQL))
def terrain_products(spark, sf_dir):
    return _recipes(spark, sf_dir, _PRODUCT_SQL, 6)


@CHECKS.add(_sql(_RATIO_SQL, 4, _TERRAIN_SQL))
def terrain_ratios(spark, sf_dir):
    return _recipes(spark, sf_dir, _RATIO_SQL, 4)


@CHECKS.add(
    _sql(
        {_H[0]: "greatest(least((sin(radians(60)) * cos(radians(Slope)) + cos(radians(60)) * sin(radians(Slope)) * cos(radians(105) - radians(Aspect))) * 255, 255), 0)"}
        | {c: _log(c) for c in (_HH, _ROAD, _FIRE)},
        5,
        _TERRAIN_SQL,
    )
)
def terrain_overwrites(spark, sf_dir):
    """Recipes that put a new value in the place of a measured column."""
    changed = terrain.overwrite(terrain.overwrite(_terrain(spark, sf_dir), "hillshade_B"), "log_distances")
    return _out(changed, [_H[0], _HH, _ROAD, _FIRE], 5)
