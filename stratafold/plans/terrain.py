"""Feature recipes for the forest cover table (terrain measures plus two indicator groups)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import builders as b
from ..functions.scalar import is_missing, num, row_mean, row_min, row_range, row_std

# The columns of the labelled table, in file order.
MEASURES = [
    "Elevation",
    "Aspect",
    "Slope",
    "Horizontal_Distance_To_Hydrology",
    "Vertical_Distance_To_Hydrology",
    "Horizontal_Distance_To_Roadways",
    "Hillshade_9am",
    "Hillshade_Noon",
    "Hillshade_3pm",
    "Horizontal_Distance_To_Fire_Points",
]
WILDERNESS = [f"Wilderness_Area{i}" for i in range(1, 5)]
SOIL = [f"Soil_Type{i}" for i in range(1, 41)]
KEY, LABEL = "Id", "Cover_Type"

UNLABELLED_SCHEMA = StructType(
    [StructField(KEY, LongType())] + [StructField(c, IntegerType()) for c in MEASURES + WILDERNESS + SOIL]
)
LABELLED_SCHEMA = StructType(UNLABELLED_SCHEMA.fields + [StructField(LABEL, IntegerType())])

_ELEV, _ASPECT, _SLOPE = "Elevation", "Aspect", "Slope"
_HH, _VH = "Horizontal_Distance_To_Hydrology", "Vertical_Distance_To_Hydrology"
_ROAD, _FIRE = "Horizontal_Distance_To_Roadways", "Horizontal_Distance_To_Fire_Points"
_SHADES = ["Hillshade_9am", "Hillshade_Noon", "Hillshade_3pm"]
_H9, _H12, _H15 = _SHADES


def _water() -> Column:
    return b.euclidean(_HH, _VH)


def _minus(x, y) -> Column:
    return num(x) - num(y)


def _trig(fn, c: str) -> Column:
    return fn(b.angle(c))


def _recipes() -> list[tuple[list[str], Column]]:
    """Every name a derived column goes by, with its one expression."""
    sin_a, cos_a = _trig(F.sin, _ASPECT), _trig(F.cos, _ASPECT)
    log_road = b.log1p_nonneg(_ROAD)
    return [
        # distances
        (
            [
                "Distance_To_Hydrology",
                "Euclidean_Distance_To_Hydrology",
                "Hydrology_Distance",
                "Total_Hydrology_Distance",
                "Distance_to_Hydrology",
                "Distance_To_Hydrology_Euclidean",
                "Total_Distance_To_Hydrology",
            ],
            _water(),
        ),
        (["Manhattan_Distance_To_Hydrology", "Hydrology_Manhattan_Distance"], b.manhattan(_HH, _VH)),
        (["Accessibility_Index_To_Hydrology"], num(_HH) + F.abs(num(_VH))),
        (["Accessibility_Index"], b.combine([_ROAD, _FIRE, _water()])),
        (["Total_Distance_to_Infrastructure"], b.combine([_water(), _ROAD])),
        (["Human_Proximity_Index", "Proximity_To_Human_Features"], b.combine([_ROAD, _FIRE])),
        (["Total_Horizontal_Distance", "Total_Horizontal_Proximity"], b.combine([_HH, _ROAD, _FIRE])),
        (["Total_Horizontal_Distance_logs"], b.log1p_nonneg(_HH, _ROAD, _FIRE)),
        (["log1p_Total_Horizontal_Distance"], b.log1p_nonneg(b.combine([_HH, _ROAD, _FIRE]))),
        (["Proximity_to_Infrastructure"], row_min([_ROAD, _FIRE])),
        (["Min_Distance_to_Major_Features"], row_min([_HH, _ROAD, _FIRE])),
        (["Hydrology_Angle"], b.bearing(_VH, _HH)),
        # sums and differences
        (
            [
                "Hydro_Elevation_Diff",
                "Elevation_Relative_To_Hydrology",
                "Elevation_Minus_Vertical_Hydrology",
                "Relative_Elevation_to_Hydrology",
                "Elevation_Above_Hydrology",
                "Elevation_at_Hydrology",
            ],
            _minus(_ELEV, _VH),
        ),
        (["Elevation_Vertical_Hydrology", "Elevation_Hydro_Interaction"], b.combine([_ELEV, _VH])),
        (["Elevation_HD_Roadways", "Elevation_Road_Interaction"], b.combine([_ELEV, _ROAD])),
        (["Elevation_HD_Firepoints", "Elevation_Fire_Interaction"], b.combine([_ELEV, _FIRE])),
        (["Elevation_Road_Diff"], _minus(_ELEV, _ROAD)),
        (["Hydro_Difference", "Hydro_Distance_Difference"], _minus(_HH, _VH)),
        (["Hydro_Sum"], b.combine([_HH, _VH])),
        (["Hillshade_Sum", "Hillshade_9am_Noon_3pm_sum", "Hillshade_Index"], b.combine(_SHADES)),
        (["Hillshade_Diff_9_Noon", "Hillshade_diff_9am_noon"], _minus(_H9, _H12)),
        (["Hillshade_9am_Noon_diff"], _minus(_H12, _H9)),
        (
            [
                "Hillshade_Diff_Noon_3pm",
                "Hillshade_Noon_3pm_diff",
                "Hillshade_diff_noon_3pm",
                "Hillshade_Noon_minus_3pm",
                "Hillshade_Noon_to_3pm_Diff",
            ],
            _minus(_H12, _H15),
        ),
        (
            [
                "Hillshade_Diff_9_3pm",
                "Hillshade_diff_9am_3pm",
                "Hillshade_Diurnal_Change",
                "Hillshade_9am_minus_3pm",
                "Hillshade_Morning_vs_Afternoon",
            ],
            _minus(_H9, _H15),
        ),
        (["Hillshade_Daily_Range", "Hillshade_Difference_9am_3pm", "Hillshade_Daily_Difference"], F.abs(_minus(_H9, _H15))),
        (["Hillshade_Night"], b.combine([_H9, _H15]) / 2.0 - num(_H12)),
        # row statistics of the three hillshades
        (
            [
                "Hillshade_Mean",
                "Hillshade_mean",
                "Hillshade_9am_Noon_3pm_mean",
                "Mean_Hillshade",
                "Average_Hillshade",
                "Hillshade_composite",
            ],
            row_mean(_SHADES),
        ),
        (["Hillshade_Range"], row_range(_SHADES)),
        (["Hillshade_Variation", "Hillshade_Std"], row_std(_SHADES)),
        # products
        (
            [
                "Elevation_x_Slope",
                "Elevation_Slope",
                "Elevation_Slope_Product",
                "Elevation_Slope_Interaction",
                "Elevation_times_Slope",
                "Elevation_Times_Slope",
            ],
            b.interaction(_ELEV, _SLOPE),
        ),
        (
            ["Elevation_x_Hydro_Dist", "Elevation_x_Hydrology_Distance", "Elevation_Hydrology_Interaction"],
            b.interaction(_ELEV, _water()),
        ),
        (["Elevation_x_Fire_Dist", "Elevation_x_Fire_Distance", "Elevation_x_Fire_Points"], b.interaction(_ELEV, _FIRE)),
        (["Elevation_HDTH", "Elevation_Wetness_Index"], b.interaction(_ELEV, _HH)),
        (["Elevation_x_Aspect"], b.interaction(_ELEV, _ASPECT)),
        (["Elevation_x_Vertical_Hydrology"], b.interaction(_ELEV, _VH)),
        (["Elevation_x_Hillshade_Index"], b.interaction(_ELEV, b.combine(_SHADES))),
        (["Roadways_Elevation_Interaction"], b.interaction(_ROAD, _ELEV)),
        (["Slope_x_Aspect"], b.interaction(_SLOPE, _ASPECT)),
        (["Slope_x_Hydrology_Distance", "Slope_x_Euclidean_Distance_To_Hydrology"], b.interaction(_SLOPE, _water())),
        (["Slope_x_Hillshade_Index"], b.interaction(_SLOPE, b.combine(_SHADES))),
        (["Slope_x_Horizontal_Distance_To_Hydrology", "Slope_Hydro_Interaction"], b.interaction(_SLOPE, _HH)),
        (["Slope_x_Vertical_Distance_To_Hydrology"], b.interaction(_SLOPE, _VH)),
        (["Aspect_x_Hydrology_Distance"], b.interaction(_ASPECT, _water())),
        (["Aspect_x_Hillshade_Index"], b.interaction(_ASPECT, b.combine(_SHADES))),
        (["Hydro_Horizontal_Interaction"], b.interaction(_HH, _VH)),
        (["Hydro_Road_Proximity", "Hydro_Road_Interaction"], b.interaction(_HH, _ROAD)),
        (["Hydro_Road_Interaction_log"], b.interaction(_HH, log_road)),
        (["Remoteness_Fire_Risk", "Road_Fire_Interaction", "Roadways_x_Fire_Distance"], b.interaction(_ROAD, _FIRE)),
        # ratios
        (["Elevation_to_Hydrology_Ratio"], b.ratio(_ELEV, _water())),
        (["Hydrology_Road_Ratio"], b.ratio(_water(), _ROAD)),
        (["Steepness_Near_Water"], b.ratio(_SLOPE, _water())),
        (["Hydrology_Gradient"], b.ratio(_VH, _HH)),
        (["Elevation_Gradient_to_Roads"], b.ratio(_ELEV, _ROAD)),
        (["Hydrology_Fire_Risk"], b.ratio(_FIRE, _HH, 1.0)),
        (["Hydro_Road_Proximity_Ratio"], b.ratio(_HH, _ROAD)),
        # squares and logs
        (["Elevation_squared", "Elevation_sq"], b.power(_ELEV)),
        (["Slope_squared"], b.power(_SLOPE)),
        (["Hydrology_Distance_squared"], b.power(_HH) + b.power(_VH)),
        (["Hydro_Horizontal_Squared", "Horizontal_Distance_To_Hydrology_sq"], b.power(_HH)),
        (["Hydro_Vertical_Squared", "Vertical_Distance_To_Hydrology_sq"], b.power(_VH)),
        (["Hillshade_9am_squared"], b.power(_H9)),
        (["Hillshade_Noon_squared"], b.power(_H12)),
        (["Hillshade_3pm_squared"], b.power(_H15)),
        (["Horizontal_Distance_To_Hydrology_log"], b.log1p_nonneg(_HH)),
        (["Horizontal_Distance_To_Roadways_log"], log_road),
        (["Horizontal_Distance_To_Fire_Points_log"], b.log1p_nonneg(_FIRE)),
        # angles
        (["Aspect_rad"], b.angle(_ASPECT)),
        (["Slope_rad"], b.angle(_SLOPE)),
        (["Aspect_sin", "sin_Aspect"], sin_a),
        (["Aspect_cos", "cos_Aspect"], cos_a),
        (["Slope_sin"], _trig(F.sin, _SLOPE)),
        (["Slope_cos"], _trig(F.cos, _SLOPE)),
        (["Aspect_normalized"], b.scale_by(_ASPECT, 360)),
        (["Aspect_shifted"], b.floored_mod(num(_ASPECT) + F.lit(22.5), 360)),
        (["Aspect_direction"], b.compass_bin(_ASPECT)),
        (["Northness"], b.northness(_ASPECT, _SLOPE)),
        (["Eastness"], b.eastness(_ASPECT, _SLOPE)),
        (
            ["Aspect_sin_Slope", "Slope_Eastness", "Slope_Aspect_Sin", "Slope_Aspect_sin", "Slope_x_Aspect_sin"],
            b.slope_weighted(_ASPECT, _SLOPE, "sin"),
        ),
        (
            ["Aspect_cos_Slope", "Slope_Northness", "Slope_Aspect_Cos", "Slope_Aspect_cos", "Slope_x_Aspect_cos"],
            b.slope_weighted(_ASPECT, _SLOPE, "cos"),
        ),
        (["Elevation_Slope_Aspect_Interaction_sin"], b.interaction(_ELEV, _SLOPE, sin_a)),
        (["Elevation_Slope_Aspect_Interaction_cos"], b.interaction(_ELEV, _SLOPE, cos_a)),
    ]


def recipe(name: str) -> Column:
    """The derived terrain column of that name."""
    for names, expression in _recipes():
        if name in names:
            return expression.alias(name)
    raise KeyError(f"no terrain feature named {name!r}")


def recipe_names() -> list[str]:
    return [name for names, _ in _recipes() for name in names]


def derive(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the named terrain features in one projection. Spark tells columns apart regardless of case."""
    by_name = {name: expression for known, expression in _recipes() for name in known}
    return df.withColumns({name: by_name[name] for name in names})


def overwrite(df: DataFrame, kind: str) -> DataFrame:
    """The recipes that replace measured columns in place.

    ``hillshade_A`` / ``hillshade_B`` recompute the three hillshades; ``clip_distances`` cuts the
    distances at zero; ``log_distances`` and ``log_roads`` put logs of clipped distances in their place.
    """
    if kind in ("hillshade_A", "hillshade_B"):
        sun = b.SUN[kind[-1]]
        at = zip(_SHADES, sun["azimuths"].values())
        return df.withColumns({c: b.hillshade(_ASPECT, _SLOPE, az, sun["altitude"], kind[-1]) for c, az in at})
    if kind == "clip_distances":
        return df.withColumns({c: b.clip(c, low=0) for c in (_HH, _VH, _ROAD, _FIRE)})
    if kind == "log_distances":
        return df.withColumns({c: b.log1p_nonneg(c) for c in (_HH, _ROAD, _FIRE)})
    if kind == "log_roads":
        return df.withColumns({_ROAD: b.log1p_nonneg(_ROAD)})
    raise KeyError(f"no overwrite named {kind!r}")


def soil_interactions() -> list[Column]:
    """Each soil indicator times elevation and times each wilderness indicator: 40 + 160 columns."""
    return b.indicator_cross(SOIL, [_ELEV]) + b.indicator_cross(SOIL, WILDERNESS)


def zero_if_missing(name: str) -> Column:
    """A recipe with 0 for missing (used for the hillshade variation)."""
    column = next(e for names, e in _recipes() if name in names)
    return F.when(is_missing(column), F.lit(0.0)).otherwise(column).alias(name)
