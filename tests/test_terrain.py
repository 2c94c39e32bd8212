from pyspark.sql import functions as F

from stratafold.plans import terrain
from stratafold.plans.registry import FeatureRegistry

import pytest


@pytest.fixture(scope="module")
def land(spark):
    row = [1, 2596, 51, 3, 258, 0, 510, 221, 232, 148, 6279] + [1, 0, 0, 0] + [0] * 28 + [1] + [0] * 11 + [5]
    return spark.createDataFrame([tuple(row)], terrain.LABELLED_SCHEMA)


def test_schema():
    assert len(terrain.LABELLED_SCHEMA) == 56 and len(terrain.UNLABELLED_SCHEMA) == 55


def test_every_recipe_in_one_projection(land):
    names = terrain.recipe_names()
    assert len(names) == len(set(names)) > 120
    names = list({n.lower(): n for n in names}.values())  # column names do not differ by case alone
    derived = terrain.derive(land, names)
    got = derived.first().asDict()
    assert got["Euclidean_Distance_To_Hydrology"] == 258.0
    assert got["Hillshade_Index"] == 601.0
    assert got["Hillshade_composite"] == pytest.approx(601 / 3)
    assert got["Elevation_x_Slope"] == 7788.0
    assert got["Hydrology_Fire_Risk"] == pytest.approx(6279 / 259)
    assert got["Aspect_direction"] == "NE"
    assert got["Hydrology_Angle"] == 0.0
    assert derived._jdf.queryExecution().optimizedPlan().toString().count("Project") == 1


def test_recipe_by_name(land):
    assert land.select(terrain.recipe("Elevation_sq")).first()[0] == 2596.0**2
    with pytest.raises(KeyError):
        terrain.recipe("nothing")


def test_soil_interactions_are_200_columns(land):
    wide = land.select("*", *terrain.soil_interactions())
    assert len(wide.columns) == 56 + 200
    got = wide.first().asDict()
    assert got["Soil_Type29_x_Elevation"] == 2596 and got["Soil_Type29_x_Wilderness_Area1"] == 1 and got["Soil_Type1_x_Elevation"] == 0


def test_overwrites(land):
    assert terrain.overwrite(land, "log_roads").first()["Horizontal_Distance_To_Roadways"] == pytest.approx(6.2363696)
    for kind in ("hillshade_A", "hillshade_B", "clip_distances", "log_distances"):
        assert terrain.overwrite(land, kind).columns == land.columns
    with pytest.raises(KeyError):
        terrain.overwrite(land, "other")


def test_zero_if_missing(land):
    empty = land.withColumns({c: F.lit(None).cast("int") for c in ("Hillshade_9am", "Hillshade_Noon", "Hillshade_3pm")})
    assert empty.select(terrain.zero_if_missing("Hillshade_Variation")).first()[0] == 0.0


def test_registry_flags(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    registry = (
        FeatureRegistry()
        .add("sum", lambda: [(F.col("a") + F.col("b")).alias("s")], drops=["b"])
        .add("twice", lambda: [(F.col("s") * 2).alias("t")], after=["sum"])
        .add("other", lambda: [F.lit(0).alias("z")])
    )
    assert registry.apply(df, ["twice", "sum"]).first().asDict() == {"a": 2.0, "s": 5.0, "t": 10.0}
    assert registry.apply(df, []).columns == ["a", "b"]
    assert set(registry.apply(df).columns) == {"a", "s", "t", "z"}
    with pytest.raises(KeyError):
        registry.apply(df, ["nope"])
    with pytest.raises(ValueError):
        registry.add("sum", lambda: [])


def test_registry_rejects_cycles(spark):
    registry = FeatureRegistry().add("a", lambda: [], after=["b"]).add("b", lambda: [], after=["a"])
    with pytest.raises(ValueError):
        registry.apply(spark.range(1))
