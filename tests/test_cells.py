"""Tree learners on collapsed rows: what they read does not grow with copies, and what they learn does not change."""

import pytest
from pyspark.sql import functions as F

from stratafold.plans import learners as m
from stratafold.plans.cells import TIMES, Cells, bootstrapped, sampled

from conftest import rows

XZ, CLASSES = ["x", "z"], [1, 2, 3]


@pytest.fixture(scope="module")
def many(spark):
    x, z = F.pmod(F.xxhash64("id"), F.lit(50)).cast("double"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(40)).cast("double")
    y = F.when((F.col("x") > 25) & (F.col("z") > 20), 3).when(F.col("z") > 20, 2).otherwise(1)
    odd = F.when(F.col("id") % 97 == 0, F.lit(float("nan"))).when(F.col("id") % 101 == 0, F.lit(None)).otherwise(x)
    return spark.range(20_000).withColumns({"x": odd, "z": z}).withColumn("y", y)


def test_equal_bins_are_one_row_that_counts_them(many):
    cells = Cells(many, XZ)
    held = cells.collapsed(many, ["y"])
    assert held.count() < 3_500 and held.agg(F.sum(TIMES)).first()[0] == 20_000
    twice = cells.collapsed(many.union(many), ["y"])
    assert twice.count() == held.count() and twice.agg(F.sum(TIMES)).first()[0] == 40_000


def test_bins_hold_their_upper_edge_and_missing_values_their_own(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    cells = Cells(df.where("x in (0.0, 1.0)"), ["x"])
    got = [(r.x, r.b) for r in cells.placed(df).select("x", F.col("_vector").cast("string").alias("b")).collect()]
    at = {repr(x): b for x, b in got}
    assert at["None"] == at["nan"] and len({at["0.0"], at["1.0"], at["nan"]}) == 3 and at["-inf"] == at["0.0"] != at["inf"]


def test_draws_have_the_numbers_of_single_rows_and_agree_on_reruns(many):
    held = Cells(many, XZ).collapsed(many, ["y"])
    one = lambda: held.select(F.sum(bootstrapped(7, 4)[0]), F.sum(bootstrapped(7, 4)[3]), F.sum(sampled(7, 0.8))).first()
    a = one()
    assert tuple(a) == tuple(one()) and a[0] != a[1]
    assert abs(a[0] - 20_000) < 700 and abs(a[1] - 20_000) < 700 and abs(a[2] - 16_000) < 300


@pytest.mark.parametrize("learner", [
    m.forest(XZ, "y", CLASSES, trees=4, depth=5, min_leaf=5),
    m.boosted(XZ, "y", CLASSES, rounds=2, rate=0.3, depth=2, subsample=0.8),
    m.boosted(XZ, "y", CLASSES, rounds=2, rate=0.3, depth=2, subsample=0.8, validation="judge"),
], ids=["forest", "sampled", "validated"])
def test_learners_learn_from_cells(many, learner):
    scored = learner(many.withColumn("judge", F.col("id") % 5 == 0))(many)
    assert scored.where("prediction = y").count() > 0.93 * 20_000
    assert scored.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0


def test_a_leaf_has_at_least_min_leaf_rows_not_cells(spark):
    """Thirty rows of one cell are a leaf, a single one is not."""
    fit = m.forest(["x"], "y", [1, 2], trees=3, depth=2, min_leaf=5, features="all")
    for few, split in ((1, False), (30, True)):
        df = spark.createDataFrame([(0.0, 1)] * 40 + [(1.0, 2)] * few, "x double, y int")
        p = rows(fit(df)(spark.createDataFrame([(0.0,), (1.0,)], "x double")), "x", "probability")
        assert (p[0][1] != p[1][1]) == split
