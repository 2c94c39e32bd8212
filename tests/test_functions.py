import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratafold.functions import builders as b
from stratafold.functions import scalar as s
from stratafold.operators.scaling import assemble_sparse

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(1, 1.0), (2, None), (3, NAN), (4, INF), (5, -INF), (6, -2.5)], "id int, x double")


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column.alias("v")).collect()]


def test_missing_infinite_finite(odd):
    assert values(odd, s.is_missing("x")) == [False, True, True, False, False, False]
    assert values(odd, s.is_infinite("x")) == [False, False, False, True, True, False]
    assert values(odd, s.is_finite("x")) == [True, False, False, False, False, True]


def test_clip_keeps_missing(odd):
    got = values(odd, s.clip("x", -1, 1))
    assert got[0] == 1 and got[1] is None and math.isnan(got[2]) and got[3:] == [1, -1, -1]
    assert values(odd, s.log1p_clipped("x"))[-1] == 0


def test_divide_follows_floating_point(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, -1.0, 0.0), (3, 0.0, 0.0), (4, 1.0, 4.0), (5, None, 0.0)], "id int, a double, b double")
    got = values(df, s.divide("a", "b"))
    assert got[0] == INF and got[1] == -INF and math.isnan(got[2]) and got[3] == 0.25 and got[4] is None


def test_floored_mod(spark):
    df = spark.createDataFrame([(1, -10.5), (2, 370.0), (3, 0.0)], "id int, x double")
    assert values(df, s.floored_mod("x", 360)) == [349.5, 10.0, 0.0]


def test_integers_are_widened(spark):
    df = spark.createDataFrame([(1, 2_000_000_000)], "id int, x int")
    assert values(df, b.power("x")) == [4e18]


def test_row_statistics_match_pandas(spark):
    data = [(1, 1.0, 2.0, 4.0), (2, None, 5.0, 7.0), (3, NAN, NAN, 3.0), (4, 2.0, 2.0, 2.0)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double")
    pdf = pd.DataFrame([r[1:] for r in data], columns=list("abc"))
    for kind, want in {"mean": pdf.mean(axis=1), "std": pdf.std(axis=1), "min": pdf.min(axis=1), "max": pdf.max(axis=1)}.items():
        got = values(df, b.ROW_STATS[kind](["a", "b", "c"]))
        assert np.allclose([NAN if v is None else v for v in got], want.to_numpy(), equal_nan=True), kind


def test_cut_is_right_open(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 9.9), (4, 10.0), (5, -0.1), (6, NAN), (7, None)], "id int, x double")
    assert values(df, s.cut("x", [0, 5, 10], ["a", "b"])) == ["a", "b", "b", None, None, None, None]


def test_compass_wraps_around_north(spark):
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate([0, 22.4, 22.5, 90, 337.4, 337.5, 359, -45, 405])], "id int, x double")
    assert values(df, b.compass_bin("x")) == ["N", "N", "NE", "E", "NW", "N", "N", "NW", "NE"]


def test_hillshade_forms(spark):
    df = spark.createDataFrame([(1, 135.0, 30.0), (2, 0.0, 0.0)], "id int, a double, s double")
    rad = math.radians

    def form_a(a, sl, az, alt):
        v = 255 * (math.cos(rad(alt)) * math.sin(rad(sl)) + math.sin(rad(alt)) * math.cos(rad(sl)) * math.cos(rad(az) - rad(a)))
        return min(max(v, 0), 255)

    def form_b(a, sl, az, alt):
        v = 255 * (math.sin(rad(alt)) * math.cos(rad(sl)) + math.cos(rad(alt)) * math.sin(rad(sl)) * math.cos(rad(az) - rad(a)))
        return min(max(v, 0), 255)

    assert values(df, b.hillshade("a", "s", 315, 45, "A")) == pytest.approx([form_a(135, 30, 315, 45), form_a(0, 0, 315, 45)])
    assert values(df, b.hillshade("a", "s", 105, 60, "B")) == pytest.approx([form_b(135, 30, 105, 60), form_b(0, 0, 105, 60)])


def test_fixed_format_matches_python(spark):
    rng = random.Random(7)
    numbers = [1.95, 0.25, 0.35, 2.5, 1e-7, 0.0, 59.95, 10.85, 0.125, 123456.789, -1.005, 0.000005, 0.999995]
    numbers += [rng.uniform(0, 4000) for _ in range(300)] + [rng.randint(0, 10**6) / 20 for _ in range(300)] + [rng.randint(0, 10**7) / 2e6 for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(numbers)), "id int, x double")
    for digits in (1, 2, 5):
        assert values(df, s.format_fixed("x", digits)) == [f"{x:.{digits}f}" for x in numbers]


def test_seconds_and_scores(spark):
    df = spark.createDataFrame([(1, 5400.0), (2, 117.0), (3, 3.25), (4, None)], "id int, x double")
    assert values(df, s.format_seconds("x")) == ["1.50h", "1.9m", "3.2s", "-"]
    assert values(df, s.format_score("x"))[2:] == ["3.25000", "-"]


def test_first_line(spark):
    df = spark.createDataFrame([(1, "  a b \r\nc"), (2, " \n "), (3, None), (4, "x" * 80)], "id int, x string")
    assert values(df, s.first_line("x")) == ["a b ", None, None, "x" * 60]


def test_probability_helpers(spark):
    df = spark.createDataFrame([(1, [0.4, 0.4, 0.2], [0.0, 0.2, 0.8])], "id int, p array<double>, q array<double>")
    assert values(df, s.argmax("p")) == [0]
    assert values(df, s.mix(["p", "q"]))[0] == pytest.approx([0.2, 0.3, 0.5])
    assert values(df, s.mix(["p", "q"], [0.25, 0.75]))[0] == pytest.approx([0.1, 0.25, 0.65])
    assert values(df, s.expand_slots("p", [1, 2, 4], [1, 2, 3, 4]))[0] == [0.4, 0.4, 0.0, 0.2]
    assert values(df, s.decode(s.argmax("q"), [5, 6, 7])) == [7]
    assert values(df, s.one_hot(F.lit(6), [5, 6, 7]))[0] == [0.0, 1.0, 0.0]


def test_number_texts_of_large_and_non_finite_values(spark):
    values = [1e14, 123456789012345678.0, float("inf"), float("-inf"), float("nan"), -1e15, 1.95, 0.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").orderBy("id")
    assert [r[0] for r in df.select(s.format_score("v")).collect()] == [*(f"{v:.5f}" for v in values[:-1]), "-"]
    assert [r[0] for r in df.select(s.format_seconds("v")).collect()][:3] == ["27777777777.78h", f"{values[1] / 3600:.2f}h", "infh"]


def test_sparse_crosses_equal_the_dense_ones(spark):
    groups = [f"a{i}" for i in range(5)], [f"b{i}" for i in range(4)]
    rng = random.Random(2)
    data = [(i, *[rng.choice([0.0, 0.0, 0.0, 1.0, 2.5, None]) for _ in range(9)]) for i in range(60)]
    df = spark.createDataFrame(data, "id long, " + ", ".join(f"{c} double" for g in groups for c in g))
    crossed = df.select("id", "a0", *b.indicator_cross(*groups), b.sparse_cross(*groups).alias("one"), b.sparse_cross(groups[1], ["a0"]).alias("two"))
    packed = assemble_sparse(crossed, ["a0"], ["one", "two"])
    names = [f"{x}_x_{y}" for x in groups[0] for y in groups[1]]
    for r in packed.collect():
        dense = [r["a0"] or 0.0, *[r[n] or 0.0 for n in names], *[r[f"a0_x_{y}"] or 0.0 for y in groups[1]]]  # the second cross, the other way round, has the products of a0
        assert r.features.size == 1 + 20 + 4 and r.features.toArray().tolist() == dense
        assert len(r.features.values) == sum(x != 0 for x in dense)  # 12 bytes for each of these
    with pytest.raises(ValueError):
        b.sparse_cross([], ["a0"])
    with pytest.raises(ValueError):
        b.sparse_cross(["a"] * 1001, ["b"] * 1000)
