import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import Window, functions as F

from stratafold import bounded
from stratafold.operators import aggregates as a
from stratafold.operators import folds as f
from stratafold.operators import rare as ra
from stratafold.operators import scaling as sc
from stratafold.operators.folds import with_group_rank

INF, NAN = float("inf"), float("nan")


# --- aggregates ---


def test_counts_and_majority_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "y string")
    assert [tuple(r) for r in a.class_counts(df.where("y is not null"), "y").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert a.majority_class(df, "y").first()[0] == "a"
    assert a.majority_class(df.limit(0), "y").first()[0] is None
    assert a.n_classes(df, "y").first()[0] == 3


def test_scores(spark):
    preds = spark.createDataFrame(
        [(0, 0, 1, 1), (0, 0, 1, 2), (0, 1, 1, 1), (1, 0, 2, 2), (1, 1, 2, None)], "run int, fold int, y int, p int"
    )
    assert rows(a.accuracy(preds, "y", "p", ["run", "fold"])) == [(0, 0, 0.5), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0)]
    assert a.cv_score(preds.where("run = 0"), "y", "p").first()[0] == 0.75
    assert a.repeated_cv_score(preds, "y", "p").first()[0] == 0.625
    assert a.pooled_oof_score(preds, "y", "p").first()[0] == 0.75
    assert a.pooled_oof_score(preds.where("p is null"), "y", "p").first()[0] == 0.0


def test_excluded_summary_and_presence(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (4, 1)], "y int, fold int")
    assert rows(a.excluded_summary(df, "y", 3)) == [(1, 2, 1, 2, 3), (4, 5, 1, 2, 3)]
    assert rows(a.class_presence(df, "y"), "fold", "y", "n") == [(0, 0, 2), (0, 4, 1), (1, 0, 2), (1, 1, 1), (2, 0, 2), (2, 1, 1), (2, 4, 1)]
    every = spark.createDataFrame([(c,) for c in range(5)], "c int")
    assert rows(a.missing_classes(df, "y", every)) == [(2,), (3,)]


def test_profile(spark):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (INF,), (-INF,), (-3.0,)], "x double").withColumn("e", F.lit(INF))
    assert rows(a.null_inf_profile(df, ["x", "e"])) == [("e", 0, 6, None, None), ("x", 2, 2, -3.0, 1.0)]


def test_medians_equal_pandas(spark):
    rng = random.Random(3)
    data = [(rng.gauss(0, 1), float(rng.randint(0, 3)), 5.0, None if i % 3 else rng.random(), None) for i in range(20_001)]
    df = spark.createDataFrame(data, "g double, few double, one double, holes double, none double").repartition(4)
    pdf = pd.DataFrame(data, columns=["g", "few", "one", "holes", "none"]).astype(float)
    want = pdf.median()
    got = a.exact_medians(df, {c: F.col(c) for c in df.columns})
    assert got["none"] is None
    assert all(got[c] == want[c] for c in ("g", "few", "one", "holes")), got


def test_keys_are_in_the_order_of_the_values():
    values = np.array([-INF, -1e300, -2.0, -1.0, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.5, 1e300, INF])
    keys = a._ordered_keys(values)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[5] == keys[6] and len(set(keys.tolist())) == len(values) - 1
    assert [a._value_of(int(k)) for k in keys] == values.tolist()


def test_medians_of_filled_columns_equal_two_steps(spark):
    rng = random.Random(4)
    for n, odd in ((1, [INF]), (2, [INF, None]), (5, [INF, -INF, None, NAN, None]), (40, [INF] * 30), (41, [None] * 60), (30, [INF, -INF, NAN] * 8), (0, [None, INF]), (0, [None])):
        data = [float(rng.randint(-3, 3)) for _ in range(n)] + odd
        (got,) = a.medians_of_filled(spark.createDataFrame([(x,) for x in data], "x double"), {"x": F.col("x")}).values()
        s = pd.Series(data, dtype=float)
        first = s.median()
        second = s.fillna(first).replace([INF, -INF], NAN).median()
        assert [x if x is not None else NAN for x in got] == pytest.approx([first, second], nan_ok=True), (data, got)


def test_both_medians_take_four_passes(spark, monkeypatch):
    passes = []
    plain = a._digit_counts
    monkeypatch.setattr(a, "_digit_counts", lambda *args: passes.append(args[1]) or plain(*args))
    df = spark.createDataFrame([(rng, None if rng % 3 else 1.0) for rng in map(float, range(50))], "x double, y double")
    a.medians_of_filled(df, {"x": F.col("x"), "y": F.col("y")})
    assert passes == [0, 1, 2, 3]


def test_median_of_even_count_is_the_midpoint(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 10, 20]], "x double")
    assert a.exact_medians(df, {"x": F.col("x")}) == {"x": 6.0}
    inf = spark.createDataFrame([(INF,), (INF,), (1.0,)], "x double")
    assert a.exact_medians(inf, {"x": F.col("x")}) == {"x": INF}


# --- folds ---


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds two thirds of the rows."""
    return spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7 + 1).cast("int").alias("y"))


def test_folds_partition_and_balance(skewed):
    folded = f.stratified_kfold(skewed, ["id"], "y").cache()
    assert folded.count() == 3000 and folded.select("id").distinct().count() == 3000
    sizes = folded.groupBy("y").pivot("fold", [0, 1, 2]).count().fillna(0).collect()
    assert all(max(r["0"], r["1"], r["2"]) - min(r["0"], r["1"], r["2"]) <= 1 for r in sizes)
    folded.unpersist()


def plain_folds(df, k=3, seed=42):
    """Each class in hash order in k runs, the first in the fold where the classes before, in hash order, have ended."""
    table = sorted((r.h, r.c, r.id, r.y) for r in df.select("id", "y", f.hash_order(["id"], seed).alias("h"), f.hash_order(["y"], "class").alias("c")).collect())
    out, start = [], 0
    for c in sorted({c for _, c, _, _ in table}):
        own = [(i, y) for _, d, i, y in table if d == c]
        sizes = [len(own) // k + (i < len(own) % k) for i in range(k)]
        folds = [(start + i) % k for i in range(k) for _ in range(sizes[i])]
        out += [(i, y, fold) for (i, y), fold in zip(own, folds)]
        start += len(own)
    return sorted(out, key=repr)


def test_folds_equal_the_plain_window(skewed):
    assert rows(f.stratified_kfold(skewed, ["id"], "y")) == plain_folds(skewed)
    assert rows(f.stratified_kfold(skewed, ["id"], "y", k=7, seed=1)) == plain_folds(skewed, 7, 1)


def test_cut_points_narrow_by_slices(skewed, monkeypatch):
    monkeypatch.setattr(f, "SLICE_DIGITS", 1)
    monkeypatch.setattr(f, "SLICE_ROWS", 10)
    assert rows(f.stratified_kfold(skewed, ["id"], "y", k=5)) == plain_folds(skewed, 5)


def test_folds_of_more_classes_than_are_fetched(skewed, monkeypatch):
    for module in (f, bounded):
        monkeypatch.setattr(module, "join_small", lambda big, small, on, how="inner": big.join(small, on, how))
    monkeypatch.setattr(f, "local_if_small", lambda df: df)
    assert rows(f.stratified_kfold(skewed, ["id"], "y")) == plain_folds(skewed)
    assert f.stratified_kfold(skewed.limit(0), ["id"], "y").collect() == []


def test_running_total_equals_plain_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.concat(F.lit("c"), "id").alias("c"), (F.col("id") % 11).alias("n"))
    plain = Window.partitionBy("g").orderBy(f.hash_order(["c"], "class")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before", F.coalesce(F.sum("n").over(plain), F.lit(0)))
    assert rows(f.running_total(df, ["g"], ["c"], F.col("n"), "before")) == rows(want)


def test_seeds_change_folds_and_null_labels_stay(spark, skewed):
    one, two = (rows(f.stratified_kfold(skewed, ["id"], "y", seed=s)) for s in (1, 2))
    assert one != two
    holes = skewed.withColumn("y", F.when(F.col("y") > 0, F.col("y")))
    assert f.stratified_kfold(holes, ["id"], "y").count() == 3000


def test_repeated_folds_equal_single_ones(skewed):
    both = f.repeated_stratified_kfold(skewed, ["id"], "y", [42, 43])
    assert rows(both.where("run = 1"), "id", "y", "fold") == rows(f.stratified_kfold(skewed, ["id"], "y", seed=43))


def test_holdout_shares(skewed):
    parts = f.stratified_holdout(skewed, ["id"], "y", 0.2)
    counts = parts.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("part") == "test").alias("t")).collect()
    assert sum(r["t"] for r in counts) == math.ceil(0.2 * sum(r["n"] for r in counts if r["n"] > 1))
    assert all(abs(r["t"] - 0.2 * r["n"]) < 1 and r["t"] < r["n"] for r in counts)


def test_one_row_classes_fill_folds_evenly_and_never_leave_training(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("c"), "id").alias("y"))
    sizes = [r["count"] for r in f.stratified_kfold(df, ["id"], "y").groupBy("fold").count().collect()]
    assert sorted(sizes) == [333, 333, 334]
    assert f.stratified_holdout(df, ["id"], "y").where("part = 'test'").count() == 0


def test_hash_order_tells_keys_apart(spark):
    keys = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("", None), (None, "")], "a string, b string")
    assert keys.select(f.hash_order(["a", "b"], 1)).distinct().count() == 6


def test_weights_average_one(skewed):
    weighted = f.balanced_weights(skewed, "y")
    assert weighted.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)
    per_class = weighted.groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert len({round(r["w"], 6) for r in per_class}) == 1


def test_hashed_folds_are_even(skewed):
    counts = [r["count"] for r in f.hashed_kfold(skewed, ["id"]).groupBy("fold").count().collect()]
    assert len(counts) == 3 and min(counts) > 900


def test_group_rank_equals_row_number(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 101).alias("v")).withColumn("b", F.floor(F.col("v") / 10))
    ranked = with_group_rank(df, ["g"], [F.col("v"), F.col("id")], "b", per_group=lambda groups: groups.withColumn("n", F.col("size")))
    w = Window.partitionBy("g").orderBy("v", "id")
    want = df.withColumn("_rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    assert rows(ranked, "id", "_rank", "n") == rows(want, "id", "_rank", "n")


# --- rare classes ---


@pytest.fixture(scope="module")
def classed(spark):
    return spark.createDataFrame([(i, 0) for i in range(10)] + [(10 + i, 1) for i in range(6)] + [(20, 2), (21, 2), (30, 3)], "id long, y int")


def test_exclude_and_merge(classed):
    assert {r[1] for r in rows(ra.exclude_rare(classed, "y", 3))} == {0, 1}
    merged = ra.merge_rare(classed, "y", 3)
    assert rows(merged.groupBy("y").count()) == [(0, 10), (1, 6), (4, 3)]
    assert merged.schema["y"].dataType == classed.schema["y"].dataType
    # a merged class that is still rare goes with the next step
    assert {r[1] for r in rows(ra.exclude_rare(ra.merge_rare(classed, "y", 3), "y", 4))} == {0, 1}
    nothing = ra.merge_rare(classed.where("y < 2"), "y", 3)
    assert rows(nothing) == rows(classed.where("y < 2"))


def test_rare_rows_never_validate(classed):
    folded = ra.exclude_rare_but_train(classed, ["id"], "y", 3)
    assert folded.where("y > 1 and fold is not null").count() == 0
    assert folded.where("y <= 1 and fold is null").count() == 0 and folded.count() == 19


def test_strat_label_is_for_splitting_only(classed):
    out = ra.stratify_rare_as_majority(classed, "y", 5)
    assert rows(out.groupBy("y").count()) == [(0, 10), (1, 6), (2, 2), (3, 1)]
    assert rows(out.groupBy("strat_label").count()) == [(0, 13), (1, 6)]


def test_split_by_share(classed):
    majority, rare = ra.split_by_share(classed, "y", 0.2)
    assert {r[1] for r in rows(majority)} == {0, 1} and {r[1] for r in rows(rare)} == {2, 3}
    assert majority.count() + rare.count() == 19


def test_augment(spark, classed):
    out = ra.augment_missing_classes(classed, ["id"], "y", [0, 1, 2, 3, 4, 5])
    added = out.where("augmented")
    assert rows(added, "y") == [(4,), (5,)] and out.count() == 21
    assert added.join(classed.select("id"), ["id"], "left_anti").count() == 0
    assert ra.augment_missing_classes(classed, ["id"], "y", [0, 1]).count() == 19
    two = classed.where("id < 2")
    cycled = ra.augment_missing_classes(two, ["id"], "y", [0, 1, 2, 3, 4, 5]).where("augmented")
    assert sorted(r["n"] for r in cycled.groupBy("id").agg(F.count("*").alias("n")).collect()) == [2, 3]
    assert ra.augment_missing_classes(classed.limit(0), ["id"], "y", [0, 1]).count() == 0


# --- scaling ---


def test_standard_and_minmax(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0), (4, NAN, 5.0), (5, 5.0, 5.0)], "id int, x double, c double")
    out = [tuple(r) for r in sc.standardize(df, ["x", "c"]).orderBy("id").collect()]
    std = math.sqrt(8 / 3)
    assert out[0][1] == pytest.approx(-2 / std) and out[4][1] == pytest.approx(2 / std) and out[2][1] is None and math.isnan(out[3][1])
    assert {r[2] for r in out} == {0.0}
    scaled = [tuple(r) for r in sc.minmax(df, ["x", "c"]).orderBy("id").collect()]
    assert [scaled[i][1] for i in (0, 1, 4)] == [0.0, 0.5, 1.0] and {r[2] for r in scaled} == {0.0}
    # a constant column in the fitted table is only shifted elsewhere
    other = spark.createDataFrame([(9, 1.0, 7.0)], df.schema)
    assert sc.apply_standard(other, sc.fit_stats(df, ["x", "c"]), ["x", "c"]).first()["c"] == 2.0


def test_per_fold_statistics_use_the_other_folds(spark):
    rng = random.Random(1)
    data = [(i, i % 3 if i % 10 else None, 1e9 + rng.random()) for i in range(300)]
    df = spark.createDataFrame(data, "id int, fold int, x double")
    got = {r["fold"]: r["stats"][0] for r in sc.fit_stats_per_fold(df, ["x"], [0, 1, 2]).collect()}
    for fold in range(3):
        x = np.array([v for _, g, v in data if g != fold])
        assert got[fold]["n"] == len(x) and got[fold]["min"] == x.min() and got[fold]["max"] == x.max()
        assert got[fold]["mean"] == pytest.approx(x.mean(), rel=1e-15)
        assert got[fold]["m2"] / len(x) == pytest.approx(x.var(), rel=1e-6)


def test_impute(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, NAN), (4, 5.0)], "id int, x double")
    assert [r["x"] for r in sc.impute_mean(df, ["x"]).orderBy("id").collect()] == [1.0, 3.0, 3.0, 5.0]


def test_impute_median_two_steps_match_pandas(spark):
    x = [1.0, None, INF, 7.0, -INF, 3.0, INF, None, 2.0]
    df = spark.createDataFrame(list(enumerate(x)), "id int, x double")
    want = pd.Series([NAN if v is None else v for v in x])
    want = want.fillna(want.median())
    want = want.replace([np.inf, -np.inf], np.nan)
    want = want.fillna(want.median())
    assert [r["x"] for r in sc.impute_median(df, ["x"]).orderBy("id").collect()] == want.tolist()


def test_cap_infinite(spark):
    df = spark.createDataFrame([(1, 1.0, INF), (2, INF, -INF), (3, -INF, INF), (4, 4.0, INF)], "id int, x double, e double")
    out = [tuple(r) for r in sc.cap_infinite(df, ["x", "e"]).orderBy("id").collect()]
    assert [r[1] for r in out] == [1.0, 5.0, 0.0, 4.0] and {r[2] for r in out} == {0.0}


def test_assemble(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert sc.assemble(df, ["a", "b"]).first()["features"].toArray().tolist() == [1.0, 2.0]
    assert sc.assemble_array(df, ["a", "b"]).first()["features"] == [1.0, 2.0]
