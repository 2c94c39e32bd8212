"""Plans: what reaches the scan, what is shuffled, and that no row passes through Python where it need not."""

import re

from pyspark.sql import functions as F

from checks import all_queries
from checks.base import FEATURES, LINE_KEY, table
from stratafold.operators import folds as f
from stratafold.operators import scaling as sc
from stratafold.operators import voting as v

SF = "/root/testdata/sf0.001"


def plan(df, executed=False):
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(spark, df):
    return spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def lines(spark):
    return table(spark, SF, "lineitem").select(*LINE_KEY, "l_returnflag", *FEATURES)


def test_filter_and_columns_reach_the_scan(spark):
    text = formatted(spark, all_queries()["read_table_pushdown"](spark, SF))
    assert "GreaterThan(l_quantity,45.0)" in text and "EqualTo(l_returnflag,R)" in text and "l_shipdate" not in text


def test_short_lists_reach_the_scan(spark):
    text = formatted(spark, all_queries()["filter_in"](spark, SF))
    assert "In(o_custkey" in text and "Join" not in text


def test_folds_and_holdouts_move_no_row(spark):
    for df in (f.stratified_kfold(lines(spark), LINE_KEY, "l_returnflag"), f.stratified_holdout(lines(spark), LINE_KEY, "l_returnflag")):
        text = plan(df, executed=True).split("Initial Plan")[0]
        assert text.count("FileScan") == 1 and "Exchange" not in text.replace("BroadcastExchange", "") and "Window" not in text


def test_fitting_and_scoring_are_one_scan_each(spark):
    text = plan(all_queries()["naive_bayes_cv_score"](spark, SF), executed=True).split("Initial Plan")[0]
    assert text.count("FileScan") == 2 and text.replace("BroadcastExchange", "").count("Exchange ") <= 12


def test_whole_table_statistics_are_a_subquery(spark):
    text = plan(sc.standardize(lines(spark), FEATURES))
    assert "NestedLoop" not in text and len(set(re.findall(r"Subquery subquery#(\d+)", text))) == 1


def test_side_by_side_votes_move_nothing(spark):
    df = lines(spark).select(*LINE_KEY, (F.col("l_linenumber") % 3).alias("a"), (F.col("l_suppkey") % 3).alias("b"))
    assert "Exchange" not in plan(v.hard_vote(df, ["a", "b"]))


def test_long_votes_shuffle_once(spark):
    df = lines(spark).select(*LINE_KEY, F.col("l_returnflag").alias("prediction"))
    assert plan(v.top_votes(df, LINE_KEY, classes=["A", "N", "R"])).count("Exchange") == 1


def test_cut_points_are_compared_in_a_compiled_expression(spark, monkeypatch):
    """A few cut points are no loop over an array; more give the same folds by one."""
    from stratafold.operators import folds

    rows = [(i if i % 50 else None, i % 7 if i % 11 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, y int").dropDuplicates()
    few = folds.stratified_kfold(df, ["id"], "y", k=5)
    assert "lambda" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(folds, "FEW_CUTS", 0)
    many = folds.stratified_kfold(df, ["id"], "y", k=5)
    assert "lambda" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))


def test_ablation_caches_no_keys(spark, monkeypatch):
    """The query hands the operator the columns that its variants read."""
    import checks.reports as reports

    given = []

    def scores(df, variants):
        given.append(df.columns)
        return spark.createDataFrame([], "variant string, score double")

    monkeypatch.setattr(reports.x, "ablation_scores", scores)
    rows = [(i, 1, i, i, "ANR"[i % 3], float(i % 50), float(i), 0.1, 0.2) for i in range(60)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    monkeypatch.setattr("checks.keyed.table", lambda *_: lines)
    reports.ablation_scores(spark, "")
    assert given == [["l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "fold"]]
