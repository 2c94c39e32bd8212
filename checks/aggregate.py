"""Counts, scores and profiles."""

from pyspark.sql import functions as F

from stratafold.operators import aggregates as a
from stratafold.operators.folds import stratified_kfold

from .base import FEATURES, FOLDS, GRADED, LINE_KEY, Checks, fold_sql, graded, r, rounded, table
from .keyed import folded_lines

CHECKS = Checks()
_GUESS = "CASE WHEN l_quantity > 25 THEN 'R' ELSE 'N' END"
_FOLDED = fold_sql("lineitem", LINE_KEY, "l_returnflag")


def guessed(df):
    return df.withColumn("prediction", F.when(F.col("l_quantity") > 25, "R").otherwise("N"))


@CHECKS.add("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def class_counts(spark, sf_dir):
    return a.class_counts(table(spark, sf_dir, "events"), "event_type")


@CHECKS.add("SELECT count(DISTINCT event_type) AS n_classes FROM events")
def n_classes(spark, sf_dir):
    return a.n_classes(table(spark, sf_dir, "events"), "event_type")


@CHECKS.add("SELECT DISTINCT event_type FROM events")
def class_values(spark, sf_dir):
    return a.classes(table(spark, sf_dir, "events"), "event_type")


@CHECKS.add("SELECT event_type AS majority FROM events GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1")
def majority_class(spark, sf_dir):
    return a.majority_class(table(spark, sf_dir, "events"), "event_type")


@CHECKS.add(
    f"""SELECT l_linestatus, {r(f"avg(CASE WHEN l_returnflag = {_GUESS} THEN 1.0 ELSE 0.0 END)")} AS accuracy
        FROM lineitem GROUP BY l_linestatus"""
)
def accuracy_by(spark, sf_dir):
    preds = guessed(table(spark, sf_dir, "lineitem"))
    return a.accuracy(preds, "l_returnflag", "prediction", ["l_linestatus"]).withColumn("accuracy", rounded("accuracy"))


@CHECKS.add(
    f"""SELECT {r('avg(a)')} AS score FROM (SELECT avg(CASE WHEN l_returnflag = {_GUESS} THEN 1.0 ELSE 0.0 END) AS a
        FROM ({_FOLDED}) GROUP BY fold)"""
)
def cv_score(spark, sf_dir):
    preds = guessed(folded_lines(spark, sf_dir))
    return a.cv_score(preds, "l_returnflag", "prediction").withColumn("score", rounded("score"))


@CHECKS.add(
    f"""SELECT {r('avg(s)')} AS score FROM (SELECT avg(a) AS s FROM (SELECT l_linestatus, fold,
        avg(CASE WHEN l_returnflag = {_GUESS} THEN 1.0 ELSE 0.0 END) AS a
        FROM ({fold_sql('lineitem', LINE_KEY, 'l_linestatus')}) GROUP BY l_linestatus, fold) GROUP BY l_linestatus)"""
)
def repeated_cv_score(spark, sf_dir):
    """Mean over groups of the mean over folds; the line status stands for the run."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_linestatus", "l_returnflag", "l_quantity")
    preds = guessed(stratified_kfold(lines, LINE_KEY, "l_linestatus"))
    return a.repeated_cv_score(preds, "l_returnflag", "prediction", run="l_linestatus").withColumn("score", rounded("score"))


@CHECKS.add(
    f"""SELECT {r(f"coalesce(avg(CASE WHEN l_returnflag = {_GUESS} THEN 1.0 ELSE 0.0 END), 0.0)")} AS score
        FROM lineitem WHERE l_linenumber <> 7"""
)
def pooled_oof_score(spark, sf_dir):
    preds = guessed(table(spark, sf_dir, "lineitem"))
    preds = preds.withColumn("prediction", F.when(F.col("l_linenumber") != 7, F.col("prediction")))
    return a.pooled_oof_score(preds, "l_returnflag", "prediction").withColumn("score", rounded("score"))


@CHECKS.add(
    f"""WITH c AS (SELECT grade, count(*) AS n FROM ({GRADED}) GROUP BY grade)
        SELECT grade - 1 AS class, grade AS original_label, n, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE n < 45) AS total_excluded,
          (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE n >= 45) AS total_kept FROM c WHERE n < 45"""
)
def excluded_summary(spark, sf_dir):
    df = graded(spark, sf_dir).withColumn("class", F.col("grade") - 1)
    return a.excluded_summary(df, "class", 45)


def _stats_sql(source, by=""):
    parts = [
        f"SELECT {by}'{c}' AS \"column\", count({c}) AS n, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_pop({c})', 4)} AS std, min({c}) AS min, max({c}) AS max FROM {source}"
        + (f" GROUP BY {by.rstrip(', ')}" if by else "")
        for c in FEATURES
    ]
    return " UNION ALL ".join(parts)


def _rounded_stats(df):
    return df.withColumns({"mean": rounded("mean", 4), "std": rounded("std", 4)})


@CHECKS.add(_stats_sql("lineitem"))
def column_stats(spark, sf_dir):
    return _rounded_stats(a.column_stats(table(spark, sf_dir, "lineitem"), FEATURES))


@CHECKS.add(_stats_sql("lineitem", "l_returnflag, "))
def column_stats_by_class(spark, sf_dir):
    return _rounded_stats(a.column_stats(table(spark, sf_dir, "lineitem"), FEATURES, ["l_returnflag"]))


# Missing and infinite values put into two columns, by the same rule in both engines.
HOLED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'nan'::DOUBLE ELSE l_extendedprice END AS price,
  CASE WHEN l_linenumber = 5 AND l_quantity > 25 THEN 'inf'::DOUBLE WHEN l_linenumber = 5 THEN '-inf'::DOUBLE
       WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END AS quantity FROM lineitem"""


def holed(spark, sf_dir):
    n = F.col("l_linenumber")
    inf = F.when(F.col("l_quantity") > 25, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        F.when(n == 7, None).when(n == 6, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(n == 5, inf).when(n == 4, None).otherwise(F.col("l_quantity")).alias("quantity"),
    )


def _profile_sql(c):
    return f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL OR isnan({c})) AS n_missing, count(*) FILTER (isinf({c})) AS n_infinite,
      min({c}) FILTER (isfinite({c})) AS finite_min, max({c}) FILTER (isfinite({c})) AS finite_max FROM ({HOLED})"""


@CHECKS.add(_profile_sql("price") + " UNION ALL " + _profile_sql("quantity"))
def null_inf_profile(spark, sf_dir):
    return a.null_inf_profile(holed(spark, sf_dir), ["price", "quantity"])


@CHECKS.add(
    f"""SELECT 'price' AS "column", median(price) AS median FROM ({HOLED}) WHERE NOT isnan(price)
        UNION ALL SELECT 'quantity', median(quantity) FROM ({HOLED}) WHERE NOT isnan(quantity)"""
)
def column_median(spark, sf_dir):
    """Exact medians; infinities count, missing values do not."""
    return a.column_median(holed(spark, sf_dir), ["price", "quantity"])


@CHECKS.add(
    " UNION ALL ".join(
        f"SELECT CAST({f} AS INTEGER) AS fold, l_returnflag, count(*) AS n FROM ({_FOLDED}) WHERE fold <> {f} GROUP BY l_returnflag" for f in FOLDS
    )
)
def class_presence(spark, sf_dir):
    counts = a.class_presence(folded_lines(spark, sf_dir), "l_returnflag", folds=FOLDS)
    return counts.select("fold", "l_returnflag", "n")


@CHECKS.add(f"SELECT CAST(c AS INTEGER) AS class FROM range(0, 8) t(c) WHERE c NOT IN (SELECT grade FROM ({GRADED}))")
def missing_classes(spark, sf_dir):
    every = spark.range(8).select(F.col("id").cast("int").alias("class"))
    return a.missing_classes(graded(spark, sf_dir), "grade", every)
