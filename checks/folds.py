"""Stratified folds, hold-outs and class weights."""

from pyspark.sql import Window, functions as F

from stratafold.operators import folds as f

from .base import LINE_KEY, LK, Checks, fold_sql, hash_sql, holdout_sql, r, rounded, table

CHECKS = Checks()


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag")


@CHECKS.add(f"SELECT {LK}, l_returnflag, fold FROM ({fold_sql('lineitem', LINE_KEY, 'l_returnflag')})")
def stratified_kfold(spark, sf_dir):
    return f.stratified_kfold(_lines(spark, sf_dir), LINE_KEY, "l_returnflag")


@CHECKS.add(
    " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS run, event_id, event_type, fold FROM ({fold_sql('events', ['event_id'], 'event_type', seed=42 + i)})"
        for i in range(5)
    )
)
def repeated_stratified_kfold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return f.repeated_stratified_kfold(events, ["event_id"], "event_type", [42 + i for i in range(5)])


@CHECKS.add(f"SELECT {LK}, l_returnflag, part FROM ({holdout_sql('lineitem', LINE_KEY, 'l_returnflag')})")
def stratified_holdout(spark, sf_dir):
    return f.stratified_holdout(_lines(spark, sf_dir), LINE_KEY, "l_returnflag")


@CHECKS.add(
    f"""SELECT {LK}, l_returnflag, CAST(('0x' || substr({hash_sql(LINE_KEY)}, 1, 12)) AS BIGINT) % 3 AS fold FROM lineitem"""
)
def hashed_kfold(spark, sf_dir):
    """Approximate strata in one narrow pass."""
    folded = f.hashed_kfold(_lines(spark, sf_dir), LINE_KEY)
    return folded.withColumn("fold", F.col("fold").cast("long"))


@CHECKS.add(
    f"""WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT {LK}, l_returnflag, {r('(SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n)')} AS weight
        FROM lineitem JOIN c USING (l_returnflag)"""
)
def balanced_weights(spark, sf_dir):
    weighted = f.balanced_weights(_lines(spark, sf_dir), "l_returnflag")
    return weighted.withColumn("weight", rounded("weight"))


# Every fifth customer is a class of one; of the rest, one in seven has no class, and keys hold separators and NULLs.
_ODD = """(SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name || '|' END AS a, CASE WHEN c_custkey % 11 = 0 THEN c_name ELSE c_custkey || '|x' END AS b,
  CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS class FROM customer)"""


def _odd(spark, sf_dir):
    n, name = F.col("c_custkey"), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        F.when(n % 11 != 0, F.concat(name, F.lit("|"))).alias("a"),
        F.when(n % 11 == 0, name).otherwise(F.concat(n.cast("string"), F.lit("|x"))).alias("b"),
        F.when(n % 5 == 0, name).when(n % 7 != 0, F.col("c_mktsegment")).alias("class"),
    )


@CHECKS.add(f"SELECT class, fold, count(*) AS n, sum(count(*)) OVER (PARTITION BY fold)::BIGINT AS in_fold FROM ({fold_sql(_ODD, ['a', 'b'], 'class')}) GROUP BY class, fold")
def fold_sizes_with_rare_classes(spark, sf_dir):
    """Sizes by class and fold, and of the folds, with many classes of one row and keys of NULLs and separators."""
    sizes = f.stratified_kfold(_odd(spark, sf_dir), ["a", "b"], "class").groupBy("class", "fold").agg(F.count("*").alias("n"))
    return sizes.withColumn("in_fold", F.sum("n").over(Window.partitionBy("fold")))


@CHECKS.add(f"SELECT class, count(*) AS n, count(*) FILTER (part = 'test') AS n_test FROM ({holdout_sql(_ODD, ['a', 'b'], 'class')}) GROUP BY class")
def holdout_sizes_with_rare_classes(spark, sf_dir):
    parts = f.stratified_holdout(_odd(spark, sf_dir), ["a", "b"], "class")
    return parts.groupBy("class").agg(F.count("*").alias("n"), F.count(F.when(F.col("part") == "test", 1)).alias("n_test"))
