"""Rare and missing classes. Grades stand for a class label with a few small classes."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stratafold.operators import rare as ra
from stratafold.operators.aggregates import class_counts
from stratafold.operators.folds import stratified_kfold
from stratafold.operators import keyed as ke
from stratafold.operators.keyed import rows_not_of_classes, rows_of_classes, train_of

from .base import FOLDS, GRADED, Checks, fold_sql, graded, hash_sql

CHECKS = Checks()
_MIN = 45
_RARE = f"(SELECT grade FROM ({GRADED}) GROUP BY grade HAVING count(*) < {_MIN})"
_SHARE = f"(SELECT grade FROM ({GRADED}) GROUP BY grade HAVING count(*) < (SELECT count(*) FROM labels) * 0.11::DOUBLE)"


@CHECKS.add(f"SELECT doc_id, grade FROM ({GRADED}) WHERE grade NOT IN {_RARE}")
def exclude_rare(spark, sf_dir):
    return ra.exclude_rare(graded(spark, sf_dir), "grade", _MIN)


@CHECKS.add(
    f"""SELECT doc_id, grade, CASE WHEN grade NOT IN {_RARE} THEN fold END AS fold FROM ({fold_sql(f'({GRADED})', ['doc_id'], 'grade')})"""
)
def exclude_rare_but_train(spark, sf_dir):
    """Rare rows have no fold: they train in every fold and never validate."""
    return ra.exclude_rare_but_train(graded(spark, sf_dir), ["doc_id"], "grade", _MIN)


@CHECKS.add(
    f"""WITH f AS (SELECT doc_id, grade, CASE WHEN grade NOT IN {_RARE} THEN fold END AS fold FROM ({fold_sql(f'({GRADED})', ['doc_id'], 'grade')}))
        SELECT CAST(h AS INTEGER) AS held_out, grade, count(*) AS n FROM f, range(0, 3) t(h) WHERE fold IS NULL OR fold <> h GROUP BY 1, 2"""
)
def add_rows_to_training(spark, sf_dir):
    """Rare rows appended to every training fold by one union."""
    df = graded(spark, sf_dir)
    rare = ra.rare_classes(df, "grade", _MIN)
    common = stratified_kfold(rows_not_of_classes(df, "grade", rare), ["doc_id"], "grade")
    whole = ke.add_rows_to_training(common, rows_of_classes(df, "grade", rare))
    trains = [class_counts(train_of(whole, f), "grade").select(F.lit(f).alias("held_out"), "grade", "n") for f in FOLDS]
    return reduce(DataFrame.unionByName, trains)


@CHECKS.add(
    f"""SELECT doc_id, CASE WHEN grade IN {_RARE} THEN (SELECT max(grade) FROM ({GRADED})) + 1 ELSE grade END AS grade FROM ({GRADED})"""
)
def merge_rare(spark, sf_dir):
    return ra.merge_rare(graded(spark, sf_dir), "grade", _MIN)


@CHECKS.add(
    f"""SELECT doc_id, grade, CASE WHEN grade IN {_RARE} THEN (SELECT grade FROM ({GRADED}) GROUP BY grade ORDER BY count(*) DESC, grade LIMIT 1)
        ELSE grade END AS strat_label FROM ({GRADED})"""
)
def stratify_rare_as_majority(spark, sf_dir):
    return ra.stratify_rare_as_majority(graded(spark, sf_dir), "grade", _MIN)


@CHECKS.add(
    f"SELECT doc_id, grade, CASE WHEN grade IN {_SHARE} THEN 'rare' ELSE 'majority' END AS part FROM ({GRADED})"
)
def split_by_share(spark, sf_dir):
    majority, rare = ra.split_by_share(graded(spark, sf_dir), "grade", 0.11)
    return majority.withColumn("part", F.lit("majority")).unionByName(rare.withColumn("part", F.lit("rare")))


def _augmented_sql(held):
    return f"""SELECT doc_id, grade, false AS augmented, CAST({held} AS INTEGER) AS held_out FROM f WHERE fold <> {held}
      UNION ALL SELECT doc_id, CAST(c AS INTEGER), true, CAST({held} AS INTEGER) FROM
        (SELECT doc_id, row_number() OVER (ORDER BY {hash_sql(['doc_id'])}, doc_id) AS i FROM f WHERE fold <> {held}) t
        JOIN (SELECT c, row_number() OVER (ORDER BY c) AS j FROM range(0, 8) r(c)
              WHERE c NOT IN (SELECT grade FROM f WHERE fold <> {held})) m ON t.i = m.j"""


@CHECKS.add(
    f"WITH f AS ({fold_sql(f'({GRADED})', ['doc_id'], 'grade')}) " + " UNION ALL ".join(_augmented_sql(h) for h in FOLDS)
)
def augment_missing_classes(spark, sf_dir):
    """Each class a training fold lacks (of 0..7) gets one copied row."""
    folded = stratified_kfold(graded(spark, sf_dir), ["doc_id"], "grade")
    parts = []
    for held in FOLDS:
        augmented = ra.augment_missing_classes(train_of(folded, held).drop("fold"), ["doc_id"], "grade", list(range(8)))
        parts.append(augmented.withColumn("held_out", F.lit(held)))
    return reduce(DataFrame.unionByName, parts)
