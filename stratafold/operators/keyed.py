"""Row gathering by key: what data-frame code does by position or index label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..bounded import is_in


def train_of(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    """Training rows of a fold. A NULL fold marks rows that train in every fold and never validate."""
    return df.where(F.col(fold_col).isNull() | (F.col(fold_col) != fold))


def valid_of(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    return df.where(F.col(fold_col) == fold)


def add_rows_to_training(df: DataFrame, extra: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Append rows that train in every fold and never validate: one union, not one per fold."""
    return df.unionByName(extra.withColumn(fold_col, F.lit(None).cast(df.schema[fold_col].dataType)))


def collect_oof(df: DataFrame, predictions: list[DataFrame], key: list[str], pred: str = "prediction") -> DataFrame:
    """Per-fold predictions back on the full table; rows that never validated get NULL."""
    stacked = reduce(DataFrame.unionByName, [p.select(*key, pred) for p in predictions])
    return df.join(stacked, key, "left")


def collect_scored(df: DataFrame, scored: list[DataFrame], fold_col: str = "fold", pred: str = "prediction") -> DataFrame:
    """The same where the scored rows are the table's own rows with their columns: a union, without key and join.

    ``scored`` holds every row that validates once; rows of no fold never validate and get NULL.
    """
    kept = reduce(DataFrame.unionByName, [p.select(*df.columns, pred) for p in scored])
    never = df.where(F.col(fold_col).isNull()).withColumn(pred, F.lit(None).cast(kept.schema[pred].dataType))
    return kept.unionByName(never)


def drop_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Remove the rows with the listed keys. Keys are as many as rows can be, so no broadcast is forced."""
    return df.join(keys, keys.columns, "left_anti")


def rows_of_classes(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    return is_in(df, label, classes)


def rows_not_of_classes(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    return is_in(df, label, classes, keep=False)


def filter_unseen_labels(valid: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """Validation rows whose label occurs in the training rows."""
    return is_in(valid, label, train.select(label).distinct())


def bind_columns(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Columns of two tables side by side, matched by key; rows missing on one side get NULLs."""
    return df.join(other, key, "full")


def attach_predictions(ids: DataFrame, predictions: DataFrame, key: list[str]) -> DataFrame:
    """Pair ids with their predictions. Within one plan the key travels along and no join is needed."""
    return ids.join(predictions, key, "inner")
