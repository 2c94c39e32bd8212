"""Classes with too few rows, and classes a training fold lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..bounded import is_in, local_if_small, pin
from .aggregates import label_counts, majority_of
from .folds import hash_order, stratified_kfold
from .projection import flag_in, replace_values


def rare_classes(df: DataFrame, label: str, min_count: int | None = None, share: float | None = None) -> DataFrame:
    """Labels with fewer than ``min_count`` rows, or with less than ``share`` of all rows."""
    return _rare(local_if_small(label_counts(df, label)), label, min_count, share)


def _rare(counts: DataFrame, label: str, min_count: int | None = None, share: float | None = None) -> DataFrame:
    if (min_count is None) == (share is None):
        raise ValueError("give either min_count or share")
    limit = F.lit(min_count) if share is None else counts.agg(F.sum("n")).scalar() * F.lit(float(share))
    return counts.where(F.col("n") < limit).select(label)


def exclude_rare(df: DataFrame, label: str, min_count: int = 3) -> DataFrame:
    """Drop the rows of classes with fewer than ``min_count`` rows."""
    return is_in(df, label, rare_classes(df, label, min_count), keep=False)


def exclude_rare_but_train(
    df: DataFrame, key: list[str], label: str, min_count: int = 3, k: int = 3, seed: int = 42, fold: str = "fold"
) -> DataFrame:
    """Stratified folds where rows of rare classes get a NULL fold: they train everywhere and never validate."""
    flagged = flag_in(df, label, rare_classes(df, label, min_count), "_rare")
    folded = stratified_kfold(flagged, key, label, k, seed, fold)
    return folded.withColumn(fold, F.when(~F.col("_rare"), F.col(fold))).drop("_rare")


def merge_rare(df: DataFrame, label: str, min_count: int = 3) -> DataFrame:
    """All rare classes become one new class, max + 1. It may itself be rare: chain ``exclude_rare``."""
    counts = local_if_small(label_counts(df, label))
    other = (counts.agg(F.max(label)).scalar() + 1).cast(df.schema[label].dataType)
    return replace_values(df, label, _rare(counts, label, min_count), other)


def stratify_rare_as_majority(df: DataFrame, label: str, min_count: int = 5, strat: str = "strat_label") -> DataFrame:
    """Add a label used for splitting only, in which rare classes count as the most frequent one."""
    counts = local_if_small(label_counts(df, label))
    copied = df.withColumn(strat, F.col(label))
    rare = _rare(counts, label, min_count).withColumnRenamed(label, strat)
    return replace_values(copied, strat, rare, majority_of(counts, label).scalar())


def split_by_share(df: DataFrame, label: str, share: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(rows of classes with at least ``share`` of all rows, the other rows)."""
    flagged = flag_in(df, label, rare_classes(df, label, share=share), "_rare")
    return flagged.where(~F.col("_rare")).drop("_rare"), flagged.where(F.col("_rare")).drop("_rare")


def augment_missing_classes(
    train: DataFrame, key: list[str], label: str, classes: list[int], seed: int = 42, flag: str = "augmented"
) -> DataFrame:
    """Append, for each listed class that ``train`` lacks, a copy of a training row with that label.

    Templates are the first rows in hash order, as many as there are missing classes, used in turn.
    """
    # no more rows than listed classes can come back
    pinned = pin(train.where(F.col(label).isin(list(classes))).select(label).distinct(), len(classes))
    have = set(pinned.values(label))
    missing = [c for c in sorted(classes) if c not in have]
    out = train.withColumn(flag, F.lit(False))
    if not missing:
        return out
    # at most one template per missing class, so the numbering below covers that many rows only
    top = train.withColumn("_hash", hash_order(key, seed)).orderBy("_hash", *key).limit(len(missing))
    everything = Window.partitionBy(F.lit(0))
    templates = top.withColumn("_i", F.row_number().over(everything.orderBy("_hash", *key)) - 1)
    templates = templates.withColumn("_count", F.count("*").over(everything)).drop("_hash")
    slots = F.array(*[F.struct(F.lit(i).alias("_slot"), F.lit(c).alias("_class")) for i, c in enumerate(missing)])
    copies = (
        templates.select("*", F.inline(slots))
        .where(F.pmod(F.col("_slot"), F.col("_count")) == F.col("_i"))
        .withColumn(label, F.col("_class").cast(train.schema[label].dataType))
        .withColumn(flag, F.lit(True))
        .drop("_i", "_count", "_slot", "_class")
    )
    return out.unionByName(copies)
