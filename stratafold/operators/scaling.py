"""Fitted preprocessing: learn statistics on one table or fold, apply them to another.

Statistics stay in the plan. Those of a whole table are one row and enter as a scalar subquery; those
of held-out folds are one row per listed fold and are the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.scalar import is_finite, is_infinite, num, present
from .aggregates import grouped_stats, held_out_parts, medians_of_filled, merge_stats, profile_array

_STATS = "_stats"


def fit_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row (rows, stats): n, mean, m2, min and max of every column, in the order of ``cols``."""
    return grouped_stats(df, cols)


def fit_stats_per_fold(df: DataFrame, cols: list[str], folds: list[int], fold: str = "fold") -> DataFrame:
    """One row (fold, stats) per held-out fold, about the rows of the other folds. The table is aggregated once, by fold."""
    parts = held_out_parts(grouped_stats(df, cols, [fold]), [], folds, fold)
    merged = merge_stats(parts, ["_held", "at"])
    entry = F.struct("at", "n", "mean", "m2", "min", "max")
    return merged.groupBy(F.col("_held").alias(fold)).agg(F.sort_array(F.collect_list(entry)).alias("stats"))


def _apply(df: DataFrame, stats: DataFrame, cols: list[str], rule: Callable[[str, Column], Column], fold: str | None) -> DataFrame:
    if fold is None:
        joined = df.withColumn(_STATS, stats.select("stats").scalar())
    else:
        # one row per listed fold by construction of fit_stats_per_fold
        joined = df.join(F.broadcast(stats.select(fold, F.col("stats").alias(_STATS))), [fold], "left")
    scaled = {c: rule(c, F.col(_STATS)[i]) for i, c in enumerate(cols)}
    if fold is not None:  # rows that never validate have no statistics of their own
        scaled = {c: F.when(F.col(fold).isNull(), num(c)).otherwise(x) for c, x in scaled.items()}
    return joined.withColumns(scaled).select(*df.columns)


def apply_standard(df: DataFrame, stats: DataFrame, cols: list[str], fold: str | None = None) -> DataFrame:
    """(x - mean) / population std. A column that is constant in the fitted table is only centred."""

    def rule(c: str, s: Column) -> Column:
        return F.try_divide(num(c) - s["mean"], F.when(s["min"] == s["max"], 1.0).otherwise(F.sqrt(s["m2"] / s["n"])))

    return _apply(df, stats, cols, rule, fold)


def apply_minmax(df: DataFrame, stats: DataFrame, cols: list[str], fold: str | None = None) -> DataFrame:
    """(x - min) / (max - min). A column that is constant in the fitted table is only shifted."""

    def rule(c: str, s: Column) -> Column:
        return (num(c) - s["min"]) / F.when(s["min"] == s["max"], 1.0).otherwise(s["max"] - s["min"])

    return _apply(df, stats, cols, rule, fold)


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fit and apply on the same table."""
    return apply_standard(df, fit_stats(df, cols), cols)


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_minmax(df, fit_stats(df, cols), cols)


def standardize_validation_rows(df: DataFrame, cols: list[str], folds: list[int], fold: str = "fold") -> DataFrame:
    """Every row as it is seen when its fold is held out: scaled with the statistics of the other folds' rows.

    This is the validation half only. To train on scaled rows use ``scale_both_halves`` or
    ``learners.preprocessed``: there a fold's training rows are scaled by the same statistics. Rows with a NULL fold
    never validate and keep their values.
    """
    return apply_standard(df, fit_stats_per_fold(df, cols, folds, fold), cols, fold)


def minmax_validation_rows(df: DataFrame, cols: list[str], folds: list[int], fold: str = "fold") -> DataFrame:
    return apply_minmax(df, fit_stats_per_fold(df, cols, folds, fold), cols, fold)


def scale_both_halves(
    df: DataFrame, cols: list[str], folds: list[int], fold: str = "fold", how: str = "standard", held: str = "held_out", part: str = "part"
) -> DataFrame:
    """Every row once per held-out fold, with ``held_out`` and ``part`` ('train' or 'valid'), scaled by that fold's training rows.

    Both halves of a split get the same statistics, those of its training half. Rows with a NULL fold train in all.
    """
    apply = {"standard": apply_standard, "minmax": apply_minmax}[how]
    stats = fit_stats_per_fold(df, cols, folds, fold).withColumnRenamed(fold, held)
    each = df.withColumn(held, F.explode(F.array(*[F.lit(f) for f in folds])))
    valid = F.coalesce(F.col(fold) == F.col(held), F.lit(False))
    return apply(each, stats, cols, held).withColumn(part, F.when(valid, "valid").otherwise("train"))


def impute_mean(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Missing values (NULL or NaN) become the mean of the present ones."""
    stats = fit_stats(df, cols) if stats is None else stats
    return _apply(df, stats, cols, lambda c, s: F.coalesce(present(c), s["mean"]), None)


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values become the median; then infinities become the median of the values so filled.

    Two steps in that order: the first median counts infinities as values, the second counts the
    filled-in ones.
    """
    medians = medians_of_filled(df, {c: num(c) for c in cols})
    filled = {}
    for c in cols:
        first, second = (F.lit(m).cast("double") for m in medians[c])
        whole = F.coalesce(present(c), first)
        filled[c] = F.coalesce(F.when(is_finite(whole), whole), second)
    return df.withColumns(filled)


def cap_infinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """+inf becomes the finite maximum + 1, -inf the finite minimum - 1, or 0 without any finite value."""
    bounds = df.agg(profile_array(cols).alias("stats"))

    def rule(c: str, s: Column) -> Column:
        high = F.coalesce(s["finite_max"] + 1, F.lit(0.0))
        low = F.coalesce(s["finite_min"] - 1, F.lit(0.0))
        return F.when(~is_infinite(c), num(c)).when(num(c) > 0, high).otherwise(low)

    return _apply(df, bounds, cols, rule, None)


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Feature vector for the Spark ML learners."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def assemble_sparse(df: DataFrame, cols: list[str], crosses: list[str], out: str = "features") -> DataFrame:
    """Sparse feature vector of plain columns and then of sparse crosses (size, indices, values), each behind the one before; 0 and missing values are left out.

    A row's vector takes 12 bytes for each value that is not 0, whatever the width.
    """
    plain = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(num(c), F.lit(0.0)).alias("x")) for i, c in enumerate(cols)]), lambda e: e["x"] != 0)
    parts, start = [plain], F.lit(len(cols))
    for c in crosses:
        own, before = F.col(c), start
        parts.append(_shifted(own, before))
        start = start + own["size"]
    every = F.concat(*parts)
    vector = F.struct(F.lit(0).alias("type"), start.alias("size"), F.transform(every, lambda e: e["i"]).alias("indices"), F.transform(every, lambda e: e["x"]).alias("values"))
    parsed = F.from_json(F.to_json(F.struct(vector.alias("v"))), StructType([StructField("v", VectorUDT())]))
    return df.withColumn(out, parsed["v"])


def _shifted(cross: Column, by: Column) -> Column:
    return F.transform(F.arrays_zip(cross["indices"].alias("i"), cross["values"].alias("x")), lambda e: F.struct((e["i"] + by).alias("i"), e["x"].alias("x")))


def assemble_array(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.array(*[num(c) for c in cols]))
