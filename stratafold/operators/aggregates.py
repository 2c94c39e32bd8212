"""Counts, accuracies and column profiles. Everything pre-aggregates before its shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..bounded import local_if_small
from ..functions.scalar import finite, is_infinite, is_missing, present


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n), most frequent first, ties by label."""
    return label_counts(df, label).orderBy(F.desc("n"), F.asc(label))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n) in no order."""
    return df.groupBy(label).agg(F.count("*").alias("n"))


def classes(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct()


def n_classes(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_distinct(label).alias("n_classes"))


def missing_classes(df: DataFrame, label: str, all_classes: DataFrame) -> DataFrame:
    """Classes of the one-column table ``all_classes`` that do not occur in ``df``."""
    (name,) = all_classes.columns
    return all_classes.join(classes(df, label).withColumnRenamed(label, name), [name], "left_anti")


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """Most frequent class, the smallest one on ties."""
    return majority_of(label_counts(df, label), label)


def majority_of(counts: DataFrame, label: str) -> DataFrame:
    rank = F.struct((-F.col("n")).alias("n"), F.col(label).alias("label"))
    return counts.where(F.col(label).isNotNull()).agg(F.min_by(label, rank).alias("majority"))


def hit(label: str, pred: str) -> Column:
    return F.coalesce(F.col(label) == F.col(pred), F.lit(False)).cast("double")


def accuracy(preds: DataFrame, label: str, pred: str, by: list[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(F.avg(hit(label, pred)).alias("accuracy"))


def cv_score(preds: DataFrame, label: str, pred: str, fold: str = "fold") -> DataFrame:
    """Unweighted mean of the fold accuracies."""
    return accuracy(preds, label, pred, [fold]).agg(F.avg("accuracy").alias("score"))


def repeated_cv_score(preds: DataFrame, label: str, pred: str, run: str = "run", fold: str = "fold") -> DataFrame:
    """Mean over runs of the mean over folds."""
    per_run = accuracy(preds, label, pred, [run, fold]).groupBy(run).agg(F.avg("accuracy").alias("score"))
    return per_run.agg(F.avg("score").alias("score"))


def pooled_oof_score(oof: DataFrame, label: str, pred: str) -> DataFrame:
    """One accuracy over all rows with a prediction; 0.0 when there are none."""
    scored = oof.where(F.col(pred).isNotNull())
    return scored.agg(F.coalesce(F.avg(hit(label, pred)), F.lit(0.0)).alias("score"))


def excluded_summary(df: DataFrame, label: str, min_count: int, shift: int = 1) -> DataFrame:
    """Classes below ``min_count`` with their count, label before the shift, and the totals left out and kept."""
    counts = local_if_small(label_counts(df, label))
    rare = F.col("n") < min_count
    kept = counts.agg(F.coalesce(F.sum(F.when(~rare, F.col("n"))), F.lit(0)).alias("x")).scalar()
    excluded = counts.agg(F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("x")).scalar()
    return counts.where(rare).select(
        label,
        (F.col(label) + shift).alias("original_label"),
        "n",
        excluded.alias("total_excluded"),
        kept.alias("total_kept"),
    )


def class_presence(df: DataFrame, label: str, fold: str = "fold", folds: list[int] = (0, 1, 2)) -> DataFrame:
    """(fold, label, n): the classes in the training rows of each held-out fold.

    Rows are counted per (fold, label) first; only those few counts are repeated per held-out fold.
    """
    counts = df.groupBy(fold, label).agg(F.count("*").alias("n"))
    return (
        counts.withColumn("_held", F.explode(F.array(*[F.lit(f) for f in folds])))
        .where(F.col(fold).isNull() | (F.col(fold) != F.col("_held")))
        .groupBy(F.col("_held").alias(fold), label)
        .agg(F.sum("n").alias("n"))
    )


# --- column profiles -------------------------------------------------------------------------


def stats_array(cols: list[str]) -> Column:
    """Aggregate: per column its position and name, n, mean, m2 (sum of squared deviations), min and max.

    Missing values are left out. One array holds all columns, in their order.
    """
    entries = []
    for i, c in enumerate(cols):
        x = present(c)
        n = F.count(x)
        entries.append(
            F.struct(
                F.lit(i).alias("at"),
                F.lit(c).alias("column"),
                n.alias("n"),
                F.avg(x).alias("mean"),
                (F.var_pop(x) * n).alias("m2"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            )
        )
    return F.array(*entries)


def grouped_stats(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by.., rows, stats): statistics of all columns from one aggregation."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), stats_array(cols).alias("stats"))


def merge_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of the union of disjoint parts, from rows (keys.., rows, n, mean, m2, min, max).

    Deviations are taken from the merged mean, which keeps the precision that sums of squares lose.
    """
    group = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(group), F.sum("n").over(group))
    shift = F.col("mean") - F.col("_mean")
    return (
        parts.withColumn("_mean", mean)
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.max("_mean").alias("mean"),
            F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
    )


def held_out_parts(stats: DataFrame, by: list[str], folds: list[int], fold: str = "fold") -> DataFrame:
    """Grouped statistics, one row per column, repeated for each held-out fold whose training set they belong to.

    A NULL fold belongs to every training set. The rows number folds x groups x columns, not table rows.
    """
    held = F.explode(F.array(*[F.lit(f) for f in folds]))
    return (
        stats.select(fold, *by, "rows", F.inline("stats"))
        .withColumn("_held", held)
        .where(F.col(fold).isNull() | (F.col(fold) != F.col("_held")))
        .drop(fold)
    )


def column_stats(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by.., column, n, mean, std, min, max) with the population standard deviation."""
    std = F.sqrt(F.try_divide(F.col("m2"), F.col("n"))).alias("std")
    return grouped_stats(df, cols, by).select(*by, F.inline("stats")).select(*by, "column", "n", "mean", std, "min", "max")


def profile_array(cols: list[str]) -> Column:
    """Aggregate: per column the numbers of missing and infinite values and the finite bounds."""
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(is_missing(c)).alias("n_missing"),
                F.count_if(is_infinite(c)).alias("n_infinite"),
                F.min(finite(c)).alias("finite_min"),
                F.max(finite(c)).alias("finite_max"),
            )
            for c in cols
        ]
    )


def null_inf_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_missing, n_infinite, finite_min, finite_max); missing is NULL or NaN."""
    return df.agg(profile_array(cols).alias("p")).select(F.inline("p"))


# --- exact medians ---------------------------------------------------------------------------

_DIGIT = 16  # bits of a key that one pass decides
_RANKS = "column int, prefix long, digit int, n long"


def _ordered_keys(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; -0.0 is 0.0."""
    bits = (values + 0.0).view(np.uint64)
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def _value_of(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], dtype=np.uint64).view(np.float64)[0])


def _digit_counts(table: DataFrame, level: int, prefixes: list[list[int]]) -> DataFrame:
    """(column, prefix, digit, n): how often each digit of the level follows the prefixes, of all columns in one pass; a task sends what it has seen."""
    shift = np.uint64(64 - _DIGIT * (level + 1))

    def count(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for c, own in enumerate(prefixes):
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                keys = _ordered_keys(x[~np.isnan(x)])
                for prefix in own:
                    mine = keys if level == 0 else keys[keys >> (shift + np.uint64(_DIGIT)) == np.uint64(prefix)]
                    digits = (mine >> shift & np.uint64((1 << _DIGIT) - 1)).astype(np.int64)
                    found = np.bincount(digits, minlength=1 << _DIGIT)
                    sums[c, prefix] = sums[c, prefix] + found if (c, prefix) in sums else found
        for (c, prefix), n in sums.items():
            (at,) = np.nonzero(n)
            signed = prefix - (1 << 64) if prefix >> 63 else prefix
            columns = [pa.array(np.full(len(at), c), pa.int32()), pa.array(np.full(len(at), signed), pa.int64()), pa.array(at, pa.int32()), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["column", "prefix", "digit", "n"])

    return table.mapInArrow(count, _RANKS).groupBy("column", "prefix", "digit").agg(F.sum("n").alias("n"))


def exact_ranks(df: DataFrame, values: list[Column], ranks: Callable[[int, int, int, int], list[int]]) -> tuple[list[list[float]], list[tuple[int, int, int, int]]]:
    """Exact values at given ranks (from 0) of several double columns, whatever the number of rows: at most four passes in all.

    A radix selection: a pass counts 16 bits of the values' order-preserving keys, for all columns at once; a rank's digit is where the running sum
    of the counts passes it, and the next pass counts only values with the digits found so far. A task holds 65,536 counts for each
    prefix. ``ranks`` gives a column's ranks from its numbers of present values, of -inf, of +inf and of missing values (NULL or NaN), which are returned too.
    """
    table = df.select(*[x.cast("double").alias(f"v{i}") for i, x in enumerate(values)])
    total = None
    targets: list[list[tuple[int, int]]] = []  # for each column and rank: the prefix, and the rank among values that have it
    for level in range(64 // _DIGIT):
        prefixes = [[0]] * len(values) if level == 0 else [sorted({p for p, _ in own}) for own in targets]
        counts = _digit_counts(table, level, prefixes).persist()
        try:
            if level == 0:
                low, high = (int(_ordered_keys(np.array([v]))[0]) >> 64 - _DIGIT for v in (-math.inf, math.inf))
                ends = [F.sum(F.when(F.col("digit") == d, F.col("n")).otherwise(0)).alias(name) for d, name in ((low, "low"), (high, "high"))]
                sums = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("n"), *ends).collect()}
                total = df.count() if total is None else total
                facts = [(s["n"], s["low"], s["high"], total - s["n"]) if (s := sums.get(c)) else (0, 0, 0, total) for c in range(len(values))]
                targets = [[(0, r) for r in ranks(*f)] for f in facts]
            wanted = [(c, p - (1 << 64) if p >> 63 else p, i, r) for c, own in enumerate(targets) for i, (p, r) in enumerate(own)]
            if not wanted:
                break
            before = Window.partitionBy("column", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
            running = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
            asked = df.sparkSession.createDataFrame(wanted, "column int, prefix long, i int, rank long")
            inside = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
            found = running.join(F.broadcast(asked), ["column", "prefix"]).where(inside).select("column", "i", "digit", "before").collect()  # a row for each rank
            if len(found) != len(wanted):
                raise ArithmeticError("the table changed between two passes over it")
            for f in found:
                p, r = targets[f["column"]][f["i"]]
                targets[f["column"]][f["i"]] = (p << _DIGIT | f["digit"], r - f["before"])
        finally:
            counts.unpersist()
    return [[_value_of(p) for p, _ in own] for own in targets], facts


def _middle_ranks(n: int, *_: int) -> list[int]:
    return [(n - 1) // 2, n // 2] if n else []


def midpoint(low: float, high: float) -> float:
    return low if low == high else (low + high) / 2


def exact_medians(df: DataFrame, values: dict[str, Column]) -> dict[str, float | None]:
    """Exact median of each named double expression (NULL and NaN skipped), None without a value."""
    if not values:
        return {}
    found, _ = exact_ranks(df, list(values.values()), _middle_ranks)
    return {c: midpoint(*own) if own else None for c, own in zip(values, found)}


def medians_of_filled(df: DataFrame, values: dict[str, Column]) -> dict[str, tuple[float | None, float | None]]:
    """For each column its median, and the median of its finite values once missing ones are filled with the first; both from the same passes.

    The second is a value whose rank is shifted by the filled ones or not, or the first median itself; both candidates are looked up.
    """

    def ranks(n: int, low: int, high: int, missing: int) -> list[int]:
        inner = n - low - high + missing  # finite values, if the first median is finite
        outer = n - low - high
        places = [r + low for total in {inner, outer} for r in _middle_ranks(total)]
        return _middle_ranks(n) + sorted({min(max(p, low), n - high - 1) for place in places for p in (place, place - missing)}) if n > low + high else _middle_ranks(n)

    found, facts = exact_ranks(df, list(values.values()), ranks)
    out: dict[str, tuple[float | None, float | None]] = {}
    for (c, own), (n, low, high, missing) in zip(zip(values, found), facts):
        if not n:
            out[c] = (None, None)
            continue
        first = midpoint(*own[:2])
        known = dict(zip(ranks(n, low, high, missing)[2:], own[2:]))
        filled = missing if math.isfinite(first) else 0

        def at(rank: int, low=low, high=high, n=n, known=known, first=first, filled=filled) -> float:
            plain, moved = (known.get(min(max(rank + low - k, low), n - high - 1)) for k in (0, filled))
            if rank + low < n - high and plain is not None and plain <= first:
                return plain
            return moved if rank + low - filled >= low and moved is not None and moved > first else first

        size = n - low - high + filled
        out[c] = (first, midpoint(*map(at, _middle_ranks(size))) if size else None)
    return out


def column_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, median) over the present values."""
    medians = exact_medians(df, {c: present(c) for c in cols})
    return df.sparkSession.createDataFrame([(c, medians[c]) for c in cols], "column string, median double")
