"""Rows of equal bins as one row that counts them, for Spark's tree learners.

A tree that splits on quantile bins sees no more of a row than its bins, so rows of the same bins, class and weight are one row with
their number. What a fit reads many times is then bounded by the bins, not by the table; with many columns it is at most the table.
Row samples are drawn from the numbers: as many of n equal rows as a draw of each by itself would take.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

VECTOR, TIMES = "_vector", "_times"
BINS = 32  # of a column, as Spark's tree learners have; the lowest value, and missing ones, have bins of their own
MAX_BINS = BINS + 2


def quantiles(df: DataFrame, cols: list[str], shares: list[float], error: float) -> list[list[float]]:
    """Distinct values of each column near the given shares of its rows; one pass for all columns."""
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return [sorted(set(e)) for e in numbers.approxQuantile(numbers.columns, shares, error)]


class Cells:
    """Bins of columns by the quantiles of the training rows: bin i holds values above edge i - 1 and up to edge i, the last one missing values."""

    def __init__(self, train: DataFrame, cols: list[str], bins: int = BINS) -> None:
        found = quantiles(train, cols, [i / bins for i in range(bins)], 1 / (4 * bins))
        self.cols, self.edges = list(cols), [[e for e in own if math.isfinite(e)] or [0.0] for own in found]

    def _placed(self, df: DataFrame) -> tuple[DataFrame, list[str]]:
        own, names = [f"_n{i}" for i in range(len(self.cols))], [f"_bin{i}" for i in range(len(self.cols))]
        # a bucket holds its lower end: values change their sign, so that a bin holds its upper one
        df = df.withColumns({n: -F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for n, c in zip(own, self.cols)})
        splits = [[-math.inf, *(-e for e in reversed(edges)), math.inf] for edges in self.edges]
        df = Bucketizer(splitsArray=splits, inputCols=own, outputCols=names, handleInvalid="keep").transform(df)
        top = [len(edges) for edges in self.edges]
        return df.withColumns({n: F.when(F.col(n) > t, F.col(n)).otherwise(t - F.col(n)) for n, t in zip(names, top)}).drop(*own), names

    def placed(self, df: DataFrame) -> DataFrame:
        """The rows with the vector of their bins."""
        df, names = self._placed(df)
        return VectorAssembler(inputCols=names, outputCol=VECTOR).transform(df).drop(*names)

    def collapsed(self, df: DataFrame, by: list[str]) -> DataFrame:
        """(vector, by.., times, pick): one row for the rows of equal bins and equal columns ``by``; ``pick`` is its hash."""
        df, names = self._placed(df.select(*dict.fromkeys([*self.cols, *by])))
        counted = df.groupBy(*names, *by).agg(F.count("*").alias(TIMES)).withColumn("_pick", F.xxhash64(*names, *by))
        return VectorAssembler(inputCols=names, outputCol=VECTOR).transform(counted).select(VECTOR, *by, TIMES, "_pick")


def _draws(pick: np.ndarray, times: np.ndarray, seed: int, take) -> np.ndarray:
    return np.array([take(np.random.Generator(np.random.Philox(key=np.array([p, seed & 0xFFFFFFFF], dtype=np.uint64))), n) for p, n in zip(pick.view(np.uint64).tolist(), times.tolist())], dtype=np.int64)


def bootstrapped(seed: int, trees: int) -> Column:
    """For each tree how often the rows of a cell are drawn with replacement: a row's number is Poisson(1), that of n rows Poisson(n). Reruns agree."""

    @F.arrow_udf("array<long>")
    def drawn(picks: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pick, times in picks:
            found = _draws(pick.to_numpy(), times.to_numpy(), seed, lambda r, n: r.poisson(n, trees))
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(pick) + 1, dtype=np.int32) * trees), pa.array(found.ravel()))

    return drawn("_pick", TIMES)


def sampled(seed: int, share: float) -> Column:
    """How many rows of a cell are in a sample without replacement of about ``share`` of all rows. Reruns agree."""

    @F.arrow_udf("long")
    def drawn(picks: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pick, times in picks:
            yield pa.array(_draws(pick.to_numpy(), times.to_numpy(), seed, lambda r, n: r.binomial(n, share)))

    return drawn("_pick", TIMES)
