"""Small derived tables (class lists, class counts, bounds) that may leave the cluster.

A derived table is *pinned* when it has at most ``MAX_PINNED_ROWS`` rows: it is fetched once and
comes back as a local relation, so later steps can use it as literals (which reach the file scan)
or broadcast it. One that is larger stays distributed and its users take an ordinary join, which
adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MAX_PINNED_ROWS = 10_000


@dataclass(frozen=True)
class Pinned:
    df: DataFrame
    rows: list[dict]

    def values(self, column: str) -> list:
        return [row[column] for row in self.rows]


def pin(df: DataFrame, max_rows: int = MAX_PINNED_ROWS) -> Pinned | None:
    """Fetch ``df`` if it has at most ``max_rows`` rows, else None. Never fetches more than max_rows + 1."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return Pinned(df.sparkSession.createDataFrame(table, df.schema), table.to_pylist())


def local_if_small(df: DataFrame, max_rows: int = MAX_PINNED_ROWS) -> DataFrame:
    """The same table, computed once and kept local if it is small; several uses then cost one scan."""
    pinned = pin(df, max_rows)
    return df if pinned is None else pinned.df


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_rows: int = MAX_PINNED_ROWS
) -> DataFrame:
    """Join that broadcasts ``small`` only once its row count is known to be within the bound."""
    pinned = pin(small, max_rows)
    return big.join(small if pinned is None else F.broadcast(pinned.df), on, how)


def is_in(df: DataFrame, column: str, values: DataFrame, keep: bool = True, max_rows: int = MAX_PINNED_ROWS) -> DataFrame:
    """Rows whose ``column`` is (or, with keep=False, is not) in the one-column table ``values``.

    A short list becomes an IN predicate and reaches the scan; a long one is a semi or anti join.
    NULL is in no list.
    """
    (name,) = values.columns
    values = values.where(F.col(name).isNotNull())
    pinned = pin(values, max_rows)
    if pinned is not None:
        return df.where(in_list(F.col(column), pinned.values(name), keep))
    other = values.select(F.col(name).alias(column)).distinct()
    return df.join(other, [column], "left_semi" if keep else "left_anti")


def in_list(column: Column, values: list, keep: bool = True) -> Column:
    if keep:
        return column.isin(values) if values else F.lit(False)
    return (~column.isin(values)) | column.isNull() if values else F.lit(True)
