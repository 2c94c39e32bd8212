"""Column selection, label handling, set operations and value mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..bounded import in_list, pin


def split_features_label(
    df: DataFrame, key: list[str], label: str, drop: list[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(features with key, label with key); ``drop`` lists superseded columns."""
    return df.drop(label, *drop), df.select(*key, label)


def shift_label(df: DataFrame, label: str, by: int) -> DataFrame:
    """label - by: 1-based classes to the 0-based ones learners want (by=1), and back (by=-1)."""
    return df.withColumn(label, F.col(label) - F.lit(by))


def normalize_label(df: DataFrame, label: str) -> DataFrame:
    """Shift to 0-based labels only when the smallest label is 1."""
    lowest = df.agg(F.min(label)).scalar()
    return df.withColumn(label, F.when(lowest == 1, F.col(label) - 1).otherwise(F.col(label)))


def cast_label(df: DataFrame, label: str, to: str) -> DataFrame:
    """Cast a label; "category" means its text form."""
    return df.withColumn(label, F.col(label).cast("string" if to == "category" else to))


def select_columns(
    df: DataFrame,
    contains: str | None = None,
    prefix: str | tuple[str, ...] | None = None,
    not_prefix: str | tuple[str, ...] | None = None,
    numeric: bool = False,
    among: list[str] | None = None,
) -> list[str]:
    """Column names by substring, prefix, numeric type, or those of a list that exist; order of the schema."""
    return [
        f.name
        for f in df.schema.fields
        if (contains is None or contains in f.name)
        and (prefix is None or f.name.startswith(prefix))
        and (not_prefix is None or not f.name.startswith(not_prefix))
        and (not numeric or isinstance(f.dataType, NumericType))
        and (among is None or f.name in among)
    ]


def align_columns(df: DataFrame, like: DataFrame, fill: float = 0) -> DataFrame:
    """The columns of ``like`` in its order: missing ones filled, extra ones dropped."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(fill).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        ]
    )


def schema_difference(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns of ``a`` that ``b`` lacks."""
    have = set(b.columns)
    return [c for c in a.columns if c not in have]


def union_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def tag_split(train: DataFrame, test: DataFrame, tag: str = "split") -> DataFrame:
    """Stack both tables for joint preprocessing; ``tag`` says where a row came from."""
    return union_tables(train.withColumn(tag, F.lit("train")), test.withColumn(tag, F.lit("test")))


def untag(df: DataFrame, tag: str = "split") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(tag) == "train").drop(tag), df.where(F.col(tag) == "test").drop(tag)


def flag_in(df: DataFrame, column: str, values: DataFrame, flag: str) -> DataFrame:
    """Add a boolean column: is ``column`` in the one-column table ``values``?"""
    (name,) = values.columns
    values = values.where(F.col(name).isNotNull()).distinct()
    pinned = pin(values)
    if pinned is not None:
        return df.withColumn(flag, F.coalesce(in_list(F.col(column), pinned.values(name)), F.lit(False)))
    listed = values.select(F.col(name).alias(column), F.lit(True).alias(flag))
    return df.join(listed, [column], "left").select(*df.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def replace_values(df: DataFrame, column: str, values: DataFrame, by: Column) -> DataFrame:
    """Map every value of ``column`` that is in ``values`` to one new value."""
    flagged = flag_in(df, column, values, "_listed")
    return flagged.withColumn(column, F.when(F.col("_listed"), by).otherwise(F.col(column))).drop("_listed")


def map_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Map single values; values without an entry stay."""
    out = F.col(column)
    for old, new in mapping.items():
        out = F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def add_if_all(df: DataFrame, candidates: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add each {name: (predicate, expression)} whose predicate holds on every row.

    The schema depends on the data, so all predicates are tested by one aggregate of one row. A NULL
    predicate counts as false; on an empty table every predicate holds.
    """
    checks = [F.bool_and(F.coalesce(p, F.lit(False))).alias(name) for name, (p, _) in candidates.items()]
    holds = df.agg(*checks).first()
    return df.withColumns({name: e for name, (_, e) in candidates.items() if holds[name] is not False})


def drop_intermediates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)
