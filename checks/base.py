"""Registration and the pieces the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratafold.functions.scalar import ColumnLike, col
from stratafold.sources.tables import read_table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]  # fewer do not identify a row
LK = ", ".join(LINE_KEY)
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FOLDS = [0, 1, 2]


class Checks:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register a query under its function's name, with its SQL if it can be written in SQL."""

        def register(fn):
            if fn.__name__ in self.queries:
                raise ValueError(f"query {fn.__name__} exists already")
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.sql[fn.__name__] = sql
            return fn

        return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rounded(c: ColumnLike, digits: int = 6) -> Column:
    """Rounded for comparison across engines, half away from zero; adding zero turns -0.0 into 0.0.

    For finite numbers. Spark's own rounding goes through decimal text and takes several times as long.
    """
    x, scale = col(c).cast("double"), F.lit(float(10**digits))
    return F.signum(x) * (F.floor(F.abs(x) * scale + 0.5) / scale) + F.lit(0.0)


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round({expression}, {digits}) + 0.0)"


def hash_sql(key: list[str], seed: int | str = 42) -> str:
    """SQL for the reproducible random order of folds."""
    return f"md5('{seed}' || " + " || ".join(f"coalesce(length(CAST({k} AS VARCHAR)) || ':' || {k}, '-')" for k in key) + ")"


def fold_sql(source: str, key: list[str], label: str, k: int = 3, seed: int = 42) -> str:
    """SQL for the stratified folds of a table or subquery: each class in k runs of its order, whose sizes differ by one at most.

    rank() less one counts the rows of the classes before, in hash order of the class.
    """
    return f"""SELECT * EXCLUDE (f_r, f_n, f_s), CAST((f_s + CASE WHEN f_r < (f_n % {k}) * (f_n // {k} + 1) THEN f_r // (f_n // {k} + 1)
        ELSE f_n % {k} + (f_r - (f_n % {k}) * (f_n // {k} + 1)) // (f_n // {k}) END) % {k} AS INTEGER) AS fold
      FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {hash_sql(key, seed)}, {", ".join(key)}) - 1 AS f_r,
        count(*) OVER (PARTITION BY {label}) AS f_n, rank() OVER (ORDER BY {hash_sql([label], 'class')}) - 1 AS f_s FROM {source})"""


def holdout_sql(source: str, key: list[str], label: str, fraction: float = 0.2) -> str:
    """SQL for the stratified hold-out: every row with part 'test' or 'train'."""
    return f"""SELECT * EXCLUDE (h_n, h_take, h_label, t, wanted, quota), CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY {hash_sql(key)}, {", ".join(key)}) <= h_take THEN 'test' ELSE 'train' END AS part
      FROM {source} AS src JOIN (
        SELECT *, CASE WHEN h_n < 2 THEN 0 ELSE least(floor(quota) + CASE WHEN row_number() OVER (ORDER BY h_n < 2, quota - floor(quota) DESC, h_n, {hash_sql(['h_label'], 'class')}) <= wanted - sum(floor(quota)) OVER () THEN 1 ELSE 0 END, h_n - 1) END AS h_take
        FROM (SELECT *, CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE wanted * (CASE WHEN h_n > 1 THEN h_n ELSE 0 END)::DOUBLE / t END AS quota FROM (
          SELECT *, ceil({fraction}::DOUBLE * t) AS wanted FROM (
            SELECT *, sum(CASE WHEN h_n > 1 THEN h_n ELSE 0 END) OVER ()::DOUBLE AS t FROM (SELECT {label} AS h_label, count(*) AS h_n FROM {source} GROUP BY 1))))
      ) AS shares ON src.{label} IS NOT DISTINCT FROM shares.h_label"""


# A labelled table with 1-based classes and some rare ones: quality and toxicity of documents.
def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = (F.col("quality") * 2 + F.col("toxic") + 1).cast("int")
    return table(spark, sf_dir, "labels").select("doc_id", grade.alias("grade"))


GRADED = "SELECT doc_id, CAST(quality * 2 + toxic + 1 AS INTEGER) AS grade FROM labels"
