"""Typed table readers, the predictions sink and the derived scoring set."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table. CSV has a header row and takes its types from ``schema``, which saves a pass over the file.

    Header names are checked against the schema, so a reordered file fails instead of shifting columns.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.load(path)


def read_optional(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Like ``read_table``, but a path that does not exist gives an empty table of that schema."""
    try:
        return read_table(spark, path, schema, fmt)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def write_predictions(df: DataFrame, path: str, key: str, label: str) -> None:
    """Two-column CSV with a header, as a directory of part files written in parallel."""
    df.select(key, label).write.mode("overwrite").option("header", True).csv(path)


def derive_scoring_set(df: DataFrame, label: str, key: str) -> DataFrame:
    """An unlabelled set made of labelled rows: no label, ids shifted by the number of rows."""
    n = df.agg(F.count("*")).scalar()
    return df.drop(label).withColumn(key, F.col(key) + n)
