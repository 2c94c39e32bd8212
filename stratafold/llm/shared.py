"""Pieces the corpus operators share: the shared folder for intermediate tables, and column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratafold.session import checkpoint_dir

WHITE = r"[\x20\x09-\x0D]+"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share (spark.checkpoint.dir); deleted when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, is computed once.

    Files of the shuffles behind it go when it is written: nothing reads them any more. With ``batch_rows`` Python functions in its plan
    get batches of so many rows at most, which bounds what long texts take in memory.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows is not None:
        settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    before = {setting: spark.conf.get(setting, None) for setting in settings}
    try:
        for setting, value in settings.items():
            spark.conf.set(setting, value)
        df.write.parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.unset(setting) if value is None else spark.conf.set(setting, value)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        taken.add(f"_{name}".lower())
        out.append(f"_{name}")
    return out


def with_nth(df: DataFrame, key: str, place: str, out: str) -> DataFrame:
    """Number the rows of each key from 0 in the order of ``place`` (monotonically increasing ids of a written table).

    Rows are numbered inside each of the partitions the ids were made in, and the counts of earlier ones are added: a key that holds most
    rows is numbered by as many tasks.
    """
    part, before, n = unused_names(df, "part", "before", "n")
    parted = df.withColumn(part, F.shiftright(place, 33))
    counts = parted.groupBy(key, part).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = counts.select(key, part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    local = parted.withColumn(n, F.row_number().over(Window.partitionBy(key, part).orderBy(place)) - 1)
    return local.join(starts, [key, part]).select(*df.columns, (F.col(n) + F.col(before)).alias(out))
