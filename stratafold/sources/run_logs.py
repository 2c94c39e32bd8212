"""Run logs: one flat JSON object per file, whose keys say what a record is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_run_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(run, state): the file's path and its text. A log is one JSON document and so one row."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("run"), F.col("value").alias("state"))


def log_entries(logs: DataFrame) -> DataFrame:
    """(run, pos, entry, payload): the top-level keys of each log in file order, with their value as JSON text."""
    parsed = F.from_json("state", "map<string,string>")
    return logs.select("run", F.posexplode(parsed).alias("pos", "entry", "payload"))
