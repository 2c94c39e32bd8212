"""Readers and the derived scoring set."""

import uuid

from pyspark.sql import functions as F

from stratafold.operators.projection import schema_difference
from stratafold.session import checkpoint_dir
from stratafold.sources.run_logs import log_entries, read_run_logs
from stratafold.sources.tables import derive_scoring_set, read_optional, read_table, write_predictions

from .base import FEATURES, LINE_KEY, LK, Checks, table

CHECKS = Checks()
_LOG_EVENTS = 1 << 14  # event ids in a log: about a megabyte of text


@CHECKS.add(f"SELECT {LK}, {', '.join(FEATURES)} FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def read_table_pushdown(spark, sf_dir):
    """Filter and column list reach the file scan."""
    lines = read_table(spark, f"{sf_dir}/lineitem.parquet")
    return lines.where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select(*LINE_KEY, *FEATURES)


@CHECKS.add("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def read_optional_absent(spark, sf_dir):
    """An optional second table that is not there adds no rows."""
    orders = table(spark, sf_dir, "orders")
    extra = read_optional(spark, f"{sf_dir}/orders_extra.parquet", orders.schema, "parquet")
    return orders.unionByName(extra).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@CHECKS.add("SELECT o_orderkey + (SELECT count(*) FROM orders) AS o_orderkey, o_custkey, o_totalprice FROM orders")
def derived_scoring_set(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return derive_scoring_set(orders, "o_orderstatus", "o_orderkey")


@CHECKS.add(
    """SELECT CAST(event_id AS VARCHAR) AS run, CAST(0 AS INTEGER) AS pos, key AS entry, value AS payload FROM (
         SELECT event_id, unnest(json_keys(props)) AS key, props FROM events) t,
         LATERAL (SELECT json_extract_string(props, '$.' || key) AS value) v"""
)
def json_object_entries(spark, sf_dir):
    """Top-level keys of a JSON object per row; every object in this table has one key."""
    logs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("run"), F.col("props").alias("state"))
    return log_entries(logs)


def _shared(spark, name):
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@CHECKS.add("SELECT o_orderkey, o_orderstatus FROM orders")
def predictions_written_and_read(spark, sf_dir):
    """The two-column file, written in parts and read back by header and schema."""
    path, orders = _shared(spark, "predictions"), table(spark, sf_dir, "orders")
    write_predictions(orders, path, "o_orderkey", "o_orderstatus")
    return read_table(spark, path, orders.select("o_orderkey", "o_orderstatus").schema, "csv")


@CHECKS.add(
    """SELECT user_id, key AS entry, value AS payload FROM (SELECT event_id, user_id, unnest(json_keys(props)) AS key, props FROM events) t,
         LATERAL (SELECT json_extract_string(props, '$.' || key) AS value) v"""
)
def run_logs_written_and_read(spark, sf_dir):
    """One log file per block of event ids, its keys user and event: read whole, then taken apart.

    A log holds at most ``_LOG_EVENTS`` ids of all users, so that logs grow in number and not in size, and there are no files
    of a few lines, whose opening takes longer than their text. Events without an id have a log for each user. All stand in one folder.
    """
    path, events = _shared(spark, "logs"), table(spark, sf_dir, "events")
    name = F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce(F.col("event_id").cast("string"), F.lit("")))
    entry = F.concat(F.lit('"'), name, F.lit('": '), F.col("props"))
    block = F.floor(F.col("event_id") / _LOG_EVENTS).alias("block")
    unnumbered = F.when(F.col("event_id").isNull(), F.col("user_id")).alias("unnumbered")
    logs = events.groupBy(block, unnumbered).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("}")).alias("value"))
    logs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    outer = log_entries(read_run_logs(spark, path))
    user = F.nullif(F.split_part("entry", F.lit("/"), F.lit(1)), F.lit("")).cast("long")
    own = outer.select(F.col("payload").alias("state"), user.alias("run"))
    return log_entries(own).select(F.col("run").alias("user_id"), "entry", "payload")


_EXTRA = ["o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]


@CHECKS.add(f"SELECT {', '.join(f'count({c}) AS {c}' for c in _EXTRA)} FROM orders")
def difference_of_schemas(spark, sf_dir):
    """How many values stand in the columns that a table has beyond a predictions file."""
    orders = table(spark, sf_dir, "orders")
    return orders.agg(*[F.count(c).alias(c) for c in schema_difference(orders, orders.select("o_orderkey", "o_orderstatus"))])
