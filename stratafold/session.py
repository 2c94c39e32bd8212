"""Session set-up shared by the tests, the benchmark and stand-alone use."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "stratafold", memory: str = "12g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the submitter's session is used as is."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        # the JVM does not compile methods above 8000 bytes; beyond that, wide projections must be split
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints: the one the cluster names, else a local one for tests."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="stratafold-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


@contextlib.contextmanager
def scratch_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder all executors share, for tables that are written and read again; removed when the work with it is done."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Files of shuffles go when the query that made them has ended: nothing reads them any more. Not for fits that run side by side."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def stored(df: DataFrame, path: str, rows: int = 0) -> DataFrame:
    """Write a table and read it back: it is computed once, and a lost executor costs no more than reading it again. ``rows`` of a file at most, if given."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, name: str, rows: int = 1 << 18) -> DataFrame:
    """A table that many fits read, written to the shared folder in files of at most ``rows`` rows, so that its readers share it evenly; goes with the driver."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return stored(df, path, rows)
