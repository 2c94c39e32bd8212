"""Approximate nearest neighbours by an inverted index of vectors, beside the exact join.

Centres are fitted on a bounded sample of the points. Every point is filed under its nearest centre, and a query searches the files of its
``probes`` nearest centres, so that it meets a small share of the points instead of all. Distances inside a file are exact. Files are broadcast in
chunks, and a query carries its k best from pass to pass: no pair of query and file is written or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import scratch_folder, short_shuffles, stored
from .folds import hash_order
from .knn import BLOCK_ROWS, _matrix, _width, in_chunks, no_best, passes

SAMPLE = 20_000  # points the centres are fitted on, at most
MAX_CENTRES = 4_096


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)


def fit_centres(sample: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Means of the sample's groups (Lloyd's rounds from evenly spaced rows of the sample)."""
    if len(sample) <= centres:
        return sample
    found = sample[np.linspace(0, len(sample) - 1, centres).astype(int)]
    for _ in range(rounds):
        own = squared_distances(sample, found).argmin(1)
        size = np.bincount(own, minlength=centres)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return found


@dataclass
class VectorIndex:
    """Centres, the points filed under them, and the columns that come with a point."""

    centres: np.ndarray
    filed: DataFrame
    key: str
    vec: str
    carry: list[str]
    sizes: dict[int, int]


def _probed(df: DataFrame, keep: list[str], vec: str, centres: np.ndarray, probes: int) -> DataFrame:
    """The columns ``keep`` and ``_probes``, the nearest centres of each vector."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    schema = StructType([*[df.schema[c] for c in keep], StructField("_probes", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def place(batches):
        for batch in filter(len, batches):
            far = squared_distances(_matrix(batch.column(vec)), shared.value)
            near = np.argpartition(far, min(probes, far.shape[1]) - 1, axis=1)[:, :probes]
            offsets = np.arange(len(batch) + 1) * near.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(near.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), lists.cast(arrow.field("_probes").type)], schema=arrow)

    return df.mapInArrow(place, schema)


def build_index(points: DataFrame, key: str, vec: str, carry: list[str] = (), centres: int = 64, sample: int = SAMPLE) -> VectorIndex:
    """Index all points with a vector. The centres are fitted on the ``sample`` points that come first in hash order of the key; all points are filed.

    Of equal vectors, hot groups of copies among them, all are kept; a search needs the k lowest keys of them.
    """
    if not 1 <= centres <= MAX_CENTRES:
        raise ValueError(f"between 1 and {MAX_CENTRES} centres")
    points = points.select(key, *carry, vec).where(F.col(vec).isNotNull())
    first = points.withColumn("_h", hash_order([key], 0)).orderBy("_h", key).limit(sample).select(vec)
    fitted = fit_centres(_matrix(first.toArrow()[vec]), centres)
    if len(fitted):
        filed = _probed(points, points.columns, vec, fitted, 1).withColumn("_file", F.get("_probes", F.lit(0))).drop("_probes")
    else:
        filed = points.withColumn("_file", F.lit(0))
    sizes = {r["_file"]: r["count"] for r in filed.groupBy("_file").count().collect()}  # a row for each centre
    return VectorIndex(fitted, filed, key, vec, list(carry), sizes)


def search_index(index: VectorIndex, queries: DataFrame, query_key: list[str], k: int, probes: int = 8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query key.., point key, carried columns, distance, rank) of the k nearest points in the ``probes`` files nearest to each query; ties to the lower key."""
    cols = [index.key, *index.carry]
    queries = queries.select(*query_key, index.vec).where(F.col(index.vec).isNotNull())
    fields = [queries.schema[c] for c in query_key] + [index.filed.schema[c] for c in cols]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("distance", DoubleType())])
    spark = queries.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], StructType([*schema.fields, StructField("rank", IntegerType())]))
    vec, n = index.vec, len(index.centres)
    copies = Window.partitionBy(vec).orderBy(F.col(index.key).asc_nulls_last())  # of equal vectors only the lowest keys are found
    filed = index.filed.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k).drop("_copy")
    with scratch_folder(spark, "index") as folder, short_shuffles(spark):
        filed = stored(filed, f"{folder}/filed")
        sizes = {r["_file"]: r["bytes"] for r in filed.groupBy("_file").agg(F.sum(_width(vec, cols)).alias("bytes")).collect()}  # a row for each centre
        chunked, parts = in_chunks(filed, "_file", sizes, cols, vec, f"{folder}/chunks")
        files = np.array([f for f, _ in parts])
        asked = _probed(queries, queries.columns, vec, index.centres, probes).withColumn("_best", no_best(index.filed, cols))
        asked = stored(asked.repartition(4 * spark.sparkContext.defaultParallelism), f"{folder}/asked")

        def probed(batch, q, own):
            go = np.zeros((batch.num_rows, n), dtype=bool)
            lists = batch["_probes"]
            size = np.asarray(pa.compute.list_value_length(lists))
            go[np.repeat(np.arange(batch.num_rows), size), np.asarray(lists.flatten())] = True
            return np.where(go[:, files[own]], 0.0, np.nan)

        chunks = sorted({c for _, c in parts})
        found = passes(asked, chunked, chunks, k, vec, query_key, cols, probed, block_rows, folder)
    best = Window.partitionBy(*query_key).orderBy("distance", index.key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def visited_share(index: VectorIndex, queries: DataFrame, probes: int = 8) -> float:
    """Pairs of query and point that a search measures, as a share of all pairs."""
    total = sum(index.sizes.values())
    asked = _probed(queries.select(index.vec).where(F.col(index.vec).isNotNull()), [], index.vec, index.centres, probes)
    counts = {r["_file"]: r["count"] for r in asked.select(F.explode("_probes").alias("_file")).groupBy("_file").count().collect()}
    n = sum(counts.values()) / max(1, min(probes, len(index.centres)))
    return sum(c * index.sizes.get(f, 0) for f, c in counts.items()) / max(1.0, n * total)
