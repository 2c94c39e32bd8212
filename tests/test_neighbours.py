"""Nearest neighbours where the points come in chunks: whole results, and disk in proportion to the tables."""

import os
from pathlib import Path

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stratafold.operators import knn, vector_index as vi
from stratafold.session import checkpoint_dir

POINTS = "pid string, y int, v array<float>"


def shuffled(spark):
    """Bytes of the shuffle files there are, and of what lies in the shared folder."""
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    at = checkpoint_dir(spark).removeprefix("file:")
    return sum(files.apply(i).length() for i in range(files.size())) + sum(p.stat().st_size for p in Path(at).rglob("*") if p.is_file())


def tables(spark, n=400, nulls=True):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(n, 3)), 1).astype("float32")
    v[: n // 3] = v[0]  # a hot vector
    v[n // 2 :: 5] *= 40
    data = [(None if nulls and i % 97 == 5 else f"p{i:04d}", i % 4, x.tolist()) for i, x in enumerate(v)]
    if nulls:
        data += [("none", 1, None), ("odd", 1, [float("nan"), 0.0, 1.0]), ("p0399", 3, v[-1].tolist())]
    queries = [(i, x.tolist()) for i, x in enumerate(v[::3] + np.float32(0.1))] + [(None, v[0].tolist()), (5000, None), (7, v[9].tolist())]
    return spark.createDataFrame(queries, "qid int, v array<float>").repartition(3), spark.createDataFrame(data, POINTS).repartition(4)


@pytest.mark.parametrize(("chunk", "pivots"), [(2500, 3), (4000, 30), (10**6, 5)])
def test_chunks_find_what_one_chunk_finds(spark, monkeypatch, chunk, pivots):
    """Cells larger than a chunk, repeated and missing keys, hot vectors."""
    queries, points = tables(spark)
    whole = points.where(F.col("pid").isNull() | (F.col("pid") != "odd"))
    want = knn.knn_join(queries, whole, 5, "v", ["qid"], "pid", ["y"])
    monkeypatch.setattr(knn, "CHUNK_BYTES", chunk)
    got = knn.knn_join(queries, points, 5, "v", ["qid"], "pid", ["y"], max_point_bytes=0, pivots=pivots, block_rows=16)
    assert got.schema == want.schema
    assert rows(got, "qid", "distance", "rank") == rows(want, "qid", "distance", "rank")
    named = "pid is not null"
    assert rows(got.where(named)) == rows(want.where(named))


def test_pairs_of_query_and_cell_are_not_written(spark):
    n, d = 2000, 16
    rng = np.random.default_rng(2)
    v = rng.normal(size=(n, d))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pid long, v array<double>").repartition(4)
    queries = points.select(F.col("pid").alias("qid"), "v")
    folder = checkpoint_dir(spark).removeprefix("file:")
    before, there = shuffled(spark), set(os.listdir(folder))
    got = knn.knn_join(queries, points, 3, "v", ["qid"], "pid", max_point_bytes=0)
    assert got.count() == 3 * n
    assert shuffled(spark) - before < 8 * n * d * 8  # each query met some forty cells
    assert not [f for f in set(os.listdir(folder)) - there if f.startswith("cells-")]


def test_queries_that_are_few_or_none(spark):
    queries, points = tables(spark)
    assert knn.knn_join(queries.limit(0), points, 5, "v", ["qid"], "pid", max_point_bytes=0).count() == 0
    odd = points.where("pid = 'odd'")
    assert knn.knn_join(queries, odd.union(odd), 5, "v", ["qid"], "pid", max_point_bytes=0).count() == 0


@pytest.mark.parametrize("chunk", [2500, 10**6])
def test_index_in_chunks_finds_what_the_files_hold(spark, monkeypatch, chunk):
    queries, points = tables(spark, nulls=False)
    index = vi.build_index(points, "pid", "v", ["y"], centres=8)
    probes = {tuple(r.v): set(r._probes) for r in vi._probed(queries.where("v is not null"), ["v"], "v", index.centres, 3).collect()}
    filed = [(r.pid, r.y, np.asarray(r.v), r._file) for r in index.filed.collect()]
    want = []
    for q, own in ((r, probes[tuple(r.v)]) for r in queries.where("v is not null and (qid is null or qid <> 7)").collect()):
        near = sorted((float(np.sqrt(((np.asarray(q.v) - v) ** 2).sum())), pid, y) for pid, y, v, f in filed if f in own)[:4]
        want += [(q.qid, pid, y, far, i + 1) for i, (far, pid, y) in enumerate(near)]
    monkeypatch.setattr(knn, "CHUNK_BYTES", chunk)
    got = vi.search_index(index, queries.where("qid is null or qid <> 7"), ["qid"], 4, probes=3, block_rows=16)
    assert rows(got) == sorted(want, key=repr)


def test_probes_are_not_written(spark):
    n, d = 2000, 16
    v = np.random.default_rng(2).normal(size=(n, d))
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "pid long, v array<double>").repartition(4)
    index = vi.build_index(points, "pid", "v", centres=40)
    before = shuffled(spark)
    assert vi.search_index(index, points.select(F.col("pid").alias("qid"), "v"), ["qid"], 3, probes=25, block_rows=20).count() == 3 * n
    assert shuffled(spark) - before < 8 * n * d * 8  # a query asked 25 files of 50 points in three blocks


def test_out_of_fold_neighbours_write_no_pairs(spark):
    n, d = 1500, 16
    v = np.random.default_rng(4).normal(size=(n, d))
    df = spark.createDataFrame([(i, i % 3, i % 3, x.tolist()) for i, x in enumerate(v)], "id long, y int, fold int, v array<double>").repartition(4)
    want = rows(knn.knn_out_of_fold(df, 3, "v", "id", "y", [0, 1, 2]))
    before = shuffled(spark)
    assert rows(knn.knn_out_of_fold(df, 3, "v", "id", "y", [0, 1, 2], max_point_bytes=0)) == want
    assert shuffled(spark) - before < 12 * n * d * 8  # three searches; each query met some thirty cells in each
