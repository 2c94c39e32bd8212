"""Naive Bayes over any number of classes: the model comes in chunks, no row is written once for each block it meets."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stratafold.operators import bayes as nb
from stratafold.operators.folds import stratified_kfold
from test_neighbours import shuffled


def crowd(spark, n, classes, text=False):
    """Classes side by side that reach far into each other: a row meets many blocks."""
    rng = np.random.default_rng(6)
    y = np.arange(n) % classes
    data = [(i, f"c{c:03d}" if text else int(c), i // classes % 3, float(c + rng.normal() * 40), float(rng.normal())) for i, c in enumerate(y)]
    return data, f"id int, y {'string' if text else 'int'}, fold int, a double, b double"


@pytest.mark.parametrize(("size", "text"), [(4000, False), (20_000, True)])
def test_chunks_of_the_model_give_what_listed_classes_give(spark, monkeypatch, size, text):
    for name, value in {"BLOCK_CLASSES": 8, "SLICE_CLASSES": 8, "MODEL_BYTES": size, "_ROWS_OF_TASK": 50, "_PAIRS_AT_A_TIME": 40}.items():
        monkeypatch.setattr(nb, name, value)
    data, schema = crowd(spark, 900, 100, text)
    odd = [(2000, data[0][1], 0, None, 1.0), (2001, data[0][1], 1, float("nan"), 1.0), (2002, data[1][1], None, 3.0, 1.0), (2003, data[1][1], 9, 3.0, 1.0)]
    # keys that come twice, in rows that differ too, and keys that are missing
    some = [data[0], data[1], (3, *data[50][1:2], data[3][2], 70.0, 0.0), (None, data[7][1], 0, 9.0, 0.0), (None, data[7][1], 0, 55.0, 0.0)]
    df = spark.createDataFrame(data + odd + some, schema).repartition(3)
    listed = sorted({r[1] for r in data})
    got = nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1, 2], key=["id"], visits="seen")
    assert got.columns == [*df.columns, "prediction", "seen"] and got.count() == len(data) + len(odd) + len(some) - 1
    plain = "id is not null and id not in (3, 2000)"
    want = nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1, 2], classes=listed).where("fold < 3")
    assert rows(got.where(plain).where("fold < 3"), "id", "fold", "prediction") == rows(want.where(plain), "id", "fold", "prediction")
    assert {r.id: r.prediction for r in got.where("id in (2000, 2003)").collect()} == {2000: listed[0], 2003: None}
    # rows of one key share the best of their classes
    best = {}
    for r in want.where("id is null or id = 3").collect():
        best[r.id] = max(best.get(r.id, (-np.inf, None)), (max(r.scores), r.prediction))
    assert {(r.id, r.prediction) for r in got.where("id is null or id = 3").collect()} == {(i, p) for i, (_, p) in best.items()}


def test_rows_are_not_written_for_each_block(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(nb, "SLICE_CLASSES", 8)
    n = 12_000
    df = spark.createDataFrame(*crowd(spark, n, 600)).repartition(4)
    before = shuffled(spark)
    assert nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1, 2], key=["id"]).where("prediction is not null").count() == n
    assert shuffled(spark) - before < 160 * n  # a row meets dozens of blocks


def test_cut_points_of_many_groups_are_written_once(spark, monkeypatch):
    """More groups than are fetched: the same folds, and few files are left."""
    from stratafold import bounded

    data = [(i, i % 700 if i % 50 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, y int").repartition(4)
    want = rows(stratified_kfold(df, ["id"], "y"))
    before = shuffled(spark)
    for f in (bounded.pin, bounded.join_small, bounded.local_if_small):
        monkeypatch.setattr(f, "__defaults__", tuple(10 if x == bounded.MAX_PINNED_ROWS else x for x in f.__defaults__))
    folded = stratified_kfold(df, ["id"], "y")
    left = shuffled(spark) - before
    assert rows(folded) == want
    assert left < 80 * len(data)
    sizes = folded.groupBy("y", "fold").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d"), F.count("*").alias("n"))
    assert sizes.where("n = 3 and d > 1").count() == 0
