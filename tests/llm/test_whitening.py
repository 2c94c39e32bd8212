"""Whitening against numpy's own eigenvectors, exact sums in Python, and inertia against known spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.llm import whitening as w
from stratafold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(vectors, components=8):
    """Per vector: whole numbers in Python, covariance and eigenvectors in numpy."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, deviation, centred @ axes / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def rotated(spectrum, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(spectrum),) * 2))
    return (q * spectrum) @ q.T


@pytest.mark.parametrize("spectrum", [np.arange(1.0, 41), 2.0 ** -np.arange(30), np.r_[np.full(9, 5.0), np.arange(20) / 20], np.r_[1e6, 1e6 - 1e-3, np.ones(14)], np.full(12, 3.0), np.r_[7.0, np.zeros(9)], [2.0]])
def test_components_of_known_spectra(spectrum):
    spectrum = np.sort(np.asarray(spectrum, dtype=float))[::-1]
    matrix = rotated(spectrum)
    for shift in (0.5, 4.99, spectrum[0] + 1, spectrum.mean()):
        if np.abs(spectrum - shift).min() > 1e-6:
            assert w.inertia(matrix, shift) == ((spectrum < shift).sum(), 0)
    intervals = w.spectrum_intervals(matrix, 8)
    pairs = [w.feast(matrix, *i) for i in intervals]
    values, axes = np.concatenate([v for v, _ in pairs])[:8], np.vstack([a for _, a in pairs])[:8]
    want = spectrum[spectrum > spectrum[0] * 1e-11][:8]
    assert len(values) == len(want) and np.allclose(values, want, rtol=1e-9, atol=spectrum[0] * 1e-13)
    assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-9
    assert np.linalg.norm(matrix @ axes.T - axes.T * values, axis=0).max() < spectrum[0] * 1e-11


def test_inertia_of_hard_matrices():
    assert w.inertia(np.array([[0.0, 1], [1, 0]]), 0.0) == (1, 0)
    assert w.inertia(np.zeros((3, 3)), 0.0) == (0, 3)
    assert w.inertia(np.diag([1.0, 2, 2, 3]), 2.0) == (1, 2)
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.standard_normal((9, 9)) * rng.choice([1e-6, 1, 1e6], (9, 1))
        a = a + a.T
        assert w.inertia(a, 0.1)[0] == (np.linalg.eigvalsh(a) < 0.1).sum()


def check(got, rows, components):
    """Rows (vec_id, vector) against the result, ids unique, either sign."""
    n, deviation, want, explained = plain([v for _, v in rows], components)
    table = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        table[(r.vec_id, r.component)] = r
    assert len(table) == len(got) == len(rows) * want.shape[1]
    for k in range(want.shape[1]):
        mine = np.array([table[(i, k + 1)].whitened for i, _ in rows])
        sign = np.sign(mine @ want[:, k])
        assert np.allclose(mine * sign, want[:, k], atol=1e-6)
        assert all(math.isclose(table[(i, k + 1)].explained, explained[k], rel_tol=1e-9) for i, _ in rows[:3])
    assert all(int(table[(i, 1)].deviation) == d for (i, _), d in zip(rows, deviation))


def test_query_equals_numpy(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(QUERIES["op12_embedding_whitening"](spark, SF).collect(), [r for r in rows if r[1] is not None], 8)


def test_odd_rows_go_and_the_rest_is_fitted(spark):
    rng = np.random.default_rng(4)
    good = [(i, (rng.standard_normal(5) * [3, 2, 1, 0.5, 0] + 40).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [math.nan, 0.0, 0.0, 0.0, 0.0]), (104, [0.0, math.inf, 0.0, 0.0, 0.0]), (105, [1e300, 0.0, 0.0, 0.0, 0.0]), (106, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").withColumns({"x": F.lit("mine"), "row": F.lit(1), "n": F.lit("old"), "at": F.lit(None).cast("int"), "whitened": F.lit(1)})
    got = w.whiten(df.repartition(5))
    assert got.columns == ["vec_id", "embedding", "x", "row", "at", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    assert {r.x for r in rows} == {"mine"} and {r.row for r in rows} == {1}
    check(rows, good, 4)  # the fifth direction has no variance


def test_repeats_ties_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    square = [(i % 3, [float(i % 2), float(i // 2 % 2)]) for i in range(8)]  # both eigenvalues are equal
    rows = w.whiten(spark.createDataFrame(square, schema)).collect()
    assert len(rows) == 16 and all(abs(abs(r.whitened) ** 2 - 1) < 1.1 for r in rows) and rows[0].identity_error < 1e-12
    assert all(abs(r.explained - 0.5) < 1e-12 for r in rows)
    one = spark.createDataFrame([(1, [1.0, 2.0])], schema)
    for table in (one, one.union(one), one.limit(0), one.where("vec_id = 2"), spark.createDataFrame([(None, None)], schema)):
        got = w.whiten(table)
        assert got.collect() == [] and got.schema["deviation"].dataType.simpleString() == "decimal(38,0)"


def test_large_entries_are_exact(spark):
    data = [(i, [float((i * 7919) % 101) * 1e9, float(i * i % 13) * 1e8 + 0.25]) for i in range(40)]
    check(w.whiten(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect(), data, 2)
