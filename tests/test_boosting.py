"""Joint softmax boosting against a plain version that recounts every node from its rows, one node at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratafold.plans import boosting as b

EDGES = [[0.5, 1.5, 2.5, 3.5], [10.0, 20.0, 30.0], [0.0]]
COLS = ["u", "v", "w"]


def rows_at_random(n, seed=1):
    rng = np.random.default_rng(seed)
    u, v, w = rng.integers(0, 5, n).astype(float), rng.uniform(0, 40, n), rng.standard_normal(n)
    y = (u > 2).astype(int) + ((v > 20) & (w > 0)).astype(int)
    y = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y)
    u[rng.random(n) < 0.05] = math.nan
    return [(i, *(None if math.isnan(x) else float(x) for x in r), "abc"[c]) for i, (*r, c) in enumerate(zip(u, v, w, y))]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, u double, v double, w double, label string")


def plain_bins(rows):
    return np.array([[0 if x is None else 1 + sum(x > e for e in edges) for x, edges in zip(r[1:4], EDGES)] for r in rows])


def plain_tree(bins, g, h, leaves, min_leaf, l2, rate, depth=None):
    """Best leaf first; every split found by trying all bins of all columns on the rows of the node."""
    nodes = [np.arange(len(bins))]
    splits, level, best = {}, [0], {}

    def strength(rows):
        gs, hs = g[rows].sum() / b.UNIT, h[rows].sum() / b.UNIT
        return gs * gs / (hs + l2)

    def search(node):
        rows, found = nodes[node], None
        if depth is not None and level[node] >= depth:
            return None
        for f in range(bins.shape[1]):
            for cut in sorted(set(bins[rows, f].tolist())):
                left, right = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                if min(len(left), len(right)) >= min_leaf:
                    gain = 0.5 * (strength(left) + strength(right) - strength(rows))
                    if gain > 0 and (found is None or gain > found[0] + 1e-12):
                        found = (gain, f, cut, left, right)
        return found

    best[0] = search(0)
    while len(splits) + 1 < leaves:
        open_ = [n for n, found in best.items() if found and n not in splits]
        if not open_:
            break
        node = max(open_, key=lambda n: (best[n][0], -n))
        _, f, cut, left, right = best[node]
        splits[node] = (f, cut, len(nodes))
        for part in (left, right):
            nodes.append(part)
            level.append(level[node] + 1)
            best[len(nodes) - 1] = search(len(nodes) - 1)
    tree = b.Tree()
    place = {0: 0}
    for node in splits:
        f, cut, child = splits[node]
        at = tree.split(place[node], f, cut)
        place[child], place[child + 1] = at, at + 1
    for node, at in place.items():
        if not tree.left[at]:
            tree.value[at] = -rate * g[nodes[node]].sum() / (h[nodes[node]].sum() + l2 * b.UNIT)
    return tree


def plain_fit(rows, classes, rounds, rate=0.3, leaves=6, min_leaf=5, l2=1.0, weights=None, depth=None):
    bins, y = plain_bins(rows), np.array([classes.index(r[4]) for r in rows])
    w = np.ones(len(rows)) if weights is None else np.array(weights)
    scores, out = np.zeros((len(rows), len(classes))), []
    for _ in range(rounds):
        p = b.softmax(scores)
        trees = []
        for k in range(len(classes)):
            g, h = (np.rint(x * w * b.UNIT).astype(np.int64) for x in (p[:, k] - (y == k), p[:, k] * (1 - p[:, k])))
            trees.append(plain_tree(bins, g, h, leaves, min_leaf, l2, rate, depth))
        out.append(trees)
        scores = b.added(scores, [trees], bins.astype(np.uint8))
    return out


def same(got, want):
    for mine, theirs in zip(got, want, strict=True):
        for x, y in zip(mine, theirs, strict=True):
            assert (x.feature, x.cut, x.left) == (y.feature, y.cut, y.left)
            assert np.allclose(x.value, y.value, rtol=1e-12)


def test_trees_equal_the_plain_version(spark):
    rows = rows_at_random(400)
    predict = b.softmax_boosted(COLS, "label", ["a", "b", "c"], rounds=7, rate=0.3, leaves=6, min_leaf=5, edges=EDGES)(table(spark, rows).repartition(3))
    same(predict.model.rounds, plain_fit(rows, ["a", "b", "c"], 7))
    scored = predict(table(spark, rows).withColumn("probability", F.lit("old"))).collect()
    chance = b.softmax(predict.model.scores(plain_bins(rows).astype(np.uint8)))
    by_id = {r.id: r for r in scored}
    assert all(np.allclose(by_id[i].probability, chance[i]) and by_id[i].prediction == "abc"[chance[i].argmax()] for i in range(len(rows)))


def test_depth_weights_and_partitions(spark):
    rows = rows_at_random(300, seed=2)
    weights = [1.0 + (r[4] == "c") for r in rows]
    df = table(spark, rows).withColumn("weigh", F.when(F.col("label") == "c", 2.0).otherwise(1.0))
    fits = [b.softmax_boosted(COLS, "label", ["a", "b", "c"], rounds=2, rate=0.3, leaves=8, depth=2, min_leaf=5, edges=EDGES, weight="weigh")(df.repartition(n)) for n in (1, 5)]
    same(fits[0].model.rounds, plain_fit(rows, ["a", "b", "c"], 2, leaves=8, depth=2, weights=weights))
    same(fits[1].model.rounds, fits[0].model.rounds)
    assert max(len(t.left) for r in fits[0].model.rounds for t in r) <= 7


def test_patience_keeps_the_best_round_without_a_second_fit(spark):
    rows = rows_at_random(260, seed=3)
    train, valid = rows[:120], rows[120:]
    fit = b.softmax_boosted(COLS, "label", ["a", "b", "c"], rounds=40, rate=0.8, leaves=8, min_leaf=2, edges=EDGES, patience=2)
    predict = fit(table(spark, train), table(spark, [*valid, (999, 1.0, 1.0, 1.0, "never seen"), (1000, 1.0, 1.0, 1.0, None)]))
    trees = plain_fit(train, ["a", "b", "c"], len(predict.losses), rate=0.8, leaves=8, min_leaf=2)
    bins, y = plain_bins(valid).astype(np.uint8), np.array(["abc".index(r[4]) for r in valid])
    scores = [b.added(np.zeros((len(valid), 3)), trees[:n], bins) for n in range(len(predict.losses))]
    losses = [-np.log(b.softmax(s)[np.arange(len(y)), y]).mean() for s in scores]
    assert np.allclose(predict.losses, losses, atol=1e-6)
    best = int(np.argmin(losses))
    assert 0 < best < 40 and len(predict.model.rounds) == best and len(losses) == best + 3
    same(predict.model.rounds, trees[:best])


def test_one_aggregation_for_all_trees_and_nodes_of_a_pass(spark):
    rows = rows_at_random(300, seed=4)
    predict = b.softmax_boosted(COLS, "label", ["a", "b", "c"], rounds=2, leaves=8, min_leaf=5, edges=EDGES)(table(spark, rows))
    splits = sum(l > 0 for r in predict.model.rounds for t in r for l in t.left)
    assert predict.passes < splits / 2  # far fewer passes than nodes
    model = b.SoftmaxModel(COLS, ["a", "b", "c"], EDGES, [])
    booster = b.SoftmaxBooster(model, "", 0.1, 8, None, 1.0, 1.0, 5, 0.0, 1.0, 1)
    booster.rows = spark.createDataFrame([], b._STATE)
    growing = [b._Growing(8, None, 5) for _ in range(3)]
    plan = booster.count(growing, [(k, 0) for k in range(3)], [[0, 1, 2]] * 3, False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1


def test_samples_of_rows_and_columns(spark):
    rows = rows_at_random(600, seed=5)
    make = lambda seed: b.softmax_boosted(COLS, "label", ["a", "b", "c"], rounds=3, features=0.4, subsample=0.5, edges=EDGES, seed=seed, key=["id"])(table(spark, rows))
    one, again, other = make(1), make(1), make(2)
    same(one.model.rounds, again.model.rounds)
    assert any(x.feature != y.feature or x.value != y.value for r, s in zip(one.model.rounds, other.model.rounds) for x, y in zip(r, s))
    for trees in one.model.rounds:
        assert all(len({f for f, left in zip(t.feature, t.left) if left}) <= 1 for t in trees)
    drawn = b._drawn(np.arange(20_000), 1, 0)
    assert abs((drawn < 0.3).mean() - 0.3) < 0.02 and abs(np.corrcoef(drawn, b._drawn(np.arange(20_000), 1, 1))[0, 1]) < 0.05


def test_quantile_bins_and_small_tables(spark):
    rows = rows_at_random(500, seed=6)
    df = table(spark, rows)
    edges = b.bin_edges(df, COLS, 16)
    assert all(len(e) <= 15 and e == sorted(set(e)) for e in edges) and edges[0] == [0.0, 1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        b.bin_edges(df, COLS, 256)
    fit = b.softmax_boosted(COLS, "label", ["a", "b", "c"], rounds=2, bins=8)
    predict = fit(df)
    assert predict(df.limit(0)).collect() == []
    right = [r.prediction == r.label for r in predict(df).collect()]
    assert sum(right) / len(right) > 0.7
    few = fit(df.limit(3))  # nothing can be split: each class's share alone
    assert all(t.left == [0] for r in few.model.rounds for t in r)
    none = fit(df.limit(0))(df.limit(2)).collect()
    assert all(np.allclose(r.probability, 1 / 3) for r in none)


def test_equal_rows_are_kept_once_with_their_number(spark, monkeypatch):
    base = rows_at_random(60)
    many = [(i, *base[i % 60][1:]) for i in range(1_200)]
    counted = {}
    real_round = b.SoftmaxBooster.round

    def spied(self):
        counted.update(rows=self.rows.count(), n=self.rows.agg(F.sum("n")).first()[0])
        return real_round(self)

    monkeypatch.setattr(b.SoftmaxBooster, "round", spied)
    fit = b.softmax_boosted(COLS, "label", list("abc"), rounds=2, rate=0.3, leaves=4, min_leaf=20, edges=EDGES, key=["id"])
    got = fit(table(spark, many), table(spark, base))
    assert counted["n"] == 1_260 and counted["rows"] <= 120
    monkeypatch.undo()
    single = b.softmax_boosted(COLS, "label", list("abc"), rounds=2, rate=0.3, leaves=4, min_leaf=20, edges=EDGES, key=["id"], subsample=1 - 1e-15)
    rest = single(table(spark, many), table(spark, base))  # a share just below one: every row on its own
    assert got.losses == rest.losses and got.model.rounds == rest.model.rounds
    big = np.array([1 << 52, 1 << 52, 3], dtype=np.int64)
    assert b._whole_sums(np.array([0, 0, 0]), big, 2).tolist() == [(1 << 53) + 3, 0]


def test_drawn_rows_are_read_as_cells(spark, monkeypatch):
    """A round's passes read a row for each cell, not for each table row; rounds beyond a block are drawn anew."""
    monkeypatch.setattr(b, "_DRAWS", 2)
    seen = []
    real = b.SoftmaxBooster.round

    def spied(self):
        seen.append((self.rows.count(), self.rows.groupBy().agg(F.sum("n")).first()[0]))
        return real(self)

    monkeypatch.setattr(b.SoftmaxBooster, "round", spied)
    df = spark.range(4_000).select("id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 > 4, "b").otherwise("a").alias("label"))
    fit = b.softmax_boosted(["x"], "label", ["a", "b"], rounds=3, rate=0.5, leaves=3, subsample=0.7, key=["id"])
    scored = fit(df)(df)
    assert len(seen) == 3 and all(c <= 20 and n == 4_000 for c, n in seen)
    assert scored.where("prediction = label").count() == 4_000
