import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stratafold.operators import bayes as nb
from stratafold.operators import vector_index as vi
from stratafold.operators import voting as v
from stratafold.operators.folds import stratified_holdout, stratified_kfold
from stratafold.operators.knn import knn_classify, knn_join, knn_out_of_fold
from stratafold.plans import learners as m
from stratafold.session import kept

# --- voting ---


@pytest.fixture(scope="module")
def votes(spark):
    return spark.createDataFrame([(1, 2, 2, 3), (2, 3, 2, 1), (3, 1, 2, 2), (4, 3, 3, 3), (5, 3, 1, None), (6, None, None, None)], "id int, a int, b int, c int")


def one(df, column="prediction"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_hard_votes(votes):
    assert one(v.hard_vote(votes, ["a", "b", "c"])) == [2, 1, 2, 3, 1, None]
    assert one(v.hard_vote(votes, ["a", "b", "c"], tie="first")) == [2, 3, 2, 3, 3, None]
    assert one(v.weighted_hard_vote(votes, ["a", "b"], [0.5, 0.5])) == [2, 2, 1, 3, 1, None]
    assert one(v.weighted_hard_vote(votes, ["a", "b", "c"], [0.6, 0.2, 0.2])) == [2, 3, 1, 3, 3, None]
    assert one(v.agree_else(votes, "a", "b", "c")) == [2, 1, 2, 3, None, None]
    with pytest.raises(ValueError):
        v.hard_vote(votes, ["a"], tie="random")
    with pytest.raises(ValueError):
        v.weighted_hard_vote(votes, ["a", "b"], [0.5, 0.6])


def test_soft_votes_agree_in_both_shapes(spark):
    wide = spark.createDataFrame([(1, [0.5, 0.5], [0.4, 0.6]), (2, [0.5, 0.5], [0.5, 0.5]), (3, [0.9, 0.1], [0.0, 1.0])], "id int, m array<double>, n array<double>")
    long = wide.select("id", F.lit("m").alias("model"), F.posexplode("m").alias("class", "p")).unionByName(
        wide.select("id", F.lit("n").alias("model"), F.posexplode("n").alias("class", "p"))
    )
    for weights in (None, [0.5, 0.5], [0.9, 0.1]):
        named = weights and dict(zip("mn", weights))
        for classes in (None, [0, 1]):
            assert one(v.soft_vote(wide, ["m", "n"], [0, 1], weights)) == one(v.soft_vote_long(long, ["id"], weights=named, classes=classes))
    assert one(v.soft_vote(wide, ["m", "n"], [0, 1])) == [1, 0, 1]
    with pytest.raises(ValueError):
        v.soft_vote(wide, ["m", "n"], [0, 1], [0.6, 0.6])


def test_long_votes(spark):
    long = spark.createDataFrame([(1, 3), (1, 3), (1, 1), (2, 5), (2, 4)], "id int, prediction int")
    for classes in (None, [1, 3, 4, 5]):
        assert rows(v.top_votes(long, ["id"], classes=classes)) == [(1, 3, 2), (2, 4, 1)]
    assert rows(v.fold_vote(long, ["id"])) == [(1, 3), (2, 4)]


# --- naive Bayes ---


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    y = rng.choice([1, 2, 4], size=600, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(600, 3)) * [1, 5, 0.1] + y[:, None] * [1.0, 2.0, 0.05]
    return spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))], "id long, y int, a double, b double, c double")


COLS = ["a", "b", "c"]


def numpy_nb(train, test):
    x, y = train[:, 2:], train[:, 1]
    floor = 1e-9 * x.var(axis=0).max()
    classes = sorted(set(y))
    scores = []
    for c in classes:
        part = x[y == c]
        var = part.var(axis=0) + floor
        scores.append(np.log(len(part) / len(x)) - 0.5 * np.log(2 * np.pi * var).sum() - (0.5 * (test[:, 2:] - part.mean(axis=0)) ** 2 / var).sum(axis=1))
    return np.array(classes)[np.argmax(np.array(scores), axis=0)]


def test_naive_bayes_matches_numpy_per_fold(blobs):
    folded = stratified_kfold(blobs, ["id"], "y")
    got = {r["id"]: r["prediction"] for r in nb.nb_out_of_fold(folded, "y", COLS, [0, 1, 2], key=["id"]).collect()}
    data = np.array([tuple(r) for r in folded.select("id", "y", *COLS, "fold").collect()])
    for fold in range(3):
        train, test = data[data[:, -1] != fold][:, :-1], data[data[:, -1] == fold][:, :-1]
        want = numpy_nb(train, test)
        assert [got[int(i)] for i in test[:, 0]] == want.tolist()


def test_naive_bayes_of_all_classes_has_no_row_that_holds_them_all(spark, monkeypatch):
    """Blocks of classes give what the listed classes give; rows that repeat stay repeated."""
    monkeypatch.setattr(nb, "BLOCK_CLASSES", 8, raising=False)
    rows = [(i, i % 50, i % 3, float(i % 50 + i % 7 / 10), float(i * 37 % 11)) for i in range(600)]
    df = spark.createDataFrame(rows + rows[:5] + [(900, 3, 7, 1.0, 1.0)], "id int, y int, fold int, a double, b double")
    got = nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1, 2], key=["id"], visits="seen")
    want = nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1, 2], classes=list(range(50)))
    assert sorted(map(tuple, got.where("id < 900").select("id", "prediction").collect())) == sorted(map(tuple, want.where("id < 900").select("id", "prediction").collect()))
    assert [r.prediction for r in got.where("id = 900").collect()] == [None]  # its fold has no model
    model = nb.fit_gaussian_nb_blocks(df, "y", ["a", "b"], "fold", [0, 1, 2])
    assert sum(len(r.model) for r in model.collect()) == 150 and max(len(r.model) for r in model.collect()) < 30
    with pytest.raises(ValueError):
        nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1, 2])


def test_naive_bayes_of_all_classes_says_nothing_beside_rows_without_a_label(spark):
    rows = [(i, i % 5, i % 3, float(i % 5 + i % 7 / 10), float(i % 11)) for i in range(60)] + [(100, None, 0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, y int, fold int, a double, b double")
    got = nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1, 2], key=["id"]).collect()
    assert {r.prediction is None for r in got if r.fold} == {True}  # they train with the row
    assert {r.prediction is None for r in got if not r.fold} == {False}


def test_naive_bayes_visits_few_classes(spark):
    """Three hundred classes side by side: rows are scored against the few blocks whose bound still reaches them."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 300, i // 300 % 2, float(i % 300 + rng.standard_normal() * 0.2), float(i % 10 + rng.standard_normal() * 0.2)) for i in range(6000)]
    odd = [(9000, 5, 0, None, 1.0), (9001, 5, 0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows + odd, "id int, y int, fold int, a double, b double")
    got = {r.id: (r.prediction, r.seen) for r in nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1], key=["id"], visits="seen").collect()}
    want = {r.id: r.prediction for r in nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1], classes=list(range(300))).collect()}
    assert {i: p for i, (p, _) in got.items() if i != 9000} == {i: p for i, p in want.items() if i != 9000}
    assert got[9000][0] == 0  # no class has a score: the lowest
    assert sum(s for _, s in got.values()) < 0.3 * len(rows) * 300


def test_naive_bayes_cuts_classes_where_they_lie_apart(spark, monkeypatch):
    """Two thousand classes along one column, alike in the other: it is cut in one direction, and a row meets a few dozen classes."""
    monkeypatch.setattr(nb, "SLICE_CLASSES", 32)
    rng = np.random.default_rng(3)
    rows = [(i, i % 2000, i // 2000 % 2, float(i % 2000 + rng.standard_normal() * 0.2), float(rng.standard_normal())) for i in range(12000)]
    df = spark.createDataFrame(rows, "id int, y int, fold int, a double, b double")
    got = {r.id: (r.prediction, r.seen) for r in nb.nb_out_of_fold(df, "y", ["a", "b"], [0, 1], key=["id"], visits="seen").collect()}
    assert sum(s for _, s in got.values()) < 0.06 * len(rows) * 2000
    data = np.array(rows)
    for fold in (0, 1):
        train, test = data[data[:, 2] != fold], data[data[:, 2] == fold]
        want = numpy_nb(train[:, [0, 1, 3, 4]], test[:, [0, 1, 3, 4]])
        assert [got[int(i)][0] for i in test[:, 0]] == want.tolist()


def test_variants_from_one_pass_equal_their_own_fits(blobs):
    folded = stratified_kfold(blobs, ["id"], "y")
    variants = {"all": COLS, "first": COLS[:1], "rest": COLS[1:]}
    got = {(r.variant, r.fold): r.accuracy for r in nb.nb_variant_hits(folded, "y", variants, [1, 2, 4], [0, 1, 2]).collect()}
    for name, cols in variants.items():
        preds = nb.nb_out_of_fold(folded, "y", cols, [0, 1, 2], classes=[1, 2, 4])
        for r in preds.groupBy("fold").agg(F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("a")).collect():
            assert got[name, r.fold] == pytest.approx(r.a)
    text = nb.nb_variant_hits(folded, "y", variants, [1, 2, 4], [0, 1, 2])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan") - text.count("LocalTableScan") == 2  # one to fit, one to score


def test_naive_bayes_class_absent_from_a_fold(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0), (2, 0, 1, 0.1), (3, 1, 0, 5.0), (4, 1, 1, 5.1), (5, 7, 0, 9.0)], "id int, y int, fold int, x double")
    got = {r["id"]: r["prediction"] for r in nb.nb_out_of_fold(df, "y", ["x"], [0, 1], key=["id"]).collect()}
    assert got[5] != 7 and got[1] == 0 and got[3] == 1  # fold 0 is trained without class 7


def test_naive_bayes_ignores_unlisted_classes_and_keeps_train_only_rows(blobs):
    folded = stratified_kfold(blobs, ["id"], "y").withColumn("fold", F.when(F.col("y") != 4, F.col("fold")))
    preds = nb.nb_out_of_fold(folded, "y", COLS, [0, 1, 2], classes=[1, 2])
    assert preds.where("y = 4").count() == 0 and set(r[0] for r in preds.select("prediction").distinct().collect()) <= {1, 2}


# --- nearest neighbours ---


def brute(queries, points, k):
    out = []
    for qid, q in queries:
        near = sorted((float(np.sqrt(((q - p) ** 2).sum())), pid) for pid, p in points)[:k]
        out += [(qid, pid, i + 1) for i, (_, pid) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"max_point_bytes": 0, "block_rows": 40, "pivots": 6}, {"max_point_bytes": 0, "block_rows": 1000, "pivots": 1}])
@pytest.mark.parametrize("k", [1, 7])
def test_knn_matches_brute_force(spark, options, k):
    rng = np.random.default_rng(11)
    p = np.round(rng.normal(size=(300, 3)), 1)
    p[:120] = p[0]  # a third of the points and more are one vector
    q = np.vstack([np.round(rng.normal(size=(60, 3)), 1), p[0], p[0]])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "pid long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "qid long, v array<double>").repartition(3)
    got = rows(knn_join(queries, points, k, "v", ["qid"], "pid", **options), "qid", "pid", "rank")
    assert sorted(got) == brute(list(enumerate(q)), list(enumerate(p)), k)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_knn_fewer_points_than_k(spark, limit):
    points = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "pid int, v array<double>")
    queries = spark.createDataFrame([(1, [1.0]), (2, None)], "qid int, v array<double>")
    assert rows(knn_join(queries, points, 5, "v", ["qid"], "pid", max_point_bytes=limit), "qid", "pid", "distance") == [(1, 1, 1.0), (1, 2, 2.0)]


def test_knn_votes_go_to_the_lowest_label_on_ties(spark):
    points = spark.createDataFrame([(1, [0.0], 9), (2, [0.1], 4), (3, [50.0], 4)], "pid int, v array<double>, y int")
    queries = spark.createDataFrame([(1, [0.0])], "qid int, v array<double>")
    assert rows(knn_classify(queries, points, 2, "v", ["qid"], "pid", "y")) == [(1, 4)]


def test_knn_out_of_fold_never_sees_its_own_fold(spark):
    df = spark.createDataFrame([(1, [0.0], 1, 0), (2, [0.0], 1, 0), (3, [9.0], 2, 1), (4, [9.0], 2, 1)], "id int, v array<double>, y int, fold int")
    assert rows(knn_out_of_fold(df, 1, "v", "id", "y", [0, 1]), "id", "prediction") == [(1, 2), (2, 2), (3, 1), (4, 1)]


# --- learners ---


@pytest.fixture(scope="module")
def taught(spark):
    """Three classes that follow from two columns, a few rows flipped."""
    x, z = F.rand(1) * 10, F.rand(2) * 10
    df = spark.range(3000, numPartitions=4).select("id", x.alias("x"), z.alias("z"))
    y = F.when(F.col("id") % 23 == 0, 3).when((F.col("x") > 6) & (F.col("z") > 4), 3).when(F.col("x") > 3, 2).otherwise(1)
    return stratified_kfold(df.withColumn("y", y), ["id"], "y").cache()


CLASSES = [1, 2, 3]
XZ = ["x", "z"]


def scores(df, learner):
    return {r["fold"]: r["accuracy"] for r in m.cross_validate(df, learner, "y", [0, 1, 2]).collect()}


@pytest.mark.parametrize(
    "learner",
    [
        m.forest(XZ, "y", CLASSES, trees=5, depth=5),
        m.boosted(XZ, "y", CLASSES, rounds=3, rate=0.5, depth=3),
        m.logistic(XZ, "y", CLASSES, maxIter=10),
        m.gaussian_nb(XZ, "y", CLASSES),
        m.vote([m.gaussian_nb(XZ, "y", CLASSES), m.forest(XZ, "y", CLASSES, trees=3, depth=4)], CLASSES, weights=[0.3, 0.7]),
    ],
    ids=["forest", "boosted", "logistic", "bayes", "vote"],
)
def test_learners_beat_the_majority_share(taught, learner):
    got = scores(taught, learner)
    share = max(r["count"] for r in taught.groupBy("y").count().collect()) / 3000
    assert len(got) == 3 and all(a > share + 0.1 for a in got.values())


def test_probabilities_sum_to_one_and_rows_stay_whole(taught):
    learner = m.vote([m.boosted(XZ, "y", CLASSES, rounds=2, depth=2), m.forest(XZ, "y", CLASSES, trees=2, depth=3)], CLASSES, how="hard", tie="first")
    preds = learner(taught)(taught)
    assert preds.count() == 3000 and set(taught.columns) <= set(preds.columns)
    total = preds.select(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("t"))
    assert total.where(F.abs(F.col("t") - 1) > 1e-9).count() == 0


def test_same_seed_same_rows(taught):
    fit = m.forest(XZ, "y", CLASSES, trees=3, depth=4, seed=9)
    assert rows(fit(taught)(taught), "id", "prediction") == rows(fit(taught)(taught), "id", "prediction")


def test_early_stop_trains_on_the_other_rows_only(taught):
    parts = stratified_holdout(taught.drop("fold"), ["id"], "y").withColumn("val", F.col("part") == "test")
    preds = m.boosted(XZ, "y", CLASSES, rounds=4, depth=3, validation="val")(parts)(parts.where("val"))
    assert preds.where("prediction = y").count() / preds.count() > 0.8


def test_learner_without_the_last_class(taught):
    """A training fold that lacks the highest class still gives probabilities for all classes."""
    few = taught.where("y < 3")
    preds = m.forest(XZ, "y", CLASSES, trees=2, depth=3)(few)(taught)
    assert preds.select(F.size("probability")).distinct().collect()[0][0] == 3
    assert preds.where("prediction = 3").count() == 0


def test_seed_ensemble_and_final_fit(taught):
    learner = m.seed_ensemble(lambda s: m.forest(XZ, "y", CLASSES, trees=2, depth=3, seed=s), [1, 2], CLASSES)
    out = m.fit_and_score(taught.where("fold > 0"), taught.where("fold = 0").drop("y"), learner, ["id"], "y")
    assert out.columns == ["id", "y"] and out.count() == taught.where("fold = 0").count()


def test_repeated_validation(taught):
    def fold_of(df, seed):
        return stratified_kfold(df, ["id"], "y", seed=seed)

    got = m.repeated_cross_validate(taught.drop("fold"), lambda s: m.gaussian_nb(XZ, "y", CLASSES), "y", [42, 43], [0, 1, 2], fold_of)
    assert rows(got, "run", "fold") == [(r, f) for r in (0, 1) for f in (0, 1, 2)]


def test_grid_search(taught):
    some = taught.withColumn("fold", F.when(F.col("id") % 10 > 0, F.col("fold")))  # the others train in every fold
    found = m.grid_search(some, lambda depth: m.forest(XZ, "y", CLASSES, trees=3, depth=depth, seed=1), [{"depth": 1}, {"depth": 4}], "y", [0, 1, 2])
    got = {r["params"]: r["mean_test_score"] for r in found.collect()}
    assert got["depth=4"] > got["depth=1"]


def test_unlisted_and_missing_labels_do_not_train(taught):
    odd = taught.withColumn("y", F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 9 == 1, 77).otherwise(F.col("y")).cast("int"))
    for learner in (m.forest(XZ, "y", CLASSES, trees=2, depth=2), m.gaussian_nb(XZ, "y", CLASSES), m.logistic(XZ, "y", CLASSES, maxIter=2)):
        assert {r[0] for r in learner(odd)(odd).select("prediction").distinct().collect()} <= set(CLASSES)


@pytest.mark.parametrize(("losses", "patience", "kept"), [([3, 2, 1], 2, 3), ([3, 1, 2, 2, 0], 2, 2), ([3, 1, 2, 2, 0], 3, 5), ([1, 1, 1], 1, 1), ([5, 4, 4.5, 3, 4, 5], 2, 4)])
def test_patience(losses, patience, kept):
    assert m.patient_rounds(losses, patience) == kept


def test_preprocessing_is_fitted_on_training_rows_alone(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 10.0), (1, 20.0), (None, 100.0)], "fold int, x double")

    def seen(cols):
        def fit(train):
            (c,) = cols
            low, high = train.agg(F.min(c), F.max(c)).first()
            return lambda rows: rows.withColumns({"low": F.lit(low), "high": F.lit(high), "own": F.col(c)})

        return fit

    got = rows(m.out_of_fold(df, m.preprocessed(seen, ["x"], how="minmax"), [0, 1]), "fold", "x", "low", "high", "own")
    assert got == [(0, 1.0, 0.0, 1.0, -0.1), (0, 2.0, 0.0, 1.0, pytest.approx(-8 / 90)), (1, 10.0, 0.0, 1.0, pytest.approx(9 / 99)), (1, 20.0, 0.0, 1.0, pytest.approx(19 / 99))]


def test_facts_of_the_learner_queries_notice_broken_learners(spark):
    from checks.learn import _facts, _hard_vote_differs, _soft_vote_differs

    good = [(t, [0.1, 0.2, 0.7], 3, [0.0, 0.3, 0.7], [0.2, 0.1, 0.7], 3, 3) for t in (1, 2, 3, 3, 3, 3)]
    schema = "target int, probability array<double>, prediction int, _prob0 array<double>, _prob1 array<double>, _vote0 int, _vote1 int"
    extra = {"off_soft": _soft_vote_differs(2), "off_hard": _hard_vote_differs(2)}
    judge = lambda data: _facts(spark.createDataFrame(data, schema), by=(), extra=extra).first()
    fine = judge(good)
    assert (fine.n_1, fine.n_2, fine.n_3, fine.off_sums, fine.off_labels, fine.off_soft, fine.off_hard) == (1, 1, 4, 0, 0, 0, 0) and not fine.learns
    assert judge([(*r[:1], [0.1, 0.1, 0.7], *r[2:]) for r in good]).off_sums == 6
    wrong = judge([(*r[:2], 1, *r[3:]) for r in good])
    assert (wrong.off_labels, wrong.off_soft, wrong.off_hard) == (6, 6, 6)


# --- inverted index of vectors ---


def test_index_with_all_probes_is_exact_and_few_probes_find_most(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8)) * 6
    vectors = [(i, (centres[i % 12] + rng.standard_normal(8)).tolist()) for i in range(900)] + [(5_000 + i, [0.0] * 8) for i in range(30)] + [(6_000, None)]
    points = spark.createDataFrame(vectors, "id long, vec array<double>").repartition(3)
    queries = points.where("id % 9 = 0").select(F.col("id").alias("q"), "vec")
    exact = knn_join(queries, points, 5, "vec", ["q"], "id").select("q", "id", "rank")
    index = vi.build_index(points, "id", "vec", centres=24)
    whole = vi.search_index(index, queries, ["q"], 5, probes=24, block_rows=50).select("q", "id", "rank")
    assert rows(whole) == rows(exact)
    near = {(r.q, r.id) for r in vi.search_index(index, queries, ["q"], 5, probes=4).collect()}
    want = {(r.q, r.id) for r in exact.collect()}
    assert len(near & want) >= 0.9 * len(want) and vi.visited_share(index, queries, probes=4) < 0.4
    none = vi.build_index(points.limit(0), "id", "vec")
    assert vi.search_index(none, queries, ["q"], 5).collect() == [] and vi.search_index(index, queries.limit(0), ["q"], 5).collect() == []


def test_scores_of_listed_classes_are_compiled(spark):
    """No function of arrays runs over the classes for each row; a class without training rows scores -inf."""
    df = spark.createDataFrame([(i, i % 3, float(i % 7), "ab"[i % 2]) for i in range(60)], "id long, fold int, x double, label string")
    model = nb.fit_gaussian_nb(df, "label", ["x"], ["a", "b"], "fold", [0, 1, 2])
    scored = nb.predict_gaussian_nb(df, model, ["x"], ["z", "b", "a"], "fold").withColumn("probability", nb.nb_probabilities(n=3))
    assert "transform(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    plain = nb.predict_gaussian_nb(df, model, ["x"], fold="fold").withColumn("probability", nb.nb_probabilities())
    want = {r.id: (r.scores, r.probability, r.prediction) for r in plain.collect()}
    for r in scored.collect():
        scores, chances, best = want[r.id]
        assert r.scores == [float("-inf"), scores[1], scores[0]] and r.prediction == best
        assert r.probability == pytest.approx([0.0, chances[1], chances[0]], abs=1e-15)


def test_kept_tables_are_read_by_many_tasks(spark):
    held = kept(spark.range(0, 5_000, 1, 1), "kept", 1_000)
    assert len(held.inputFiles()) == 5 and held.count() == 5_000


def test_long_vote_finds_few_classes_and_shuffles_once(spark):
    from stratafold.operators import voting

    data = [(k, m, c, None if (k, c) == (3, "b") else float((k * 7 + i * 5 + j * 3) % 11)) for k in range(40) for i, m in enumerate(["m1", "m2"]) for j, c in enumerate(["a", "b", None]) if (k + j) % 5]
    probs = spark.createDataFrame(data, "k int, model string, class string, p double")
    got = voting.soft_vote_long(probs, ["k"], weights={"m1": 0.6, "m2": 0.4})
    plain = probs.withColumn("w", F.when(F.col("model") == "m1", 0.6).otherwise(0.4) * F.col("p")).groupBy("k", "class").agg(F.sum("w").alias("p"))
    assert rows(got, "k", "prediction") == rows(voting.argmax_class(plain, ["k"]), "k", "prediction")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_search_leaves_a_task_in_small_batches(spark, monkeypatch):
    from stratafold.operators import knn

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["x"])
    monkeypatch.setattr(knn, "GAP_VALUES", 5_000)
    made = [b.num_rows for b in knn._slices([batch, batch.slice(0, 0)], 50)]
    assert made == [100] * 10


def test_models_of_folds_are_broadcast_and_rows_stay(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 7), "ab"[i % 2]) for i in range(60)], "id long, fold int, x double, label string")
    plan = nb.nb_out_of_fold(df, "label", ["x"], [0, 1, 2], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
