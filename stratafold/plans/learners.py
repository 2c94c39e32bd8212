"""Distributed learners behind one protocol, and cross-validation over it.

A learner is a function ``fit(train) -> predict``; ``predict(df)`` adds ``probability`` (an array over
the classes, in their order) and ``prediction`` (a class label). Everything else about a row travels
along, so no join by position or key is needed after scoring.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce
from multiprocessing.pool import ThreadPool
from weakref import WeakKeyDictionary

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalar import argmax, decode, mix
from ..operators.aggregates import accuracy, cv_score
from ..operators.bayes import fit_gaussian_nb, nb_probabilities, predict_gaussian_nb
from ..operators.folds import balanced_weights
from ..operators.keyed import train_of, valid_of
from ..operators.scaling import apply_minmax, apply_standard, fit_stats
from ..operators.voting import check_weights, hard_vote
from ..session import kept as kept_table, scratch_folder, stored
from .cells import MAX_BINS, TIMES, VECTOR, Cells, bootstrapped, sampled

Predictor = Callable[[DataFrame], DataFrame]
Learner = Callable[[DataFrame], Predictor]

_VEC, _IDX, _PROB = VECTOR, "_index", "_probability"
_TREES_AT_ONCE = 4  # trees of a forest that are fitted side by side
_COLUMNS = dict(featuresCol=_VEC, labelCol=_IDX, probabilityCol=_PROB, rawPredictionCol="_raw", predictionCol="_pred")


def _each(items: list, fn: Callable, parallelism: int) -> list:
    """Run independent fits side by side: one fit alone rarely fills a cluster."""
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(fn), items)


def _index(label: str, classes: list) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("double") - 1


def _prepare(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=_VEC, handleInvalid="keep").transform(df)


def _finish(df: DataFrame, probability: Column, classes: list) -> DataFrame:
    kept = [c for c in df.columns if c not in (_VEC, _IDX, _PROB, "probability", "prediction")]
    return df.select(*kept, probability.alias("probability")).withColumn("prediction", decode(argmax("probability"), classes))


def _listed(train: DataFrame, label: str, classes: list) -> DataFrame:
    """Rows of other classes, and without a label, do not train."""
    return train.where(F.col(label).isin(list(classes)))


def _from_estimator(make: Callable[[], Estimator], cols: list[str], label: str, classes: list) -> Learner:
    """The estimator is made anew for each fit, so that fits can run side by side."""

    def fit(train: DataFrame) -> Predictor:
        model = make().fit(_prepare(_listed(train, label, classes), cols).withColumn(_IDX, _index(label, classes)))
        n = getattr(model, "numClasses", len(classes))

        def predict(df: DataFrame) -> DataFrame:
            scored = model.transform(_prepare(df, cols))
            p = vector_to_array(F.col(_PROB))
            # a learner only knows classes up to the largest index it saw
            slots = F.array(*[p[i] if i < n else F.lit(0.0) for i in range(len(classes))])
            return _finish(scored, slots, classes)

        return predict

    return fit


_COUNTED: WeakKeyDictionary = WeakKeyDictionary()  # cells of a training table, which forests of several seeds share


def _counted(train: DataFrame, cols: list[str], label: str, classes: list, weight: str | None) -> tuple[Cells, DataFrame]:
    made, of = _COUNTED.setdefault(train, {}), (tuple(cols), label, tuple(classes), weight)
    if of not in made:
        rows = _listed(train, label, classes)
        cells = Cells(rows, cols)
        by = [_IDX, *([weight] if weight else [])]
        made[of] = cells, kept_table(cells.collapsed(rows.withColumn(_IDX, _index(label, classes)), by), "cells")
    return made[of]


def forest(
    cols: list[str],
    label: str,
    classes: list,
    trees: int = 100,
    depth: int = 10,
    features: str = "sqrt",
    min_leaf: int = 1,
    weight: str | None = None,
    seed: int = 42,
) -> Learner:
    """Random forest. Depth is capped at 30 by Spark; ``weight`` names a weight column for balanced classes.

    Equal rows in bins are one row with their number (see ``cells``). Each tree is a fit of its own on its own draw with replacement; the forest's
    probabilities are the mean of the trees'. A cell of more rows than ``min_leaf`` is so many rows for the fit, which counts rows in leaves.
    """

    def fit(train: DataFrame) -> Predictor:
        cells, counted = _counted(train, cols, label, classes, weight)
        with scratch_folder(train.sparkSession, "forest") as folder:
            drawn = stored(counted.withColumn("_drawn", bootstrapped(seed, trees)), folder)

            def fit_tree(t: int):
                n = F.col("_drawn")[t]
                mass = n * (F.col(weight) if weight else F.lit(1.0))
                parts = F.least(n, F.lit(min_leaf))
                sample = drawn.where(n > 0).select(_VEC, _IDX, (mass / parts).alias("_mass"), parts.alias("_parts"))
                if min_leaf > 1:
                    sample = sample.withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts").cast("int"))))
                params = dict(numTrees=1, bootstrap=False, maxDepth=depth, featureSubsetStrategy=features, minInstancesPerNode=min_leaf, maxBins=MAX_BINS, seed=seed + t)
                model = RandomForestClassifier(featuresCol=_VEC, labelCol=_IDX, weightCol="_mass", **params).fit(sample)
                return model.setProbabilityCol(f"_tree{t}").setRawPredictionCol("").setPredictionCol("")

            models = _each(list(range(trees)), fit_tree, _TREES_AT_ONCE)

        def predict(df: DataFrame) -> DataFrame:
            scored = cells.placed(df)
            for model in models:
                scored = model.transform(scored)
            # a tree only knows classes up to the largest index it saw
            known = [[vector_to_array(F.col(f"_tree{t}"))[i] for t, model in enumerate(models) if i < model.numClasses] for i in range(len(classes))]
            slots = F.array(*[sum(p[1:], p[0]) / len(models) if p else F.lit(0.0) for p in known])
            return _finish(scored.drop("probability", "prediction"), slots, classes).drop(*[f"_tree{t}" for t in range(len(models))])

        return predict

    return fit


def logistic(cols: list[str], label: str, classes: list, **params) -> Learner:
    """Multinomial logistic regression."""
    make = partial(LogisticRegression, family="multinomial", **_COLUMNS, **params)
    return _dropping(_from_estimator(make, cols, label, classes), "_raw", "_pred")


def _dropping(learner: Learner, *cols: str) -> Learner:
    def fit(train: DataFrame) -> Predictor:
        predict = learner(train)
        return lambda df: predict(df).drop(*cols)

    return fit


def _one_vs_rest(models: list, cells: Cells, classes: list) -> Predictor:
    """Probabilities of one binary model per class, normalised to sum to one. A model is one of Spark's, or the sum of ``_Rounds``."""

    def predict(df: DataFrame) -> DataFrame:
        scored = cells.placed(df)
        own = [f"_p{i}" for i in range(len(models))]
        for name, model in zip(own, models):
            if isinstance(model, _Rounds):
                scored = model.scored(scored, name)
            else:
                scored = model.transform(scored).withColumn(name, vector_to_array(F.col(_PROB))[1]).drop(_PROB, "_raw", "_pred")
        total = reduce(lambda a, b: a + b, [F.col(c) for c in own])
        return _finish(scored, F.array(*[F.try_divide(F.col(c), total) for c in own]), classes).drop(*own)

    return predict


class _Rounds:
    """A binary boosted model on the log loss, whose rounds train on samples of the rows: the rounds of Spark's ``GBTClassifier``,
    one regression tree each, with as many rows of a cell as are drawn."""

    def __init__(self, rate: float, subsample: float, seed: int, **params) -> None:
        self.rate, self.subsample, self.seed, self.params = rate, subsample, seed, params
        self.trees: list = []

    def _added(self, df: DataFrame, first: int, out: str) -> DataFrame:
        """``out`` and the trees from number ``first`` on; the first one counts whole."""
        for t, tree in enumerate(self.trees[first:], first):
            df = tree.transform(df).withColumn(out, F.col(out) + F.lit(self.rate if t else 1.0) * F.col("_step")).drop("_step")
        return df

    def scored(self, df: DataFrame, out: str) -> DataFrame:
        margin = self._added(df.withColumn(out, F.lit(0.0)), 0, out)
        return margin.withColumn(out, 1.0 / (1.0 + F.exp(-2.0 * F.col(out))))

    def fit(self, rows: DataFrame, mine: Column, rounds: int, folder: str, judge: DataFrame | None = None, tolerance: float = 0.0) -> _Rounds:
        """Rounds on the cells ``rows``; with the cells ``judge`` up to the best before one that gains less than ``tolerance``."""
        sign = F.when(mine, 1.0).otherwise(-1.0)
        state, best, kept = rows.withColumns({"_sign": sign, "_margin": F.lit(0.0)}), math.inf, rounds
        judged = None if judge is None else judge.withColumns({"_sign": sign, "_margin": F.lit(0.0)})
        loss = (F.sum(F.col(TIMES) * 2.0 * _log1p_exp(-2.0 * F.col("_sign") * F.col("_margin"))) / F.sum(TIMES)).alias("loss")
        for number in range(rounds):
            slope = 4.0 * F.col("_sign") / (1.0 + F.exp(2.0 * F.col("_sign") * F.col("_margin"))) if number else F.col("_sign")
            sample = state.select(_VEC, slope.alias("_slope"), sampled(self.seed + number, self.subsample).cast("double").alias("_mass")).where("_mass > 0")
            tree = RandomForestRegressor(numTrees=1, bootstrap=False, featuresCol=_VEC, labelCol="_slope", predictionCol="_step", weightCol="_mass", seed=self.seed + number, maxBins=MAX_BINS, **self.params)
            self.trees.append(tree.fit(sample))
            state = stored(self._added(state, number, "_margin"), f"{folder}/rows-{number}")
            if judged is not None:
                judged = stored(self._added(judged, number, "_margin"), f"{folder}/judged-{number}")
                now = judged.agg(loss).first()["loss"]
                if now is None:
                    continue
                if number and best - now < tolerance * max(now, 0.01):
                    break
                if now < best:
                    best, kept = now, number + 1
        del self.trees[kept:]
        return self


def _log1p_exp(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def boosted(
    cols: list[str],
    label: str,
    classes: list,
    rounds: int = 100,
    rate: float = 0.1,
    subsample: float = 1.0,
    depth: int = 5,
    features: str = "all",
    min_gain: float = 0.0,
    validation: str | None = None,
    tolerance: float = 0.01,
    seed: int = 42,
    parallelism: int = 4,
) -> Learner:
    """Boosted trees, one binary model per class, their probabilities normalised to sum to one.

    ``validation`` names a boolean column: the rows it marks are not trained on, and rounds stop once
    the loss on them improves by less than ``tolerance`` (relative). Equal rows in bins are one row with their number (see ``cells``); the rows
    of a round's ``subsample`` are drawn from the numbers.
    """

    def fit(train: DataFrame) -> Predictor:
        listed = _listed(train, label, classes)
        own = [validation] if validation else []
        cells = Cells(listed.where(~F.col(validation)) if validation else listed, cols)
        params = dict(maxDepth=depth, featureSubsetStrategy=features, minInfoGain=min_gain)
        with scratch_folder(train.sparkSession, "boosted") as folder:
            rows = stored(cells.collapsed(listed, [label, *own]), f"{folder}/cells")

            def fit_class(i: int):
                mine = F.col(label) == F.lit(classes[i])
                if subsample < 1.0:
                    trains, judges = (rows.where(~F.col(validation)), rows.where(validation)) if validation else (rows, None)
                    return _Rounds(rate, subsample, seed, **params).fit(trains, mine, rounds, f"{folder}/{i}", judges, tolerance)
                stops = dict(validationIndicatorCol=validation, validationTol=tolerance) if validation else {}
                return _binary(maxIter=rounds, stepSize=rate, seed=seed, **params, **stops).fit(rows.withColumn(_IDX, mine.cast("double")))

            models = _each(list(range(len(classes))), fit_class, parallelism)

        return _one_vs_rest(models, cells, classes)

    return fit


def _binary(**params) -> GBTClassifier:
    """On cells: rows weigh their number."""
    estimator = GBTClassifier(featuresCol=_VEC, labelCol=_IDX, predictionCol="_pred", weightCol=TIMES, maxBins=MAX_BINS, **params)
    return estimator.setProbabilityCol(_PROB).setRawPredictionCol("_raw")


def patient_rounds(losses: list[float], patience: int) -> int:
    """Rounds to keep: up to the lowest loss before ``patience`` rounds in a row have brought no lower one."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def boosted_to_fold(
    cols: list[str], label: str, classes: list, rounds: int = 100, patience: int = 10, rate: float = 0.1, depth: int = 5, seed: int = 42, parallelism: int = 4
) -> Callable[[DataFrame, DataFrame], Predictor]:
    """Boosted trees that stop on given validation rows: ``fit(train, valid)``, for ``out_of_fold(..., stops=True)``.

    Each class's model is scored on the validation rows after every round, and keeps the best round before
    ``patience`` rounds without gain. The kept rounds are fitted again: with the same seed they are the same trees.
    ``predict.rounds`` says how many each class kept.
    """

    def fit(train: DataFrame, valid: DataFrame) -> Predictor:
        halves = [_listed(half, label, classes) for half in (train, valid)]
        cells = Cells(halves[0], cols)
        with scratch_folder(train.sparkSession, "boosted") as folder:
            halves = [stored(cells.collapsed(half, [label]), f"{folder}/{name}") for half, name in zip(halves, ("train", "valid"))]

            def fit_class(c):
                own, judge = (half.withColumn(_IDX, (F.col(label) == F.lit(c)).cast("double")) for half in halves)

                def fitted(n: int):
                    return _binary(maxIter=n, stepSize=rate, maxDepth=depth, seed=seed).fit(own)

                model = fitted(rounds)
                kept = patient_rounds(list(model.evaluateEachIteration(judge)), patience)
                return (model if kept == rounds else fitted(kept)), kept

            models, kept = zip(*_each(classes, fit_class, parallelism))
        predict = _one_vs_rest(models, cells, classes)
        predict.rounds = list(kept)
        return predict

    return fit


def gaussian_nb(cols: list[str], label: str, classes: list) -> Learner:
    def fit(train: DataFrame) -> Predictor:
        model = fit_gaussian_nb(train, label, cols, classes)

        def predict(df: DataFrame) -> DataFrame:
            scored = predict_gaussian_nb(df, model, cols, classes)
            return scored.withColumn("probability", nb_probabilities(n=len(classes))).drop("scores")

        return predict

    return fit


# --- combining learners ----------------------------------------------------------------------


def preprocessed(make: Callable[[list[str]], Learner], cols: list[str], how: str = "standard") -> Learner:
    """A learner on scaled columns: fitted on the training rows alone, applied to them and to all rows it predicts for.

    ``make`` gets the names of the scaled columns; those of the table keep their values.
    """
    names = [f"_scaled_{c}" for c in cols]
    apply = {"standard": apply_standard, "minmax": apply_minmax}[how]

    def copied(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.col(c).cast("double") for n, c in zip(names, cols)})

    def fit(train: DataFrame) -> Predictor:
        train = copied(train)
        stats = fit_stats(train, names)
        predict = make(names)(apply(train, stats, names))
        return lambda df: predict(apply(copied(df), stats, names)).drop(*names)

    return fit


def balanced(make: Callable[[str], Learner], label: str, weight: str = "_balance") -> Learner:
    """A learner whose rows weigh n / (classes * n of the class), counted on the training rows of the fold. ``make`` gets the weight column's name."""

    def fit(train: DataFrame) -> Predictor:
        return make(weight)(balanced_weights(train, label, weight))

    return fit


def vote(
    learners: list[Learner], classes: list, how: str = "soft", weights: list[float] | None = None, tie: str = "lowest", members: bool = False
) -> Learner:
    """Soft vote (mean or weighted sum of probabilities) or hard vote of several learners, as one learner.

    With ``members`` the columns ``_prob0``, ``_vote0`` and so on of the single learners stay.
    """
    if weights is not None:
        check_weights(weights)
    if how not in ("soft", "hard"):
        raise ValueError("how is 'soft' or 'hard'")

    def fit(train: DataFrame) -> Predictor:
        predictors = [learner(train) for learner in learners]

        def predict(df: DataFrame) -> DataFrame:
            probs, preds = [], []
            for i, each in enumerate(predictors):
                df = each(df).withColumnsRenamed({"probability": f"_prob{i}", "prediction": f"_vote{i}"})
                probs.append(f"_prob{i}")
                preds.append(f"_vote{i}")
            df = df.withColumn("probability", mix(probs, weights))
            if how == "soft":
                df = df.withColumn("prediction", decode(argmax("probability"), classes))
            else:
                df = hard_vote(df, preds, tie)
            return df if members else df.drop(*probs, *preds)

        return predict

    return fit


def seed_ensemble(make: Callable[[int], Learner], seeds: list[int], classes: list, members: bool = False) -> Learner:
    """The same learner with several seeds, probabilities averaged."""
    return vote([make(s) for s in seeds], classes, members=members)


# --- validation ------------------------------------------------------------------------------


def out_of_fold(df: DataFrame, learner: Learner, folds: list[int], fold: str = "fold", parallelism: int = 3, stops: bool = False) -> DataFrame:
    """Predictions of every validation row by the model fitted on the other folds.

    With ``stops`` the learner also gets the validation rows, to stop on.
    """
    fits = _each(list(folds), lambda f: learner(train_of(df, f, fold), *([valid_of(df, f, fold)] if stops else [])), parallelism)
    return reduce(DataFrame.unionByName, [predict(valid_of(df, f, fold)) for f, predict in zip(folds, fits)])


def cross_validate(df: DataFrame, learner: Learner, label: str, folds: list[int], fold: str = "fold", parallelism: int = 3) -> DataFrame:
    """(fold, accuracy). The folded table is cached over the fits, since every fit passes over it many times."""
    df = df.persist()
    try:
        rows = accuracy(out_of_fold(df, learner, folds, fold, parallelism), label, "prediction", [fold]).collect()
    finally:
        df.unpersist()
    return df.sparkSession.createDataFrame([(r[fold], r["accuracy"]) for r in rows], f"{fold} int, accuracy double")


def repeated_cross_validate(
    df: DataFrame, make: Callable[[int], Learner], label: str, seeds: list[int], folds: list[int], fold_of: Callable[[DataFrame, int], DataFrame], fold: str = "fold"
) -> DataFrame:
    """(run, fold, accuracy): new folds and a new learner seed per run."""
    runs = []
    for i, s in enumerate(seeds):
        runs.append(cross_validate(fold_of(df, s), make(s), label, folds, fold).withColumn("run", F.lit(i)))
    return reduce(DataFrame.unionByName, runs)


def grid_search(df: DataFrame, make: Callable[..., Learner], grid: list[dict], label: str, folds: list[int], fold: str = "fold", parallelism: int = 2) -> DataFrame:
    """(params, mean_test_score): mean accuracy over the folds of ``make(**params)`` for every setting of the grid.

    The folded table is cached once for all settings. Nothing is fitted again on all rows.
    """
    df = df.persist()
    try:
        means = _each(grid, lambda params: out_of_fold(df, make(**params), folds, fold, 1), parallelism)
        scores = [cv_score(scored, label, "prediction", fold).first()[0] for scored in means]
    finally:
        df.unpersist()
    named = [", ".join(f"{k}={v}" for k, v in sorted(params.items())) for params in grid]
    return df.sparkSession.createDataFrame(list(zip(named, map(float, scores))), "params string, mean_test_score double")


def fit_and_score(train: DataFrame, test: DataFrame, learner: Learner, key: list[str], out: str = "prediction") -> DataFrame:
    """Fit on all labelled rows and label the others: (key, prediction)."""
    return learner(train)(test).select(*key, F.col("prediction").alias(out))
