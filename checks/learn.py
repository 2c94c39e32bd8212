"""Learners and cross-validation.

Naive Bayes and nearest neighbours have SQL. The tree and regression learners do not; they predict a
class that follows from price per unit and quantity, with some rows flipped by hash, so that there is
something to learn.
"""

from pyspark.sql import Window, functions as F

from stratafold.operators.aggregates import accuracy, cv_score
from stratafold.operators.bayes import nb_out_of_fold
from stratafold.operators.folds import balanced_weights, stratified_holdout, stratified_kfold
from stratafold.operators.knn import knn_out_of_fold
from stratafold.plans import learners as m
from stratafold.plans.boosting import softmax_boosted
from stratafold.session import kept

from .base import FEATURES, FOLDS, LINE_KEY, LK, Checks, fold_sql, holdout_sql, r, rounded, table
from .keyed import folded_lines

CHECKS = Checks()
_CLASSES = [1, 2, 3]

_TARGET = f"""CAST(CASE WHEN substr(md5(concat_ws('|', {LK})), 1, 1) = '0' THEN 1
  WHEN l_extendedprice / l_quantity > 1200 AND l_quantity > 20 THEN 3
  WHEN l_extendedprice / l_quantity > 1000 THEN 2 ELSE 1 END AS INTEGER)"""


def target_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    unit = (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    return lines.select(*LINE_KEY, *FEATURES, unit, F.expr(_TARGET).alias("target"))


def folded_target(spark, sf_dir):
    return stratified_kfold(target_lines(spark, sf_dir), LINE_KEY, "target")


_TARGET_FEATURES = ["l_quantity", "l_extendedprice", "unit_price"]


def nb_sql(folded, label, cols, key=LINE_KEY):
    """CTEs ending in pr(key.., fold, label, prediction): Gaussian naive Bayes on held-out folds."""
    n = range(len(cols))
    held = "SELECT unnest([0, 1, 2]) AS held"
    var = ", ".join(f"var_pop({c})" for c in cols)
    means = ", ".join(f"avg({c}) AS m{i}, var_pop({c}) AS v{i}" for i, c in enumerate(cols))
    norm = " + ".join(f"ln(2 * pi() * (cl.v{i} + tot.eps))" for i in n)
    dist = " + ".join(f"(f.{c} - cl.m{i}) * (f.{c} - cl.m{i}) * (0.5 / (cl.v{i} + tot.eps))" for i, c in enumerate(cols))
    return f"""f AS ({folded}), tr AS (SELECT h.held, f.* FROM f, ({held}) h WHERE f.fold <> h.held),
      tot AS (SELECT held, count(*) AS n, greatest({var}) * 1e-9::DOUBLE AS eps FROM tr GROUP BY held),
      cl AS (SELECT held, {label} AS c, count(*) AS n, {means} FROM tr GROUP BY held, {label}),
      sc AS (SELECT {', '.join('f.' + k for k in key)}, f.fold, f.{label}, cl.c, ln(cl.n::DOUBLE / tot.n) - 0.5 * ({norm}) - ({dist}) AS s
        FROM f JOIN cl ON f.fold = cl.held JOIN tot ON f.fold = tot.held),
      pr AS (SELECT {', '.join(key)}, fold, {label}, c AS prediction FROM sc QUALIFY row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY s DESC, c) = 1)"""


_NB_FLAG = nb_sql(fold_sql("lineitem", LINE_KEY, "l_returnflag"), "l_returnflag", FEATURES)
_TARGET_TABLE = f"(SELECT {LK}, l_quantity, l_extendedprice, l_extendedprice / l_quantity AS unit_price, {_TARGET} AS target FROM lineitem)"
_NB_TARGET = nb_sql(fold_sql(_TARGET_TABLE, LINE_KEY, "target"), "target", _TARGET_FEATURES)


@CHECKS.add(f"WITH {_NB_FLAG} SELECT {LK}, fold, l_returnflag, prediction FROM pr")
def naive_bayes_out_of_fold(spark, sf_dir):
    """Every row's class as seen by the model of the other folds."""
    preds = nb_out_of_fold(folded_lines(spark, sf_dir), "l_returnflag", FEATURES, FOLDS, ["A", "N", "R"])
    return preds.select(*LINE_KEY, "fold", "l_returnflag", "prediction")


@CHECKS.add(f"WITH {_NB_FLAG} SELECT {r('avg(a)')} AS score FROM (SELECT avg(CASE WHEN l_returnflag = prediction THEN 1.0 ELSE 0.0 END) AS a FROM pr GROUP BY fold)")
def naive_bayes_cv_score(spark, sf_dir):
    """Mean accuracy over three stratified folds, from scan to score in one plan."""
    preds = nb_out_of_fold(folded_lines(spark, sf_dir), "l_returnflag", FEATURES, FOLDS, ["A", "N", "R"])
    return cv_score(preds, "l_returnflag", "prediction").withColumn("score", rounded("score"))


@CHECKS.add(f"WITH {_NB_TARGET} SELECT fold, {r('avg(CASE WHEN target = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM pr GROUP BY fold")
def naive_bayes_cross_validation(spark, sf_dir):
    """Fold accuracies on a class that depends on the features."""
    preds = nb_out_of_fold(folded_target(spark, sf_dir), "target", _TARGET_FEATURES, FOLDS, _CLASSES)
    return accuracy(preds, "target", "prediction", ["fold"]).withColumn("accuracy", rounded("accuracy"))


_BUYERS = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 100 + o_custkey / 10.0 AS near FROM orders)"


@CHECKS.add(
    f"""WITH f AS ({fold_sql(_BUYERS, ['o_orderkey'], 'o_custkey')}), {nb_sql('SELECT * FROM f', 'o_custkey', ['near', 'o_totalprice'], ['o_orderkey'])[len('f AS (SELECT * FROM f), '):]}
      SELECT o_orderkey, fold, o_custkey, prediction FROM pr"""
)
def naive_bayes_many_classes(spark, sf_dir):
    """Every customer is a class; rows are scored against blocks of similar classes that can still win."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_orderkey") % 100 + F.col("o_custkey") / 10.0).alias("near"))
    folded = stratified_kfold(orders, ["o_orderkey"], "o_custkey")
    return nb_out_of_fold(folded, "o_custkey", ["near", "o_totalprice"], FOLDS, key=["o_orderkey"]).select("o_orderkey", "fold", "o_custkey", "prediction")


_EMB = fold_sql("embeddings", ["vec_id"], "label")


@CHECKS.add(
    f"""WITH f AS ({_EMB}), d AS (SELECT q.vec_id, q.fold, p.vec_id AS point, p.label,
          list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i:
            (q.embedding[i]::DOUBLE - p.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - p.embedding[i]::DOUBLE))) AS d2
          FROM f q, f p WHERE q.fold <> p.fold),
        n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d2, point) <= 7)
        SELECT vec_id, fold, label AS prediction FROM (SELECT vec_id, fold, label, count(*) AS c FROM n GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1"""
)
def knn_out_of_fold_k7(spark, sf_dir):
    """Majority label of the seven nearest vectors of the other folds."""
    folded = stratified_kfold(table(spark, sf_dir, "embeddings"), ["vec_id"], "label")
    return knn_out_of_fold(folded, 7, "embedding", "vec_id", "label", FOLDS)


def _forest(seed=42, trees=10, depth=6, **params):
    return m.forest(_TARGET_FEATURES, "target", _CLASSES, trees=trees, depth=depth, seed=seed, **params)


# What a second engine can say about a learner: which rows of which class it must score, that no row's probabilities
# miss a sum of one, that none is labelled otherwise than by its largest probability, and that it beats the share of
# the most frequent class by more than five points. The counts come from the scored rows.


def _facts(scored, by=("fold",), extra=None):
    largest = F.get(F.array(*map(F.lit, _CLASSES)), F.array_position("probability", F.array_max("probability")).cast("int") - 1)
    total = sum((F.get("probability", F.lit(i)) for i in range(len(_CLASSES))), F.lit(0.0))  # as many as there are classes
    wrong = {"off_sums": ~(F.abs(total - 1) < 1e-9), "off_labels": ~largest.eqNullSafe(F.col("prediction")), **(extra or {})}
    counts = [F.count(F.when(F.col("target") == c, 1)).alias(f"n_{c}") for c in _CLASSES]
    share = F.greatest(*[F.count(F.when(F.col("target") == c, 1)) for c in _CLASSES]) / F.count("*")
    learns = F.avg((F.col("prediction") == F.col("target")).cast("int")) > share + 0.05
    return scored.groupBy(*by).agg(*counts, *[F.count(F.when(F.coalesce(x, F.lit(True)), 1)).alias(n) for n, x in wrong.items()], learns.alias("learns"))


_FOLDED_TARGET = fold_sql(_TARGET_TABLE, LINE_KEY, "target")
_HELD_OUT = f"(SELECT * FROM ({holdout_sql(_TARGET_TABLE, LINE_KEY, 'target')}) WHERE part = 'test')"


def _facts_sql(source, by="fold", extra="", zeros=()):
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    counts = ", ".join(f"count(*) FILTER (target = {c}) AS n_{c}" for c in _CLASSES)
    none = ", ".join(f"0::BIGINT AS {z}" for z in ("off_sums", "off_labels", *zeros))
    return f"SELECT {keys}{extra}{counts}, {none}, true AS learns FROM ({source}){group}"


_CV_SQL = _facts_sql(_FOLDED_TARGET)
_VOTE_SQL = _facts_sql(_FOLDED_TARGET, zeros=("off_votes",))


def _cross_validated(folded, learner, extra=None, stops=False):
    folded = kept(folded, "folded")  # every fit passes over it many times
    return _facts(m.out_of_fold(folded, learner, FOLDS, stops=stops), extra=extra)


@CHECKS.add(_CV_SQL)
def random_forest_cv(spark, sf_dir):
    return _cross_validated(folded_target(spark, sf_dir), _forest())


@CHECKS.add(_CV_SQL)
def random_forest_balanced_cv(spark, sf_dir):
    """Class weights counted on the training folds, feature share by log2, leaves of five rows."""
    learner = m.balanced(lambda weight: _forest(features="log2", min_leaf=5, weight=weight), "target")
    return _cross_validated(folded_target(spark, sf_dir), learner)


@CHECKS.add(_CV_SQL)
def boosted_trees_cv(spark, sf_dir):
    learner = m.boosted(_TARGET_FEATURES, "target", _CLASSES, rounds=5, rate=0.3, subsample=0.8, depth=4)
    return _cross_validated(folded_target(spark, sf_dir), learner)


@CHECKS.add(_facts_sql(_HELD_OUT, by=""))
def boosted_trees_early_stop(spark, sf_dir):
    """Rounds end when the held-out rows stop improving; judged on those rows."""
    parts = stratified_holdout(target_lines(spark, sf_dir), LINE_KEY, "target").withColumn("validate", F.col("part") == "test")
    learner = m.boosted(_TARGET_FEATURES, "target", _CLASSES, rounds=8, rate=0.3, depth=4, validation="validate")
    return _facts(learner(parts)(parts.where("validate")), by=())


@CHECKS.add(_CV_SQL)
def boosted_trees_stop_on_fold(spark, sf_dir):
    """Each fold's models stop on the fold that is held out, after two rounds without gain."""
    learner = m.boosted_to_fold(_TARGET_FEATURES, "target", _CLASSES, rounds=6, patience=2, rate=0.3, depth=3)
    return _cross_validated(folded_target(spark, sf_dir), learner, stops=True)


_EDGES = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_extendedprice": [20000.0, 40000.0, 60000.0], "unit_price": [1000.0, 1100.0, 1200.0, 1400.0]}
_BINS = ", ".join(f"len(list_filter({edges}, lambda e: {c} > e)) + 1 AS b{i}" for i, (c, edges) in enumerate(_EDGES.items()))


def _split_sql(rows, name):
    """CTEs that end in ``name``(k, node, f, bin, gain): the best split of each node of ``rows``(k, node, b0.., g, h)."""
    strength = lambda g, h: f"({g})::DOUBLE / 4194304 * (({g})::DOUBLE / 4194304) / (({h})::DOUBLE / 4194304 + 1.0)"
    upto, whole = "PARTITION BY k, node, f ORDER BY bin", "PARTITION BY k, node, f"
    return f"""{name}_cells AS (SELECT k, node, f, bin, sum(g) AS g, sum(h) AS h, count(*) AS n
        FROM (SELECT k, node, unnest([0, 1, 2]) AS f, unnest([b0, b1, b2]) AS bin, g, h FROM {rows}) GROUP BY ALL),
      {name}_sums AS (SELECT k, node, f, bin, {', '.join(f'sum({c}) OVER ({upto}) AS {c}, sum({c}) OVER ({whole}) AS {c}_all' for c in 'ghn')} FROM {name}_cells),
      {name} AS (SELECT * FROM (SELECT k, node, f, bin, 0.5::DOUBLE * ({strength('g', 'h')} + {strength('g_all - g', 'h_all - h')} - {strength('g_all', 'h_all')}) AS gain
        FROM {name}_sums WHERE n >= 20 AND n_all - n >= 20) WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY k, node ORDER BY gain DESC, f, bin) = 1)"""


_SIDE = "CASE WHEN list_extract([b0, b1, b2], (f + 1)::BIGINT) > bin THEN 'R' ELSE 'L' END"


@CHECKS.add(
    f"""WITH t AS (SELECT target, {_BINS} FROM {_TARGET_TABLE}),
      r0 AS (SELECT k, '' AS node, b0, b1, b2, CAST(round((1 / 3::DOUBLE - (target = k)::INTEGER) * 4194304) AS BIGINT) AS g, CAST(round(2 / 9::DOUBLE * 4194304) AS BIGINT) AS h
        FROM t, (SELECT unnest([1, 2, 3]) AS k)),
      {_split_sql('r0', 's0')},
      r1 AS (SELECT r0.* REPLACE ({_SIDE} AS node) FROM r0 JOIN s0 USING (k)),
      {_split_sql('r1', 's1')},
      leaves AS (SELECT k, CASE WHEN f IS NULL THEN node ELSE node || {_SIDE} END AS path, g, h FROM r1 LEFT JOIN s1 USING (k, node))
      SELECT leaf.k AS class, path, s0.f AS f0, s0.bin AS cut0, s1.f AS f1, s1.bin AS cut1, {r('-0.3::DOUBLE * sum(g)::DOUBLE / (sum(h)::DOUBLE + 4194304)')} AS value
      FROM leaves leaf JOIN s0 ON s0.k = leaf.k LEFT JOIN s1 ON s1.k = leaf.k AND s1.node = substr(path, 1, 1)
      GROUP BY ALL"""
)
def boosted_softmax_first_trees(spark, sf_dir):
    """The first round's tree of each class, four leaves at depth two: splits and leaf values."""
    fit = softmax_boosted(_TARGET_FEATURES, "target", _CLASSES, rounds=1, rate=0.3, leaves=4, depth=2, edges=[_EDGES[c] for c in _TARGET_FEATURES])
    rows = []
    for k, tree in zip(_CLASSES, fit(target_lines(spark, sf_dir)).model.rounds[0]):
        waiting = [(0, "", ())]
        while waiting:
            node, path, splits = waiting.pop()
            if tree.left[node]:
                own = (*splits, tree.feature[node], tree.cut[node])
                waiting += [(tree.left[node], path + "L", own), (tree.left[node] + 1, path + "R", own)]
            else:
                rows.append((k, path, *(*splits, None, None)[:4], tree.value[node]))
    found = spark.createDataFrame(rows, "class int, path string, f0 int, cut0 long, f1 int, cut1 long, value double")
    return found.withColumn("value", rounded("value"))


def _softmax(**params):
    return softmax_boosted(_TARGET_FEATURES, "target", _CLASSES, rate=0.5, key=LINE_KEY, **params)


@CHECKS.add(_CV_SQL)
def boosted_softmax_cv(spark, sf_dir):
    """Joint softmax boosting with row and column samples and balanced classes."""

    def learner(train):
        return _softmax(rounds=3, leaves=6, subsample=0.8, features=0.7, weight="weight")(balanced_weights(train, "target"))

    return _cross_validated(folded_target(spark, sf_dir), learner)


@CHECKS.add(_CV_SQL)
def boosted_softmax_stop_on_fold(spark, sf_dir):
    """Rounds stop on the joint log loss of the fold that is held out."""
    return _cross_validated(folded_target(spark, sf_dir), _softmax(rounds=4, leaves=6, patience=1), stops=True)


@CHECKS.add(_CV_SQL)
def logistic_regression_cv(spark, sf_dir):
    """On columns scaled by the training rows of each fold."""
    learner = m.preprocessed(lambda cols: m.logistic(cols, "target", _CLASSES, maxIter=20), _TARGET_FEATURES)
    return _cross_validated(folded_target(spark, sf_dir), learner)


def _three():
    return [_forest(trees=5), m.gaussian_nb(_TARGET_FEATURES, "target", _CLASSES), m.logistic(_TARGET_FEATURES, "target", _CLASSES, maxIter=10)]


def _soft_vote_differs(n):
    """The vote against one from the members' own columns, class by class."""
    mean = [sum((F.get(f"_prob{i}", F.lit(c)) for i in range(n)), F.lit(0.0)) / n for c in range(len(_CLASSES))]
    best = F.greatest(*mean)
    label = F.when(mean[0] == best, _CLASSES[0]).when(mean[1] == best, _CLASSES[1]).otherwise(_CLASSES[2])
    near = F.greatest(*[F.when(p < best, p).otherwise(0.0) for p in mean]) > best - 1e-12  # a tie but for rounding
    return ~near & (label != F.col("prediction"))


def _hard_vote_differs(n):
    votes = [sum(((F.col(f"_vote{i}") == c).cast("int") for i in range(n)), F.lit(0)) for c in _CLASSES]
    most = F.greatest(*votes)
    return F.when(votes[0] == most, _CLASSES[0]).when(votes[1] == most, _CLASSES[1]).otherwise(_CLASSES[2]) != F.col("prediction")


@CHECKS.add(_VOTE_SQL)
def voting_classifier_soft(spark, sf_dir):
    learner = m.vote(_three(), _CLASSES, members=True)
    return _cross_validated(folded_target(spark, sf_dir), learner, {"off_votes": _soft_vote_differs(3)})


@CHECKS.add(_VOTE_SQL.replace("0::BIGINT AS off_labels, ", ""))
def voting_classifier_hard(spark, sf_dir):
    """The vote need not be the class of the largest mean probability."""
    learner = m.vote(_three(), _CLASSES, how="hard", members=True)
    return _cross_validated(folded_target(spark, sf_dir), learner, {"off_votes": _hard_vote_differs(3)}).drop("off_labels")


_SUBSETS = [_TARGET_FEATURES, _TARGET_FEATURES[:2], _TARGET_FEATURES[2:]]
_NB_VOTE = " UNION ALL ".join(
    f"""SELECT {LK}, fold, c, exp(s - max(s) OVER (PARTITION BY {LK})) / sum(exp(s - top)) OVER (PARTITION BY {LK}) AS p
      FROM (SELECT *, max(s) OVER (PARTITION BY {LK}) AS top FROM (WITH {nb_sql(_FOLDED_TARGET, 'target', cols)} SELECT {LK}, fold, c, s FROM sc))"""
    for cols in _SUBSETS
)


@CHECKS.add(f"SELECT {LK}, fold, c AS prediction FROM (SELECT {LK}, fold, c, sum(p) AS p FROM ({_NB_VOTE}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {LK} ORDER BY p DESC, c) = 1")
def voting_naive_bayes(spark, sf_dir):
    """Soft vote of three naive Bayes models on different columns: every row's class."""
    learner = m.vote([m.gaussian_nb(cols, "target", _CLASSES) for cols in _SUBSETS], _CLASSES)
    return m.out_of_fold(kept(folded_target(spark, sf_dir), "folded"), learner, FOLDS).select(*LINE_KEY, "fold", "prediction")


@CHECKS.add(
    " UNION ALL ".join(
        f"""SELECT {LK}, fold, l_returnflag, prediction FROM (WITH s AS (SELECT fs.* REPLACE ({', '.join(f'({c} - m_{c}) / d_{c} AS {c}' for c in FEATURES)}) FROM
          ({fold_sql('lineitem', LINE_KEY, 'l_returnflag')}) fs, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in FEATURES)}
          FROM ({fold_sql('lineitem', LINE_KEY, 'l_returnflag')}) WHERE fold <> {f})), {nb_sql('SELECT * FROM s', 'l_returnflag', FEATURES)} SELECT * FROM pr) WHERE fold = {f}"""
        for f in FOLDS
    )
)
def naive_bayes_scaled_in_folds(spark, sf_dir):
    """Both halves of each fold scaled by its training rows, then naive Bayes."""
    learner = m.preprocessed(lambda cols: m.gaussian_nb(cols, "l_returnflag", ["A", "N", "R"]), FEATURES)
    return m.out_of_fold(kept(folded_lines(spark, sf_dir), "folded"), learner, FOLDS).select(*LINE_KEY, "fold", "l_returnflag", "prediction")


@CHECKS.add(" UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS run, * FROM ({_facts_sql(fold_sql(_TARGET_TABLE, LINE_KEY, 'target', seed=seed))})" for i, seed in enumerate((42, 43))))
def repeated_cv_forest(spark, sf_dir):
    """Two runs with their own folds and learner seeds."""
    lines = target_lines(spark, sf_dir)
    runs = [_cross_validated(stratified_kfold(lines, LINE_KEY, "target", seed=s), _forest(s, trees=5, depth=5)).withColumn("run", F.lit(i)) for i, s in enumerate((42, 43))]
    return runs[0].unionByName(runs[1])


@CHECKS.add(_VOTE_SQL)
def seed_ensemble_cv(spark, sf_dir):
    learner = m.seed_ensemble(lambda s: _forest(s, trees=3, depth=5), [42, 43, 44], _CLASSES, members=True)
    return _cross_validated(folded_target(spark, sf_dir), learner, {"off_votes": _soft_vote_differs(3)})


@CHECKS.add(f"WITH s AS ({_facts_sql(_FOLDED_TARGET)}) SELECT unnest(['depth=2', 'depth=5']) AS params, unnest([false, true]) AS best, true AS in_range")
def grid_search_forest(spark, sf_dir):
    """Deeper trees score higher on a class that needs two cuts on two columns."""
    grid = [{"depth": 2}, {"depth": 5}]
    found = m.grid_search(folded_target(spark, sf_dir), lambda depth: _forest(trees=5, depth=depth), grid, "target", FOLDS)
    best = F.col("mean_test_score") == F.max("mean_test_score").over(Window.partitionBy())
    return found.select("params", best.alias("best"), F.col("mean_test_score").between(0.3, 1.0).alias("in_range"))


@CHECKS.add(_facts_sql(_HELD_OUT, by="").replace("0::BIGINT AS off_sums, 0::BIGINT AS off_labels", "0::BIGINT AS off_labels"))
def final_fit_and_score(spark, sf_dir):
    """Fit on the training part, label the other rows by key: the content of a predictions file."""
    parts = stratified_holdout(target_lines(spark, sf_dir), LINE_KEY, "target")
    train, held = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "test")
    labelled = m.fit_and_score(train, held.drop("target"), _forest(), LINE_KEY)
    scored = held.select(*LINE_KEY, "target").join(labelled, LINE_KEY).withColumn("probability", F.transform(F.array(*map(F.lit, _CLASSES)), lambda c: (c == F.col("prediction")).cast("double")))
    return _facts(scored, by=()).drop("off_sums")
