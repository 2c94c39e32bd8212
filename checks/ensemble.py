"""Voting. Three made-up models predict a class of 0, 1, 2 from columns of the line items."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stratafold.functions import scalar as sc
from stratafold.operators import voting as v

from .base import LINE_KEY, LK, Checks, r, rounded, table

CHECKS = Checks()
_CLASSES = [0, 1, 2]
_PREDS = {"p1": "l_linenumber % 3", "p2": "CAST(l_quantity AS INTEGER) % 3", "p3": "CAST(l_suppkey % 3 AS INTEGER)"}
_VOTES_SQL = f"(SELECT {LK}, " + ", ".join(f"CAST({e} AS INTEGER) AS {n}" for n, e in _PREDS.items()) + " FROM lineitem)"
_M1 = ["l_quantity / 100", "l_discount * 2", "1 - l_quantity / 100 - l_discount * 2"]
_M2 = ["l_tax * 5", "l_discount * 5", "1 - l_tax * 5 - l_discount * 5"]


def _votes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(*LINE_KEY, *[F.expr(e).cast("int").alias(n) for n, e in _PREDS.items()])


def _probs(spark, sf_dir):
    arrays = [F.array(*[F.expr(e) for e in m]).alias(n) for n, m in (("m1", _M1), ("m2", _M2))]
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, *arrays)


def _long_probs(spark, sf_dir):
    parts = []
    for model in ("m1", "m2"):
        exploded = _probs(spark, sf_dir).select(*LINE_KEY, F.posexplode(model).alias("class", "p"))
        parts.append(exploded.withColumn("model", F.lit(model)))
    return reduce(DataFrame.unionByName, parts)


def _long_votes(spark, sf_dir):
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("prediction")) for n in _PREDS])
    return _votes(spark, sf_dir).select(*LINE_KEY, F.inline(pairs))


def _soft_sql(mix):
    """Class with the largest mixed probability, the first on ties."""
    cols = ", ".join(f"{mix(a, b)} AS c{i}" for i, (a, b) in enumerate(zip(_M1, _M2)))
    return f"""SELECT {LK}, {r('greatest(c0, c1, c2)')} AS top, CAST(CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS INTEGER) AS prediction
        FROM (SELECT {LK}, {cols} FROM lineitem)"""


_MEAN = _soft_sql(lambda a, b: f"(({a}) + ({b})) / 2")
_WEIGHTED = _soft_sql(lambda a, b: f"(({a}) * 0.6::DOUBLE + ({b}) * 0.4::DOUBLE)")


@CHECKS.add(_MEAN)
def soft_vote(spark, sf_dir):
    """Mean probability of two models, side by side: a projection."""
    voted = v.soft_vote(_probs(spark, sf_dir), ["m1", "m2"], _CLASSES)
    return voted.select(*LINE_KEY, rounded(F.array_max("probability")).alias("top"), "prediction")


@CHECKS.add(_WEIGHTED)
def weighted_soft_vote(spark, sf_dir):
    voted = v.soft_vote(_probs(spark, sf_dir), ["m1", "m2"], _CLASSES, [0.6, 0.4])
    return voted.select(*LINE_KEY, rounded(F.array_max("probability")).alias("top"), "prediction")


@CHECKS.add(f"SELECT {LK}, prediction FROM ({_MEAN})")
def soft_vote_long(spark, sf_dir):
    """The same vote from one row per model and class."""
    return v.soft_vote_long(_long_probs(spark, sf_dir), LINE_KEY, classes=_CLASSES)


@CHECKS.add(f"SELECT {LK}, prediction FROM ({_WEIGHTED})")
def weighted_soft_vote_long(spark, sf_dir):
    return v.soft_vote_long(_long_probs(spark, sf_dir), LINE_KEY, weights={"m1": 0.6, "m2": 0.4})


@CHECKS.add(
    " UNION ALL ".join(
        f"""SELECT {LK}, '{name}' AS model, CAST(CASE WHEN c0 >= c1 AND c0 >= c2 THEN 0 WHEN c1 >= c2 THEN 1 ELSE 2 END AS INTEGER) AS prediction
        FROM (SELECT {LK}, {', '.join(f'{e} AS c{i}' for i, e in enumerate(model))} FROM lineitem)"""
        for name, model in (("m1", _M1), ("m2", _M2))
    )
)
def argmax_class(spark, sf_dir):
    return v.argmax_class(_long_probs(spark, sf_dir), [*LINE_KEY, "model"])


_MODE = "CASE WHEN p1 = p2 OR p1 = p3 THEN p1 WHEN p2 = p3 THEN p2 ELSE least(p1, p2, p3) END"


@CHECKS.add(f"SELECT {LK}, {_MODE} AS prediction FROM {_VOTES_SQL}")
def hard_vote_lowest(spark, sf_dir):
    """Most common of three predictions, the smallest class when all differ."""
    return v.hard_vote(_votes(spark, sf_dir), list(_PREDS)).select(*LINE_KEY, "prediction")


@CHECKS.add(f"SELECT {LK}, CASE WHEN p1 = p2 OR p1 = p3 THEN p1 WHEN p2 = p3 THEN p2 ELSE p1 END AS prediction FROM {_VOTES_SQL}")
def hard_vote_first_model(spark, sf_dir):
    """Most common of three predictions, the first model's when all differ."""
    return v.hard_vote(_votes(spark, sf_dir), list(_PREDS), tie="first").select(*LINE_KEY, "prediction")


@CHECKS.add(f"SELECT {LK}, {_MODE} AS prediction, CASE WHEN p1 = p2 AND p2 = p3 THEN 3 WHEN p1 = p2 OR p1 = p3 OR p2 = p3 THEN 2 ELSE 1 END::BIGINT AS votes FROM {_VOTES_SQL}")
def top_votes(spark, sf_dir):
    return v.top_votes(_long_votes(spark, sf_dir), LINE_KEY, classes=_CLASSES)


@CHECKS.add(f"SELECT {LK}, CASE WHEN p1 = p2 THEN p1 ELSE p2 END AS prediction FROM {_VOTES_SQL}")
def agree_else(spark, sf_dir):
    return v.agree_else(_votes(spark, sf_dir), "p1", "p2", fallback="p2").select(*LINE_KEY, "prediction")


@CHECKS.add(f"SELECT {LK}, CASE WHEN p2 = p3 THEN p2 ELSE p1 END AS prediction FROM {_VOTES_SQL}")
def weighted_hard_vote(spark, sf_dir):
    """Weights .4, .3, .3: two agreeing lighter models outvote the heavy one."""
    return v.weighted_hard_vote(_votes(spark, sf_dir), list(_PREDS), [0.4, 0.3, 0.3]).select(*LINE_KEY, "prediction")


@CHECKS.add(
    """SELECT l_orderkey, prediction FROM (SELECT l_orderkey, prediction, row_number() OVER
         (PARTITION BY l_orderkey ORDER BY count(*) DESC, prediction) AS i FROM
         (SELECT l_orderkey, CAST(l_quantity AS INTEGER) % 3 AS prediction FROM lineitem) GROUP BY l_orderkey, prediction) WHERE i = 1"""
)
def fold_vote(spark, sf_dir):
    """Votes for one key from several fold models: here each line of an order votes."""
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity").cast("int") % 3).alias("prediction"))
    return v.fold_vote(votes, ["l_orderkey"])


@CHECKS.add(
    f"""SELECT {LK}, {r(_M1[0])} AS c0, 0.0::DOUBLE AS c1, {r(_M1[1])} AS c2, {r(_M1[2])} AS c3, CAST(p1 = 1 AS DOUBLE) AS hot1,
        ['a', 'b', 'c'][p1 + 1] AS decoded FROM (SELECT *, l_linenumber % 3 AS p1 FROM lineitem)"""
)
def class_slots(spark, sf_dir):
    """Probabilities of three known classes in four slots, a one-hot vote, and a decoded class index."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, F.array(*[F.expr(e) for e in _M1]).alias("m1"), (F.col("l_linenumber") % 3).alias("p1"))
    wide = v.align_probabilities(lines, "m1", [0, 2, 3], [0, 1, 2, 3])
    slots = [rounded(F.col("m1")[i]).alias(f"c{i}") for i in range(4)]
    return wide.select(*LINE_KEY, *slots, sc.one_hot("p1", _CLASSES)[1].alias("hot1"), sc.decode("p1", ["a", "b", "c"]).alias("decoded"))
