"""Combining the predictions of several models.

Two shapes. Side by side: every model's prediction is a column of the row; voting is a projection and
moves no data, so it is the one to use for large tables. Long: (key, model, class or prediction); a
vote is a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..bounded import pin
from ..functions.scalar import argmax, decode, expand_slots, mix

MAX_SLOTS = 16  # classes that a long vote finds by itself and sums side by side


def check_weights(weights: Sequence[float]) -> None:
    if abs(sum(weights) - 1.0) > 1e-9:
        raise ValueError(f"weights must sum to 1, got {sum(weights)}")


# --- side by side ----------------------------------------------------------------------------


def soft_vote(
    df: DataFrame, probs: list[str], classes: list, weights: list[float] | None = None, out: str = "prediction"
) -> DataFrame:
    """Mean (or weighted sum) of the models' class probabilities and the class of the largest, first on ties."""
    if weights is not None:
        check_weights(weights)
    mixed = df.withColumn("probability", mix(probs, weights))
    return mixed.withColumn(out, decode(argmax("probability"), classes))


def align_probabilities(df: DataFrame, prob: str, known: list, classes: list) -> DataFrame:
    """Re-map a learner's class subset to all class slots, 0 elsewhere."""
    return df.withColumn(prob, expand_slots(prob, known, classes))


def _top(pred_cols: list[str], weights: list[float], tie: str) -> Column:
    """The prediction with the most weight; NULL predictions do not vote."""
    ballots = []
    for i, c in enumerate(pred_cols):
        same = [F.when(F.col(d) == F.col(c), F.lit(float(w))).otherwise(F.lit(0.0)) for d, w in zip(pred_cols, weights)]
        order = F.col(c) if tie == "lowest" else F.lit(i)
        ballots.append(F.when(F.col(c).isNotNull(), F.struct((-reduce(add, same)).alias("w"), order.alias("o"), F.col(c).alias("v"))))
    best = F.least(*ballots) if len(ballots) > 1 else ballots[0]
    return best["v"]


def hard_vote(df: DataFrame, pred_cols: list[str], tie: str = "lowest", out: str = "prediction") -> DataFrame:
    """Most common prediction. On ties the smallest class, or with tie="first" that of the earliest model."""
    if tie not in ("lowest", "first"):
        raise ValueError("tie is 'lowest' or 'first'")
    return df.withColumn(out, _top(pred_cols, [1.0] * len(pred_cols), tie))


def weighted_hard_vote(df: DataFrame, pred_cols: list[str], weights: list[float], out: str = "prediction") -> DataFrame:
    """Class with the largest sum of weights, the smallest class on ties."""
    check_weights(weights)
    return df.withColumn(out, _top(pred_cols, weights, "lowest"))


def agree_else(df: DataFrame, a: str, b: str, fallback: str, out: str = "prediction") -> DataFrame:
    """The common prediction, or the designated model's where the two differ."""
    return df.withColumn(out, F.when(F.col(a) == F.col(b), F.col(a)).otherwise(F.col(fallback)))


# --- long ------------------------------------------------------------------------------------


def argmax_class(probs: DataFrame, key: list[str], cls: str = "class", p: str = "p", out: str = "prediction") -> DataFrame:
    """Class with the highest probability per key, the lowest class on ties."""
    order = F.struct((-F.col(p)).alias("p"), F.col(cls).alias("c"))
    return probs.groupBy(*key).agg(F.min_by(cls, order).alias(out))


def soft_vote_long(
    probs: DataFrame,
    key: list[str],
    model: str = "model",
    cls: str = "class",
    p: str = "p",
    weights: dict[str, float] | None = None,
    classes: list | None = None,
    out: str = "prediction",
) -> DataFrame:
    """Mean (or weighted sum) of p per (key, class), then the class of the largest, lowest on ties.

    A key's sums form one aggregate, which adds up before its one shuffle, with the ``classes`` listed. Without, the classes are
    looked up first; only where they are more than ``MAX_SLOTS``, sums per (key, class) are made in a shuffle of their own.
    """
    if weights is not None:
        check_weights(list(weights.values()))
        weight = reduce(lambda acc, m: acc.when(F.col(model) == m, F.lit(float(weights[m]))), weights, F.when(F.lit(False), 0.0))

    def share(value: Column) -> Column:
        return F.avg(value) if weights is None else F.sum(weight * value)

    if classes is None:
        found = pin(probs.select(cls).distinct(), MAX_SLOTS)
        if found is not None and found.rows:
            return _best_of_found(probs, key, cls, p, found.values(cls), share, out)
        return argmax_class(probs.groupBy(*key, cls).agg(share(F.col(p)).alias(p)), key, cls, p, out)
    slots = [F.coalesce(share(F.when(F.col(cls) == F.lit(c), F.col(p))), F.lit(float("-inf"))) for c in sorted(classes)]
    summed = probs.groupBy(*key).agg(F.array(*slots).alias("_slots"))
    return summed.select(*key, decode(argmax("_slots"), sorted(classes)).alias(out))


def _best_of_found(probs: DataFrame, key: list[str], cls: str, p: str, classes: list, share: Callable[[Column], Column], out: str) -> DataFrame:
    """The choice of ``argmax_class`` among a key's own classes, which are among the few ``classes`` (NULL may be one)."""
    kind = probs.schema[cls].dataType
    own = [(F.lit(c).cast(kind), F.col(cls).eqNullSafe(F.lit(c).cast(kind))) for c in classes]
    slots = [F.struct(F.max(F.when(here, True)).alias("seen"), share(F.when(here, F.col(p))).alias("p")) for _, here in own]
    summed = probs.groupBy(*key).agg(*[slot.alias(f"_slot{i}") for i, slot in enumerate(slots)])
    ballots = [F.when(F.col(f"_slot{i}.seen"), F.struct((-F.col(f"_slot{i}.p")).alias("p"), c.alias("c"))) for i, (c, _) in enumerate(own)]
    return summed.select(*key, F.array_min(F.array(*ballots))["c"].alias(out))


def top_votes(
    votes: DataFrame, key: list[str], pred: str = "prediction", weight: str | None = None, classes: list | None = None
) -> DataFrame:
    """(key, prediction, votes): the most common prediction per key, the lowest class on ties.

    With the ``classes`` listed, one aggregate per key holds all counts and there is one shuffle;
    without, votes per (key, prediction) are counted first. Both add up before they shuffle, so a key
    with very many votes is no burden to one task.
    """
    if classes is None:
        counted = votes.groupBy(*key, pred).agg((F.sum(weight) if weight else F.count("*")).alias("votes"))
        order = F.struct((-F.col("votes")).alias("v"), F.col(pred).alias("c"))
        return counted.groupBy(*key).agg(F.min_by(pred, order).alias(pred), F.max("votes").alias("votes"))
    one = F.col(weight) if weight else F.lit(1)
    slots = [F.coalesce(F.sum(F.when(F.col(pred) == F.lit(c), one)), F.lit(0)) for c in sorted(classes)]
    counted = votes.groupBy(*key).agg(F.array(*slots).alias("_slots"))
    top = decode(argmax("_slots"), sorted(classes))
    return counted.select(*key, top.alias(pred), F.array_max("_slots").alias("votes"))


def fold_vote(test_predictions: DataFrame, key: list[str], pred: str = "prediction", classes: list | None = None) -> DataFrame:
    """Votes of the fold models for each unlabelled row, the class with the most of them."""
    return top_votes(test_predictions, key, pred, classes=classes).select(*key, pred)
