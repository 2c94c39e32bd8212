"""Scores of experiment variants, their effects and the conclusion drawn from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.aggregates import cv_score
from ..operators.bayes import nb_out_of_fold, nb_variant_hits


def nb_cv_score(folded: DataFrame, label: str, cols: list[str], classes: list, folds: list[int], fold: str = "fold") -> DataFrame:
    """One row: mean fold accuracy of Gaussian naive Bayes on the given feature columns."""
    return cv_score(nb_out_of_fold(folded, label, cols, folds, classes, fold), label, "prediction", fold)


def nb_ablation_scores(folded: DataFrame, label: str, variants: dict[str, list[str]], classes: list, folds: list[int], fold: str = "fold") -> DataFrame:
    """(variant, score) of naive Bayes on each variant's columns: mean fold accuracy, all from one fit and one scoring pass."""
    hits = nb_variant_hits(folded, label, variants, classes, folds, fold)
    return hits.groupBy("variant").agg(F.avg("accuracy").alias("score"))


def ablation_scores(df: DataFrame, variants: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(variant, score) from {name: function of the table to a one-row score}.

    The table is cached while all variants are scored, so its folds are made once however many there are.
    """
    df = df.persist()
    try:
        scored = [score(df).select(F.lit(name).alias("variant"), "score") for name, score in variants.items()]
        rows = reduce(DataFrame.unionByName, scored).collect()
    finally:
        df.unpersist()
    return df.sparkSession.createDataFrame([(r["variant"], r["score"]) for r in rows], "variant string, score double")


def ablation_effects(scores: DataFrame, baseline: str, sign: str = "drop") -> DataFrame:
    """(variant, score, effect): baseline - variant ("drop") or variant - baseline ("change")."""
    if sign not in ("drop", "change"):
        raise ValueError("sign is 'drop' or 'change'")
    base = scores.where(F.col("variant") == baseline).agg(F.max("score")).scalar()
    effect = base - F.col("score") if sign == "drop" else F.col("score") - base
    return scores.where(F.col("variant") != baseline).withColumn("effect", effect)


def rank_effects(effects: DataFrame, n: int | None = 1) -> DataFrame:
    """Experiments by effect, smallest first, ties by name; the first ``n`` or all."""
    ordered = effects.orderBy("effect", "variant")
    return ordered if n is None else ordered.limit(n)


RULES = ("drop", "magnitude", "stronger_side", "drop_else_gain", "most_negative")


def top_effect(effects: DataFrame, rule: str = "drop", threshold: float = 0.0) -> DataFrame:
    """One row (variant, effect, verdict): the variant that matters most, NULL and "none" without one.

    Effects are drops: a positive one means the removed part helped.
    drop: largest drop above the threshold. magnitude: largest absolute effect above it.
    stronger_side: the larger of the biggest drop and the biggest gain, a gain on ties, above it.
    drop_else_gain: largest drop above it, or else the biggest gain. most_negative: biggest gain.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    pair = F.struct("variant", "effect")
    best = effects.agg(
        F.min_by(pair, F.struct((-F.col("effect")).alias("e"), F.col("variant").alias("v"))).alias("hi"),
        F.min_by(pair, F.struct(F.col("effect").alias("e"), F.col("variant").alias("v"))).alias("lo"),
        F.min_by(pair, F.struct((-F.abs("effect")).alias("e"), F.col("variant").alias("v"))).alias("big"),
    )
    limit = F.lit(float(threshold))
    hi, lo, big = F.col("hi"), F.col("lo"), F.col("big")
    if rule == "drop":
        picked = F.when(hi["effect"] > limit, hi)
    elif rule == "magnitude":
        picked = F.when(F.abs(big["effect"]) > limit, big)
    elif rule == "stronger_side":
        drop_wins = F.abs(hi["effect"]) > F.abs(lo["effect"])
        picked = F.when(drop_wins & (hi["effect"] > limit), hi).when(~drop_wins & (lo["effect"] < -limit), lo)
    elif rule == "drop_else_gain":
        picked = F.when(hi["effect"] > limit, hi).when(lo["effect"] < 0, lo)
    else:
        picked = F.when(lo["effect"] < -limit, lo)
    verdict = F.when(F.col("p.effect") > 0, "helps").when(F.col("p.effect") < 0, "hurts").otherwise("none")
    return best.select(picked.alias("p")).select("p.variant", "p.effect", verdict.alias("verdict"))


def positive_effects(effects: DataFrame) -> DataFrame:
    """Only the variants whose removal lowered the score."""
    return effects.where(F.col("effect") > 0)


def best_variant(scores: DataFrame) -> DataFrame:
    """The variant with the top score, the first name on ties."""
    order = F.struct((-F.col("score")).alias("s"), F.col("variant").alias("v"))
    return scores.agg(F.min_by("variant", order).alias("variant"), F.max("score").alias("score"))
