"""Comparing predicted with gold classes.

Every figure comes from the confusion counts, a table of classes times classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.operators.labeling import CLASSES


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``(gold, predicted, n)`` over the rows that have both."""
    return df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(
        F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def class_scores(counts: DataFrame, classes: Sequence[int] = CLASSES, by: Sequence[str] = ()) -> DataFrame:
    """Per class (and per ``by``, if given): hits, wrong and missed predictions, precision, recall, F1, and the overall accuracy.

    A ratio without a denominator is 0.
    """
    per_class = counts.select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class"))
    is_gold, is_pred = F.col("gold") == F.col("class"), F.col("predicted") == F.col("class")
    sums = per_class.groupBy(*by, "class").agg(
        F.sum(F.when(is_gold & is_pred, F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(~is_gold & is_pred, F.col("n")).otherwise(0)).alias("wrong"),
        F.sum(F.when(is_gold & ~is_pred, F.col("n")).otherwise(0)).alias("missed"),
        (F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    hits, wrong, missed = F.col("hits"), F.col("wrong"), F.col("missed")
    return sums.select(
        *by, "class", "hits", "wrong", "missed",
        _ratio(hits, hits + wrong).alias("precision"), _ratio(hits, hits + missed).alias("recall"),
        _ratio(2 * hits, 2 * hits + wrong + missed).alias("f1"), "accuracy")


def f1_summary(scores: DataFrame) -> DataFrame:
    """Macro and support-weighted F1."""
    support = F.col("hits") + F.col("missed")
    return scores.agg(F.avg("f1").alias("f1_macro"),
                      _ratio(F.sum(F.col("f1") * support), F.sum(support)).alias("f1_weighted"))


def label_histogram(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """``(class, n_gold, n_predicted)``; a class seen on one side only gets 0 on the other."""
    # One pass: what gives the predictions may be costly.
    both = df.select(F.inline(F.array(F.struct(F.col(gold).cast("int").alias("class"), F.lit(1).alias("_g"), F.lit(0).alias("_p")),
                                      F.struct(F.col(predicted).cast("int").alias("class"), F.lit(0).alias("_g"), F.lit(1).alias("_p")))))
    return both.where("class is not null").groupBy("class").agg(F.sum("_g").alias("n_gold"), F.sum("_p").alias("n_predicted"))


def probability_histogram(df: DataFrame, proba: str, classes: Sequence[int] = CLASSES, bins: int = 20) -> DataFrame:
    """``(class, bin, n)`` over [0, 1] in equal bins; the last bin includes 1."""
    slots = df.select(F.posexplode(proba).alias("_i", "_p"))
    names = F.array(*[F.lit(c) for c in classes])
    return slots.groupBy(
        F.get(names, F.col("_i")).alias("class"),
        F.least(F.width_bucket("_p", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins)).alias("bin"),
    ).agg(F.count(F.lit(1)).alias("n"))


def errors(df: DataFrame, gold: str, predicted: str, gold_class: int | None = None) -> DataFrame:
    """Rows whose prediction differs from the gold label, optionally of one gold class."""
    wrong = df.where(F.col(gold) != F.col(predicted))
    return wrong if gold_class is None else wrong.where(F.col(gold) == gold_class)
