"""Slices: overlapping parts of a table, judged in one pass.

A row holds the slices it is in as bits of one number, made where the row is read. All figures of all slices come from one count over
the distinct numbers, however many slices there are and however much they overlap.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.operators import evaluation
from weakloom.operators.labeling import CLASSES

#: Bits of the number that holds the slices.
MOST_SLICES = 63


def with_slices(df: DataFrame, slices: Mapping[str, Column | str], out: str = "slices") -> DataFrame:
    """Add the number whose bit ``i`` says whether the row is in the ``i``-th slice.

    A slice is a condition, as a column or in SQL; where it is null it does not hold.
    """
    if not 0 < len(slices) <= MOST_SLICES:
        raise ValueError(f"from 1 to {MOST_SLICES} slices")
    conditions = [F.expr(c) if isinstance(c, str) else c for c in slices.values()]
    bits = [F.when(condition, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, condition in enumerate(conditions)]
    return df.withColumn(out, functools.reduce(operator.add, bits))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _held(n: int, slices: str) -> Column:
    """The numbers of the slices a row is in."""
    return F.filter(_numbers(n), lambda i: F.expr(f"`{slices}`").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)


def _names(names: Sequence[str], number: str) -> Column:
    return F.get(F.expr(lit.string_array(names)), F.col(number))


def slice_confusion(df: DataFrame, gold: str, predicted: str, names: Sequence[str], slices: str = "slices") -> DataFrame:
    """``(slice, gold, predicted, n)`` over the rows that have both."""
    counts = df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(
        slices, F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    spread = counts.select("gold", "predicted", "n", F.explode(_held(len(names), slices)).alias("_number"))
    return spread.groupBy("_number", "gold", "predicted").agg(F.sum("n").alias("n")).select(
        _names(names, "_number").alias("slice"), "gold", "predicted", "n")


def slice_scores(df: DataFrame, gold: str, predicted: str, names: Sequence[str], slices: str = "slices",
                 classes: Sequence[int] = CLASSES) -> DataFrame:
    """The scores per class of every slice with a judged row."""
    return evaluation.class_scores(slice_confusion(df, gold, predicted, names, slices), classes, by=["slice"])


def slice_overlaps(df: DataFrame, names: Sequence[str], slices: str = "slices") -> DataFrame:
    """``(left, right, n)``: rows in both of two slices, and of one slice where they are the same. Pairs without a row are missing."""
    counts = df.groupBy(slices).agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("n", _held(len(names), slices).alias("_held")).select("n", "_held", F.explode("_held").alias("_left"))
    pairs = first.select("n", "_left", F.explode(F.filter("_held", lambda x: x >= F.col("_left"))).alias("_right"))
    return pairs.groupBy("_left", "_right").agg(F.sum("n").alias("n")).select(
        _names(names, "_left").alias("left"), _names(names, "_right").alias("right"), "n")


def slice_residuals(df: DataFrame, loss: str, names: Sequence[str], slices: str = "slices") -> DataFrame:
    """``(number, slice, n, loss, residual)``: the mean loss of each slice, and how far it lies above that of all rows, as a share of it."""
    judged = df.where(F.col(loss).isNotNull()).groupBy(slices).agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("sum"))
    every = judged.agg((F.sum("sum") / F.sum("n")).alias("mean")).scalar()
    spread = judged.select("n", "sum", F.explode(_held(len(names), slices)).alias("number"))
    means = spread.groupBy("number").agg(F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("loss"))
    residual = F.coalesce((F.col("loss") - every) / F.nullif(every, F.lit(0.0)), F.lit(0.0))
    return means.select("number", _names(names, "number").alias("slice"), "n", "loss", residual.alias("residual"))


def residual_weights(df: DataFrame, residuals: DataFrame, n_slices: int, slices: str = "slices", out: str = "weight") -> DataFrame:
    """Add to each row the weight to train it with: 1, and the residual of every slice it is in that does worse than all rows.

    ``residuals`` has at most one row per slice and reaches the driver.
    """
    known = {r.number: r.residual for r in residuals.select("number", "residual").collect()}
    table = F.expr(lit.double_array(max(0.0, float(known.get(i, 0.0))) for i in range(n_slices)))
    return df.withColumn(out, F.lit(1.0) + F.aggregate(_held(n_slices, slices), F.lit(0.0), lambda s, i: s + F.get(table, i)))
