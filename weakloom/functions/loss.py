"""Cross-entropy on soft and hard targets."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCTIONS = ("none", "mean", "sum")


def soft_cross_entropy(logits: Column, targets: Column, k: int, weights: Sequence[float] | None = None) -> Column:
    """Sum over classes of target * weight * (logsumexp(logits) - logit).

    The largest logit is subtracted before exponentiation.
    """
    weights = [1.0] * k if weights is None else list(weights)
    if len(weights) != k:
        raise ValueError(f"expected {k} class weights, got {len(weights)}")
    z = [F.get(logits, F.lit(y)).cast("double") for y in range(k)]
    t = [F.get(targets, F.lit(y)).cast("double") for y in range(k)]
    top = F.greatest(*z)
    log_sum = top + F.log(functools.reduce(operator.add, [F.exp(x - top) for x in z]))
    return functools.reduce(operator.add, [t[y] * weights[y] * (log_sum - z[y]) for y in range(k)])


def one_hot(label: Column, k: int) -> Column:
    """0-based label as a target distribution."""
    return F.array(*[(label == y).cast("double") for y in range(k)])


def hard_cross_entropy(logits: Column, label: Column, k: int) -> Column:
    """Cross-entropy against one 0-based label per row."""
    return soft_cross_entropy(logits, one_hot(label, k), k)


def reduce_loss(df: DataFrame, loss: str, reduction: str = "mean") -> DataFrame:
    """``none`` keeps the rows; ``mean`` divides by the row count, whatever the weights."""
    if reduction not in REDUCTIONS:
        raise ValueError(f"reduction must be one of {', '.join(REDUCTIONS)}, not {reduction}")
    if reduction == "none":
        return df
    return df.agg((F.avg if reduction == "mean" else F.sum)(loss).alias(loss))
