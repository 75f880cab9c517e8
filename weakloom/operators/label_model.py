"""Combining votes into class probabilities.

Spark computes the statistics over all rows; what reaches the driver is their fixed-size
table, at most ``(rules * classes) ** 2`` numbers. Posteriors are a projection with the model
as literals: no join and no shuffle, so a vote pattern shared by most rows is no hot spot.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.functions.fence import fenced
from weakloom.operators.labeling import CLASSES

# Training settings of the label model.
EPOCHS, LEARNING_RATE, SEED = 2500, 0.001, 42
# Conditional probabilities are kept away from 0 and 1 by this much.
MARGIN = 0.01


def vote_moments(patterns: DataFrame) -> DataFrame:
    """``(rule_i, vote_i, rule_j, vote_j, p)``: shares of rows where both votes are given.

    Only rule pairs with i <= j; i = j gives the share of a single vote. The pairs are those
    of one fixed-length vote array and collapse into as many partial sums before the shuffle.
    """
    total = patterns.agg(F.sum("n").alias("total"))
    cast = F.filter(F.transform("votes", lambda v, i: F.struct(i.alias("rule"), v.alias("vote"))),
                    lambda x: x["vote"] > 0)
    listed = patterns.select("n", cast.alias("_cast"))
    left = listed.select("n", "_cast", F.explode("_cast").alias("_i"))
    pairs = left.select("n", "_i", F.explode(F.filter("_cast", lambda x: x["rule"] >= F.col("_i.rule"))).alias("_j"))
    return pairs.groupBy(
        F.col("_i.rule").alias("rule_i"), F.col("_i.vote").alias("vote_i"),
        F.col("_j.rule").alias("rule_j"), F.col("_j.vote").alias("vote_j"),
    ).agg((F.sum("n") / total.scalar()).alias("p"))


def vote_conditionals(patterns: DataFrame, gold: str, n_rules: int, classes: Sequence[int] = CLASSES,
                      smoothing: float = 1.0) -> DataFrame:
    """``(rule_no, vote, class, p)``: P(vote | class) from gold rows, Laplace-smoothed.

    Every combination is present, abstention (0) included.
    """
    rows = patterns.where(F.col(gold).isin(*classes))
    counts = rows.select("n", F.col(gold).alias("class"), F.posexplode("votes").alias("rule_no", "vote")).groupBy(
        "rule_no", "vote", "class").agg(F.sum("n").alias("n"))
    sizes = rows.groupBy(F.col(gold).alias("class")).agg(F.sum("n").alias("n_class"))
    spark = patterns.sparkSession
    values = [0, *classes]
    grid = (spark.range(n_rules).select(F.col("id").cast("int").alias("rule_no"))
            .select("rule_no", F.explode(F.array(*[F.lit(v) for v in values])).alias("vote"))
            .select("rule_no", "vote", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")))
    return (grid.join(counts, ["rule_no", "vote", "class"], "left").join(sizes, "class", "left").select(
        "rule_no", "vote", "class",
        ((F.coalesce("n", F.lit(0)) + smoothing)
         / (F.coalesce("n_class", F.lit(0)) + smoothing * len(values))).alias("p")))


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) per rule and the class balance; ``given[rule][vote - 1][class index]``."""

    given: tuple
    balance: tuple
    classes: tuple = CLASSES

    def _score(self, votes: str, y: int) -> Column:
        """Log of the class share plus, per rule, the log-probability of its vote."""
        logs = [[0.0, *[math.log(row[y]) for row in table]] for table in self.given]
        terms = [f"{math.log(self.balance[y])!r}D"]
        terms += [f"get({lit.double_array(row)}, `{votes}`[{j}])" for j, row in enumerate(logs)]
        return F.expr(" + ".join(terms))

    def with_posterior(self, df: DataFrame, votes: str = "votes", out: str = "proba") -> DataFrame:
        """Add ``ARRAY<DOUBLE>`` of class probabilities; abstaining rules say nothing."""
        kept = [c for c in df.columns if c != out]
        names = [f"_score_{y}" for y in range(len(self.classes))]
        scored = df.select(*kept, *[self._score(votes, y).alias(n) for y, n in enumerate(names)])
        weighted = scored.select(*kept, *[F.exp(F.col(n) - F.greatest(*names)).alias(n) for n in names])
        total = functools.reduce(operator.add, [F.col(n) for n in names])
        return fenced(weighted, kept, {out: F.array(*[F.col(n) / total for n in names])})

    def predict(self, proba: Column) -> Column:
        return predicted_class(proba, self.classes)

    def weights(self, spark) -> DataFrame:
        """The model as a table, for storing."""
        rows = [(j, v + 1, self.classes[y], float(p)) for j, table in enumerate(self.given)
                for v, row in enumerate(table) for y, p in enumerate(row)]
        return spark.createDataFrame(rows, "rule_no int, vote int, class int, p double")


def model_from_table(weights: DataFrame, balance: Sequence[float], classes: Sequence[int] = CLASSES) -> LabelModel:
    """The model stored as ``weights``; a vote or class the table lacks counts as next to impossible."""
    slot, rows = {c: i for i, c in enumerate(classes)}, weights.collect()
    given = np.full((max((r.rule_no for r in rows), default=-1) + 1, len(classes), len(classes)), MARGIN)
    for r in rows:
        given[r.rule_no, r.vote - 1, slot[r["class"]]] = r.p
    return LabelModel(frozen(given), tuple(balance), tuple(classes))


def predicted_class(proba: Column, classes: Sequence[int] = CLASSES) -> Column:
    """Most probable class; the lowest class wins a tie."""
    best = F.array_max(proba)
    return F.get(F.array(*[F.lit(c) for c in classes]), (F.array_position(proba, best) - 1).cast("int"))


def supervised_model(patterns: DataFrame, gold: str, n_rules: int, classes: Sequence[int] = CLASSES,
                     smoothing: float = 1.0) -> LabelModel:
    """Closed-form model from gold rows."""
    table = vote_conditionals(patterns, gold, n_rules, classes, smoothing).collect()
    slot = {c: i for i, c in enumerate(classes)}
    given = np.zeros((n_rules, len(classes), len(classes)))
    for r in table:
        if r.vote > 0:
            given[r.rule_no, slot[r.vote], slot[r["class"]]] = r.p
    return LabelModel(frozen(given), balance_of(patterns, gold, classes), tuple(classes))


def balance_of(patterns: DataFrame, gold: str, classes: Sequence[int] = CLASSES) -> tuple:
    """Class shares among the gold rows of the patterns."""
    rows = patterns.where(F.col(gold).isin(*classes)).groupBy(gold).agg(F.sum("n").alias("n")).collect()
    counts = {r[gold]: r["n"] for r in rows}
    if not counts:
        raise ValueError("no gold labels to take the class balance from")
    total = sum(counts.values())
    return tuple(max(counts.get(c, 0) / total, 1e-9) for c in classes)


def fit_label_model(patterns: DataFrame, balance: Sequence[float], n_rules: int,
                    classes: Sequence[int] = CLASSES, epochs: int = EPOCHS,
                    learning_rate: float = LEARNING_RATE, seed: int = SEED,
                    start_precision: float = 0.7, independent: np.ndarray | None = None) -> LabelModel:
    """Match the second moments of the votes, without gold labels for single rows.

    ``independent`` says for each pair of rules whether its moments are used (all pairs, if not given); others are taken as unknown.

    For rules that are independent given the class, E[votes votes^T] off the per-rule blocks
    equals ``mu diag(balance) mu^T``, and the single-vote shares equal ``mu balance``. Both are
    fitted by gradient descent on the driver; the problem has ``rules * classes`` rows whatever
    the number of labelled texts.
    """
    k = len(classes)
    slot = {c: i for i, c in enumerate(classes)}
    size = n_rules * k
    moments = np.zeros((size, size))
    for r in vote_moments(patterns).collect():
        a, b = r.rule_i * k + slot[r.vote_i], r.rule_j * k + slot[r.vote_j]
        moments[a, b] = moments[b, a] = r.p
    single = np.diag(moments).copy()
    apart = ~np.eye(n_rules, dtype=bool) if independent is None else independent & ~np.eye(n_rules, dtype=bool)
    other_rule = np.kron(apart, np.ones((k, k)))
    p = np.asarray(balance, dtype=float)

    own = np.tile(np.eye(k), (n_rules, 1))
    share = own * start_precision + (1 - own) * (1 - start_precision) / max(k - 1, 1)
    mu = np.clip(single[:, None] * share / p[None, :], 0.0, 1.0)
    mu = mu * (1 + 0.01 * np.random.default_rng(seed).standard_normal(mu.shape))
    velocity = np.zeros_like(mu)
    for _ in range(epochs):
        residual = other_rule * (moments - (mu * p) @ mu.T)
        grad = -4.0 * residual @ (mu * p) + 2.0 * np.outer(mu @ p - single, p)
        velocity = 0.9 * velocity - learning_rate * grad
        mu = mu + velocity
    # The descent weighs many pairs against each single share; the shares themselves are known, so they are met in the end.
    mu = np.clip(mu, MARGIN, 1 - MARGIN)
    low, high = np.zeros(size), np.full(size, 1 / MARGIN)
    for _ in range(60):
        middle = (low + high) / 2
        over = np.clip(mu * middle[:, None], MARGIN, 1 - MARGIN) @ p > single
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    mu = np.clip(mu * low[:, None], MARGIN, 1 - MARGIN)
    return LabelModel(frozen(mu.reshape(n_rules, k, k)), tuple(float(x) for x in p), tuple(classes))


def frozen(given: np.ndarray) -> tuple:
    return tuple(tuple(tuple(float(x) for x in row) for row in table) for table in given)
