"""From features and probabilities to an evaluated classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.functions import loss
from weakloom.operators import end_model as em
from weakloom.operators import evaluation, lf_stats
from weakloom.operators import label_model as lm
from weakloom.operators import rule_structure as rs
from weakloom.operators.labeling import CLASSES
from weakloom.session import durable

# Share of the gold rows the baseline is trained on: 800 of 1000.
TRAIN_SHARE = 0.8


def train_and_score(train: DataFrame, validation: DataFrame, key: str, features: str = "features",
                    proba: str = "proba", label: str = "class", max_iter: int = 50, reg: float = 0.0,
                    flatten: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(predictions, scores)`` on the validation rows of a model trained on soft labels.

    The predictions carry the hard cross-entropy of each row as ``loss``.
    """
    model = em.fit_end_model(train, features, proba, flatten, max_iter, reg)
    applied = em.apply_end_model(model, validation, features, flatten=flatten)
    predictions = applied.withColumn(
        "loss", loss.hard_cross_entropy(F.col("scores"), em.zero_based(F.col(label)), len(CLASSES)))
    return predictions, evaluation.class_scores(evaluation.confusion(predictions, label, "predicted"))


@dataclass(frozen=True)
class Experiment:
    """Rows a classifier was trained on, its predictions on rows it has not seen, their scores, and their loss in batches."""

    train: DataFrame
    predictions: DataFrame
    scores: DataFrame
    validation_loss: DataFrame


def _experiment(train: DataFrame, validation: DataFrame, key: str, label: str, max_iter: int, reg: float) -> Experiment:
    train = durable(train)
    predictions, scores = train_and_score(train, validation, key, label=label, max_iter=max_iter, reg=reg)
    predictions = durable(predictions)
    return Experiment(train, predictions, scores, em.batched_mean_loss(predictions, key, "loss"))


def gold_experiment(rows: DataFrame, key: str, label: str = "class", share: float = TRAIN_SHARE, max_iter: int = 50,
                    reg: float = 0.0) -> Experiment:
    """The baseline: trained on the first share of the gold rows in key order, judged on the rest.

    ``rows`` hold a unique key, ``features`` and a class; rows without a class take no part.
    """
    gold = rows.where(F.col(label).isNotNull())
    train, validation = em.leading_share(gold, key, share)
    hard = loss.one_hot(em.zero_based(F.col(label)), len(CLASSES))
    return _experiment(train.withColumn("proba", hard), validation, key, label, max_iter, reg)


def noisy_experiment(rows: DataFrame, key: str, n_rules: int, label: str = "class", share: float = TRAIN_SHARE, dependent: bool = True,
                     max_iter: int = 50, reg: float = 0.0) -> tuple[Experiment, lm.LabelModel]:
    """Trained on what the label model says of the rows without a class, judged on all rows with one.

    ``rows`` hold a unique key, ``features``, ``votes`` and a class or null. The label model learns from the votes of the rows without a class;
    from the gold rows it takes the class balance alone, of the first share, as the baseline does.
    """
    gold, unlabelled = rows.where(F.col(label).isNotNull()), rows.where(F.col(label).isNull())
    known, _ = em.leading_share(gold.select(key, "votes", label), key, share)
    balance = lm.balance_of(lf_stats.vote_patterns(known, label), label)
    patterns = durable(lf_stats.vote_patterns(unlabelled))
    fit = rs.fit_dependent_model if dependent else lm.fit_label_model
    model = fit(patterns, balance, n_rules)
    return _experiment(model.with_posterior(unlabelled), gold, key, label, max_iter, reg), model


def balance_loss(train: DataFrame, validation: DataFrame, label: str = "class", proba: str = "proba",
                 classes: Sequence[int] = CLASSES) -> DataFrame:
    """The mean loss on ``validation`` of always answering the mean of the training probabilities: what a model has to beat."""
    shares = train.agg(*[F.avg(F.get(proba, F.lit(i))).alias(f"p{i}") for i in range(len(classes))])
    guess = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), shares.select(f"p{i}").scalar())])
    return validation.agg(F.avg(-F.log(F.greatest(F.element_at(guess, F.col(label)), F.lit(1e-12)))).alias("loss"))
