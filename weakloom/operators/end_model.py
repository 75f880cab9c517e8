"""Training and evaluating a classifier on soft labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.operators import scan
from weakloom.operators.labeling import CLASSES
from weakloom.session import durable

# Batch size and the id ranges of the two experiments.
BATCH = 50
GOLD_SPLIT = ((0, 800), (800, 1000))
NOISY_SPLIT = ((0, 15000), (0, 1000))


def zero_based(column: Column) -> Column:
    return column - 1


def id_range(df: DataFrame, key: str, bounds: tuple[int, int]) -> DataFrame:
    """Rows with ``bounds[0] <= key < bounds[1]``."""
    return df.where((F.col(key) >= bounds[0]) & (F.col(key) < bounds[1]))


def leading_share(df: DataFrame, key: str, share: float) -> tuple[DataFrame, DataFrame]:
    """``df`` cut in two by the order of a unique key: the first ``share`` of the rows, and the rest.

    Only keys are numbered. The row that a border falls on belongs to the second part.
    """
    numbered = durable(scan.row_keys(df, key, "_position"))
    n = numbered.count()
    first = numbered.select(F.col(key).alias("_key"), (F.col("_position") < F.lit(int(share * n))).alias("_first"))
    marked = df.join(first, F.col(key) == F.col("_key")).drop("_key")
    return marked.where("_first").drop("_first"), marked.where("not _first").drop("_first")


def with_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Features and labels of the same row."""
    return features.join(labels, key)


def batched_mean_loss(df: DataFrame, key: str, loss: str, batch: int = BATCH) -> DataFrame:
    """Mean of the means of consecutive batches in key order; a short last batch counts fully."""
    numbered = scan.row_numbers(df.select(key, loss), key, "_n")
    means = numbered.groupBy(F.floor(F.col("_n") / batch).alias("_batch")).agg(F.avg(loss).alias("_mean"))
    return means.agg(F.avg("_mean").alias(loss))


def weighted_rows(df: DataFrame, features: str, proba: str, flatten: bool = False) -> DataFrame:
    """One row per class with its probability as weight.

    The weighted log-loss of these rows is the soft cross-entropy of the original ones.
    """
    flat = F.flatten(features) if flatten else F.col(features)
    vector = array_to_vector(flat.cast("array<double>"))
    return df.select(vector.alias("features"), F.posexplode(proba).alias("_class", "weight")).where(
        F.col("weight") > 0).select("features", F.col("_class").cast("double").alias("label"), "weight")


def fit_end_model(df: DataFrame, features: str, proba: str, flatten: bool = False, max_iter: int = 50,
                  reg: float = 0.0) -> LogisticRegressionModel:
    """Multinomial logistic regression on soft labels.

    One row per matrix, its values as floats, is written to the shared folder once, so a lost executor re-reads it rather than
    repeating the joins that made it in each of the many passes; the rows per class are made from it by the trainer's reads.
    """
    flat = F.flatten(features) if flatten else F.col(features)
    data = weighted_rows(durable(df.select(flat.cast("array<float>").alias("_flat"), F.col(proba).alias("_proba"))), "_flat", "_proba")
    trainer = LogisticRegression(family="multinomial", weightCol="weight", maxIter=max_iter, regParam=reg,
                                 standardization=True)
    return trainer.fit(data)


def apply_end_model(model: LogisticRegressionModel, df: DataFrame, features: str, classes: Sequence[int] = CLASSES,
                    flatten: bool = False) -> DataFrame:
    """Add ``scores``, ``probability`` and ``predicted`` per row."""
    kept = [c for c in df.columns if c != "features"]
    flat = F.flatten(features) if flatten else F.col(features)
    scored = model.transform(df.select(*[F.col(c) for c in kept], array_to_vector(flat.cast("array<double>")).alias("features")))
    names = F.array(*[F.lit(c) for c in classes])
    # A class above the highest one in training has no score: it gets one that stands for a probability of about zero.
    scores, probability = vector_to_array("rawPrediction"), vector_to_array("probability")
    lacking = F.lit(len(classes)) - F.size(scores)
    return scored.select(*kept, F.concat(scores, F.array_repeat(F.array_min(scores) - 30.0, lacking)).alias("scores"),
                         F.concat(probability, F.array_repeat(F.lit(0.0), lacking)).alias("probability"),
                         F.get(names, F.col("prediction").cast("int")).alias("predicted"))
