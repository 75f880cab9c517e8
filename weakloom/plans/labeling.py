"""From paragraphs to class probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.functions import lexicons
from weakloom.operators import label_model as lm
from weakloom.operators import labeling as lb
from weakloom.operators import lf_stats
from weakloom.operators import retrieval
from weakloom.operators import rule_structure as rs
from weakloom.session import durable


@dataclass(frozen=True)
class FittedLabels:
    """What fitting on the gold table gives; ``apply`` labels any other table."""

    rules: Sequence[lb.Rule]
    lexicon: lb.Lexicon
    model: lm.LabelModel
    summary: DataFrame

    def apply(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` plus ``votes``, ``proba`` and ``predicted``; a projection without a shuffle."""
        return self.apply_votes(lb.vote_matrix(df, text, self.rules, self.lexicon))

    def apply_votes(self, voted: DataFrame) -> DataFrame:
        """As ``apply``, where the votes have been made already."""
        scored = self.model.with_posterior(voted)
        return scored.withColumn("predicted", self.model.predict(F.col("proba")))


def fit_labels(gold: DataFrame, text: str = "sentences", label: str = "class",
               rules: Sequence[lb.Rule] | None = None, groups: Mapping[str, Sequence[str]] | None = None,
               stem: bool = True) -> FittedLabels:
    """Votes on the gold table, their summary and the label model.

    Missing gold classes count as neutral. The lexicon depends on the phrase lists alone, so the result labels any table.
    """
    rules = rules or lb.default_rules()
    lexicon = lexicon_of(gold.sparkSession, groups, stem)
    return fit_votes(lb.vote_matrix(gold, text, rules, lexicon).select(label, "votes"), label, rules, lexicon)


def lexicon_of(spark: SparkSession, groups: Mapping[str, Sequence[str]] | None = None, stem: bool = True) -> lb.Lexicon:
    groups = groups or lexicons.POLICY
    return lb.stemmed_lexicon(spark, groups) if stem else lb.plain_lexicon(groups)


def fit_votes(voted: DataFrame, label: str, rules: Sequence[lb.Rule], lexicon: lb.Lexicon, dependent: bool = False) -> FittedLabels:
    """As ``fit_labels``, from votes that have been made already; ``dependent`` looks for rules that depend on each other."""
    labelled = voted.withColumn(label, retrieval.default_class(F.col(label)))
    # The votes are read once; everything below runs on the distinct vote arrays.
    patterns = durable(lf_stats.vote_patterns(labelled, label))
    fit = rs.fit_dependent_model if dependent else lm.fit_label_model
    model = fit(patterns, lm.balance_of(patterns, label), len(rules))
    return FittedLabels(rules, lexicon, model, lf_stats.lf_summary(patterns, rules, label))
