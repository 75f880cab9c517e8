"""Statistics of the vote matrix.

Rows with equal votes are counted together first (partially on the map side), so everything
after that runs on vote patterns with a weight, however many rows share one.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.operators.labeling import CLASSES, Rule


def vote_patterns(df: DataFrame, *by: str, votes: str = "votes") -> DataFrame:
    """``(votes, by…, n)``: distinct vote arrays with their row count."""
    return df.groupBy(F.col(votes).alias("votes"), *by).agg(F.count(F.lit(1)).alias("n"))


def _per_rule(patterns: DataFrame, gold: str | None) -> DataFrame:
    cast = F.filter("votes", lambda v: v > 0)
    keep = [gold] if gold else []
    marked = patterns.select("votes", "n", *keep, F.size(cast).alias("n_votes"),
                             F.size(F.array_distinct(cast)).alias("n_labels"))
    return marked.select("n", *keep, "n_votes", "n_labels", F.posexplode("votes").alias("rule_no", "vote"))


def lf_summary(patterns: DataFrame, rules: Sequence[Rule], gold: str | None = None) -> DataFrame:
    """One row per rule: polarity, coverage, overlaps, conflicts and, with gold labels,
    correct and incorrect votes and empirical accuracy."""
    fires = F.col("vote") > 0

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    aggregates = [
        F.array_sort(F.collect_set(F.when(fires, F.col("vote")))).alias("polarity"),
        share(fires).alias("coverage"),
        share(fires & (F.col("n_votes") > 1)).alias("overlaps"),
        share(fires & (F.col("n_labels") > 1)).alias("conflicts"),
    ]
    if gold:
        aggregates += [total(fires & (F.col("vote") == F.col(gold))).alias("correct"),
                       total(fires & (F.col("vote") != F.col(gold))).alias("incorrect")]
    names = F.expr(lit.string_array(r.name for r in rules))
    out = _per_rule(patterns, gold).groupBy("rule_no").agg(*aggregates)
    if gold:
        judged = F.col("correct") + F.col("incorrect")
        out = out.withColumn("accuracy", F.coalesce(F.col("correct") / F.nullif(judged, F.lit(0)), F.lit(0.0)))
    return out.withColumn("rule", F.get(names, F.col("rule_no")))


def label_coverage(patterns: DataFrame) -> DataFrame:
    """Share of rows with at least one vote."""
    voted = F.exists("votes", lambda v: v > 0)
    return patterns.agg((F.sum(F.when(voted, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))


def majority_vote(votes: Column, classes: Sequence[int] = CLASSES) -> Column:
    """Most frequent class among the votes; the lowest class wins a tie, and no vote gives null."""
    def count_of(wanted: int) -> Column:
        return F.size(F.filter(votes, lambda v: v == wanted))

    counts = [count_of(c) for c in classes]
    best = F.greatest(*counts)
    first = functools.reduce(lambda acc, pair: F.when(pair[1] == best, F.lit(pair[0])).otherwise(acc),
                             reversed(list(zip(classes, counts))), F.lit(None).cast("int"))
    return F.when(best > 0, first)


def class_balance(df: DataFrame, gold: str) -> DataFrame:
    """``(class, n, share)`` over the rows with a gold label."""
    counts = df.where(F.col(gold).isNotNull()).groupBy(F.col(gold).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    # One row per class goes through this window.
    return counts.select("class", "n", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


