"""Rules that depend on each other given the class: finding them, and combining votes without counting them twice.

Spark computes moments of the votes over all rows: of pairs of votes, and of triples for the dependent pairs. What reaches the driver
has a size given by the rules and classes alone.

1. The correlations of the votes are inverted. If rules depend on the class only, what is left between two of them is of rank
   ``classes - 1``; entries that stand out beyond that are direct dependencies.
2. The moments of dependent rules are taken as unknown, and the conditional shares of the votes are those of the low-rank matrix that
   agrees with the moments of the independent pairs (matrix completion).
3. The joint shares of a dependent pair given the class follow from its moments with the rules independent of both. The posterior takes,
   for each pair of a spanning forest, its joint share in place of the product of the two.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.operators import label_model as lm
from weakloom.operators.labeling import CLASSES

#: Weight of the unit matrix in the correlations before they are inverted: copies of one rule would leave no inverse.
RIDGE = 0.02
#: What remains between two rules, of 1, from which they count as dependent, and the plain correlation that is enough by itself.
STANDS_OUT, ALIKE = 0.25, 0.9
#: Rounds of taking the low-rank and the sparse part in turn.
ROUNDS = 30


class Dependency(NamedTuple):
    """Two rules (``left < right``), how much of their relation the class does not explain, and whether the posterior uses the pair."""

    left: int
    right: int
    strength: float
    used: bool


# --- statistics -----------------------------------------------------------------------------------

def vote_covariance(patterns: DataFrame) -> DataFrame:
    """``(rule_i, vote_i, rule_j, vote_j, covariance)`` of the indicators of all votes that occur, i <= j and vote_i <= vote_j on ties."""
    moments = lm.vote_moments(patterns)
    single = moments.where("rule_i = rule_j and vote_i = vote_j").select(
        F.struct(F.col("rule_i").alias("rule"), F.col("vote_i").alias("vote")).alias("x"), "p")
    # At most one row per rule and vote, so all of them fit one row.
    every = single.agg(F.array_sort(F.collect_list(F.struct("x", "p"))).alias("every"))
    first = every.select("every", F.explode("every").alias("a"))
    pairs = first.select("a", F.explode(F.filter("every", lambda b: b["x"] >= F.col("a.x"))).alias("b")).select(
        F.col("a.x.rule").alias("rule_i"), F.col("a.x.vote").alias("vote_i"), F.col("b.x.rule").alias("rule_j"),
        F.col("b.x.vote").alias("vote_j"), (F.col("a.p") * F.col("b.p")).alias("apart"))
    return pairs.join(moments, ["rule_i", "vote_i", "rule_j", "vote_j"], "left").select(
        "rule_i", "vote_i", "rule_j", "vote_j", (F.coalesce("p", F.lit(0.0)) - F.col("apart")).alias("covariance"))


def pair_vote_moments(patterns: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """``(left, right, vote_left, vote_right, rule, vote, p)``: shares of rows where both rules of a pair and a third rule vote.

    The pairs of one vote array and its third votes collapse into partial sums before the shuffle.
    """
    kind = "left int, right int, vote_left int, vote_right int, rule int, vote int, p double"
    if not pairs:
        return patterns.sparkSession.createDataFrame([], kind)
    total = patterns.agg(F.sum("n").alias("total"))
    both = F.filter(F.array(*[F.struct(F.lit(i).alias("left"), F.lit(j).alias("right"), F.get("votes", F.lit(i)).alias("vote_left"),
                                       F.get("votes", F.lit(j)).alias("vote_right")) for i, j in pairs]),
                    lambda x: (x["vote_left"] > 0) & (x["vote_right"] > 0))
    fired = patterns.select("n", "votes", F.explode(both).alias("x"))
    thirds = fired.select("n", "x", F.posexplode("votes").alias("rule", "vote")).where(
        "vote > 0 and rule <> x.left and rule <> x.right")
    return thirds.groupBy("x.left", "x.right", "x.vote_left", "x.vote_right", "rule", "vote").agg((F.sum("n") / total.scalar()).alias("p"))


# --- structure ------------------------------------------------------------------------------------

def _correlations(patterns: DataFrame) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The votes that occur in some but not all rows, as ``(rule, vote)``, and the correlations of their indicators."""
    rows = vote_covariance(patterns).collect()
    variance = {(r.rule_i, r.vote_i): r.covariance for r in rows if (r.rule_i, r.vote_i) == (r.rule_j, r.vote_j)}
    names = sorted(x for x, v in variance.items() if v > 1e-12)
    place = {x: k for k, x in enumerate(names)}
    out = np.eye(len(names))
    for r in rows:
        a, b = (r.rule_i, r.vote_i), (r.rule_j, r.vote_j)
        if a != b and a in place and b in place:
            out[place[a], place[b]] = out[place[b], place[a]] = r.covariance / math.sqrt(variance[a] * variance[b])
    return names, out


def direct_relations(correlations: np.ndarray, blocks: Sequence[int], rank: int, stands_out: float = STANDS_OUT,
                     ridge: float = RIDGE) -> np.ndarray:
    """What remains between two votes given all others, less the low-rank part that a common cause leaves; 0 within a block."""
    n = len(correlations)
    if n < 2:
        return np.zeros((n, n))
    inverse = np.linalg.inv((1 - ridge) * correlations + ridge * np.eye(n))
    scale = np.sqrt(np.diag(inverse))
    partial = -inverse / np.outer(scale, scale)
    apart = np.asarray(blocks)[:, None] != np.asarray(blocks)[None, :]
    low, sparse = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(ROUNDS):
        # Only what is between blocks and not sparse is known of the low-rank part; the rest is filled in by itself.
        known = np.where(apart & (sparse == 0), partial, low)
        values, vectors = np.linalg.eigh((known + known.T) / 2)
        top = np.argsort(-values)[:rank]
        low = (vectors[:, top] * np.maximum(values[top], 0)) @ vectors[:, top].T
        rest = np.where(apart, partial - low, 0.0)
        sparse = np.where(np.abs(rest) > stands_out, rest, 0.0)
    return sparse


def dependencies(patterns: DataFrame, n_rules: int, n_classes: int = len(CLASSES), stands_out: float = STANDS_OUT,
                 alike: float = ALIKE, largest: int | None = None) -> list[Dependency]:
    """Dependent pairs of rules, the strongest first.

    A pair is used if it joins two groups of rules to one of at most ``largest`` rules (half of all if not given): then the used pairs
    are a forest, and enough rules stay independent of each other to tell the classes from.
    """
    names, correlations = _correlations(patterns)
    sparse = direct_relations(correlations, [rule for rule, _ in names], n_classes - 1, stands_out)
    strongest: dict[tuple[int, int], float] = {}
    for a, (i, _) in enumerate(names):
        for b in range(a + 1, len(names)):
            j = names[b][0]
            if i != j:
                found = max(abs(sparse[a, b]), abs(correlations[a, b]) if abs(correlations[a, b]) > alike else 0.0)
                if found > 0:
                    pair = (min(i, j), max(i, j))
                    strongest[pair] = max(found, strongest.get(pair, 0.0))
    largest = max(2, n_rules // 2) if largest is None else largest
    group = list(range(n_rules))
    out = []
    for (i, j), strength in sorted(strongest.items(), key=lambda x: (-round(x[1], 9), x[0])):
        used = group[i] != group[j] and sum(g in (group[i], group[j]) for g in group) <= largest
        if used:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
        out.append(Dependency(i, j, strength, used))
    return out


def groups_of(found: Sequence[Dependency], n_rules: int) -> list[int]:
    """The group of each rule, named by its smallest rule."""
    group = list(range(n_rules))
    for d in found:
        if d.used:
            low, high = sorted((group[d.left], group[d.right]))
            group = [low if g == high else g for g in group]
    return group


# --- the model ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class DependentLabelModel(lm.LabelModel):
    """A label model with dependent pairs: ``pairs`` holds ``(left, right, joint[vote - 1][vote - 1][class index])``."""

    pairs: tuple = ()

    def _score(self, votes: str, y: int):
        """The score of independent rules, and per pair that votes the logarithm of its joint share over the product of both shares."""
        k = len(self.classes)
        terms = []
        for i, j, joint in self.pairs:
            table = [0.0]
            for a in range(k):
                for b in range(k):
                    table.append(math.log(joint[a][b][y]) - math.log(self.given[i][a][y]) - math.log(self.given[j][b][y]))
            vi, vj = f"`{votes}`[{i}]", f"`{votes}`[{j}]"
            terms.append(F.expr(f"get({lit.double_array(table)}, if({vi} > 0 and {vj} > 0, ({vi} - 1) * {k} + {vj}, 0))"))
        score = super()._score(votes, y)
        for term in terms:
            score = score + term
        return score

    def pair_weights(self, spark: SparkSession) -> DataFrame:
        """The joint shares as a table, for storing beside ``weights``."""
        rows = [(i, j, a + 1, b + 1, self.classes[y], float(p)) for i, j, joint in self.pairs for a, row in enumerate(joint)
                for b, cell in enumerate(row) for y, p in enumerate(cell)]
        return spark.createDataFrame(rows, "left int, right int, vote_left int, vote_right int, class int, p double")


def _joint_shares(model: lm.LabelModel, single: np.ndarray, moments: dict, pair: tuple[int, int], group: Sequence[int]) -> tuple:
    """P(both votes | class) of one pair, from its moments with the rules outside its group.

    The unknown share of each class is fitted by least squares, drawn a little towards that of two copies, and lies between nothing and
    the smaller share of the two votes.
    """
    i, j = pair
    k = len(model.classes)
    balance = np.array(model.balance)
    outside = [(r, c) for r in range(len(model.given)) if group[r] != group[i] for c in range(k) if single[r * k + c] > 0]
    design = np.array([balance * np.array(model.given[r][c]) for r, c in outside] + [balance])
    joint = np.empty((k, k, k))
    for a in range(k):
        for b in range(k):
            both = moments.get((i, j, a + 1, b + 1), {})
            most = np.minimum(model.given[i][a], model.given[j][b])
            together = both.get(None, 0.0)
            drawn = most * min(1.0, together / max(float(balance @ most), 1e-12))
            seen = np.array([both.get((r, c + 1), 0.0) for r, c in outside] + [together])
            weight = 0.02 * np.sqrt((design ** 2).sum() / k)
            found = np.linalg.lstsq(np.vstack([design, weight * np.eye(k)]), np.concatenate([seen, weight * drawn]), rcond=None)[0]
            joint[a, b] = np.clip(found, 1e-6, np.maximum(most, 1e-6))
    return lm.frozen(joint)


def fit_dependent_model(patterns: DataFrame, balance: Sequence[float], n_rules: int, classes: Sequence[int] = CLASSES,
                        found: Sequence[Dependency] | None = None, **training) -> DependentLabelModel:
    """The label model fitted on the moments of independent rules, with joint shares of the dependent ones.

    ``patterns`` should be a written table: it is read for the covariances, the moments and the pair moments. ``found`` gives the
    dependencies if they are known.
    """
    k = len(classes)
    found = dependencies(patterns, n_rules, k) if found is None else found
    group = np.array(groups_of(found, n_rules))
    independent = group[:, None] != group[None, :]
    for d in found:
        independent[d.left, d.right] = independent[d.right, d.left] = False
    base = lm.fit_label_model(patterns, balance, n_rules, classes, independent=independent, **training)
    pairs = [(d.left, d.right) for d in found if d.used]
    if not pairs:
        return DependentLabelModel(base.given, base.balance, base.classes)
    slot = {c: i for i, c in enumerate(classes)}
    single, moments = np.zeros(n_rules * k), {}
    for r in lm.vote_moments(patterns).collect():
        if (r.rule_i, r.vote_i) == (r.rule_j, r.vote_j):
            single[r.rule_i * k + slot[r.vote_i]] = r.p
        elif (r.rule_i, r.rule_j) in pairs:
            moments.setdefault((r.rule_i, r.rule_j, slot[r.vote_i] + 1, slot[r.vote_j] + 1), {})[None] = r.p
    for r in pair_vote_moments(patterns, pairs).collect():
        both = moments.setdefault((r.left, r.right, slot[r.vote_left] + 1, slot[r.vote_right] + 1), {})
        both[r["rule"], slot[r.vote] + 1] = r.p
    joint = tuple((i, j, _joint_shares(base, single, moments, (i, j), group)) for i, j in sorted(pairs))
    return DependentLabelModel(base.given, base.balance, base.classes, joint)


# --- storing --------------------------------------------------------------------------------------

def write_model(spark: SparkSession, model: lm.LabelModel, path: str) -> None:
    """The model as three tables under ``path``: ``weights``, ``balance`` and ``pairs``. The folder must not exist."""
    model.weights(spark).write.parquet(f"{path}/weights")
    spark.createDataFrame(list(zip(model.classes, model.balance)), "class int, share double").write.parquet(f"{path}/balance")
    pairs = model if isinstance(model, DependentLabelModel) else DependentLabelModel(model.given, model.balance, model.classes)
    pairs.pair_weights(spark).write.parquet(f"{path}/pairs")


def read_model(spark: SparkSession, path: str) -> lm.LabelModel:
    """A stored model, equal to the one that was written."""
    balance = {r["class"]: r["share"] for r in spark.read.parquet(f"{path}/balance").collect()}
    classes = tuple(sorted(balance))
    base = lm.model_from_table(spark.read.parquet(f"{path}/weights"), [balance[c] for c in classes], classes)
    slot, k = {c: i for i, c in enumerate(classes)}, len(classes)
    joint: dict[tuple[int, int], np.ndarray] = {}
    for r in spark.read.parquet(f"{path}/pairs").collect():
        joint.setdefault((r.left, r.right), np.full((k, k, k), 1e-6))[r.vote_left - 1, r.vote_right - 1, slot[r["class"]]] = r.p
    if not joint:
        return base
    return DependentLabelModel(base.given, base.balance, base.classes, tuple((i, j, lm.frozen(t)) for (i, j), t in sorted(joint.items())))
