"""Dependent rules: planted copies and nested rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakloom.operators import label_model as lm
from weakloom.operators import lf_stats
from weakloom.operators import rule_structure as rs

ACCURACY = [0.55, 0.8, 0.75, 0.85, 0.7, 0.8, 0.75]
BALANCE = (0.4, 0.25, 0.35)


def votes_of(rng, gold):
    """Seven independent rules; rule 0 is copied four times, once with noise, and rule 1 has a stricter twin."""
    votes = []
    for a in ACCURACY:
        vote = 0 if rng.random() < 0.25 else gold if rng.random() < a else int(rng.choice([c for c in (1, 2, 3) if c != gold]))
        votes.append(vote)
    noisy = votes[0] if rng.random() < 0.9 else 0
    strict = votes[1] if rng.random() < 0.6 else 0
    return [*votes, votes[0], votes[0], votes[0], noisy, strict]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    gold = rng.choice([1, 2, 3], size=8000, p=BALANCE)
    rows = [(i, int(y), votes_of(rng, int(y))) for i, y in enumerate(gold)]
    return spark.createDataFrame(rows, "id int, class int, votes array<int>").cache()


def accuracy_of(model, frame):
    scored = model.with_posterior(frame)
    return scored.select(F.avg((model.predict(F.col("proba")) == F.col("class")).cast("double"))).first()[0]


def shares(model, rule):
    return np.array(model.given[rule])


def test_structure(planted):
    found = rs.dependencies(lf_stats.vote_patterns(planted), 12)
    assert {(d.left, d.right) for d in found} <= {(a, b) for a in (0, 7, 8, 9, 10) for b in (0, 7, 8, 9, 10)} | {(1, 11)}
    used = [(d.left, d.right) for d in found if d.used]
    assert (1, 11) in used and len(used) >= 4
    groups = rs.groups_of(found, 12)
    assert groups[11] == 1 and len({groups[r] for r in (0, 7, 8, 9)}) == 1 and len({groups[r] for r in range(1, 7)}) == 6


def test_copies_do_not_count_twice(planted):
    """Accuracies come out as planted, and four copies of a poor rule do not outvote better ones."""
    patterns = lf_stats.vote_patterns(planted).cache()
    known = [rs.Dependency(0, c, 1.0, True) for c in (7, 8, 9, 10)] + [rs.Dependency(1, 11, 1.0, True)]
    for found in (None, known):
        model = rs.fit_dependent_model(patterns, BALANCE, 12, found=found)
        for rule, accuracy in enumerate(ACCURACY):
            table = shares(model, rule)
            assert np.abs(np.diag(table) - 0.75 * accuracy).max() < 0.06, rule
        naive = lm.fit_label_model(patterns, BALANCE, 12)
        assert accuracy_of(model, planted) > accuracy_of(naive, planted) + 0.02
    independent = lm.supervised_model(lf_stats.vote_patterns(
        planted.withColumn("votes", F.slice("votes", 1, 7)), "class"), "class", 7)
    best = accuracy_of(independent, planted.withColumn("votes", F.slice("votes", 1, 7)))
    assert accuracy_of(model, planted) > best - 0.02


def test_exact_copy_cancels(spark, planted):
    """A pair whose joint share is that of either rule adds nothing to the posterior of one rule."""
    plain = lm.supervised_model(lf_stats.vote_patterns(planted.withColumn("votes", F.slice("votes", 1, 7)), "class"), "class", 7)
    copied = lm.LabelModel((*plain.given, plain.given[0]), plain.balance)
    k = range(3)
    joint = tuple(tuple(tuple(plain.given[0][a][y] if a == b else 1e-6 for y in k) for b in k) for a in k)
    model = rs.DependentLabelModel(copied.given, copied.balance, copied.classes, ((0, 7, joint),))
    frame = planted.select("id", F.slice("votes", 1, 8).alias("votes"))
    ours = {r.id: r.proba for r in model.with_posterior(frame).collect()}
    theirs = {r.id: r.proba for r in plain.with_posterior(frame.withColumn("votes", F.slice("votes", 1, 7))).collect()}
    assert np.allclose([ours[i] for i in sorted(ours)], [theirs[i] for i in sorted(ours)])


def test_statistics(spark, planted):
    """Covariances and pair moments against numpy."""
    patterns = lf_stats.vote_patterns(planted)
    votes = np.array([r.votes for r in planted.collect()])
    for r in rs.vote_covariance(patterns).collect():
        a, b = votes[:, r.rule_i] == r.vote_i, votes[:, r.rule_j] == r.vote_j
        assert abs((a & b).mean() - a.mean() * b.mean() - r.covariance) < 1e-12
    found = rs.pair_vote_moments(patterns, [(0, 7), (2, 5)]).collect()
    for r in found:
        mask = (votes[:, r.left] == r.vote_left) & (votes[:, r.right] == r.vote_right) & (votes[:, r["rule"]] == r.vote)
        assert abs(mask.mean() - r.p) < 1e-12
    assert len({(r.left, r.right) for r in found}) == 2 and all(r["rule"] not in (r.left, r.right) for r in found)
    assert rs.pair_vote_moments(patterns, []).count() == 0


def test_store(spark, planted, tmp_path):
    patterns = lf_stats.vote_patterns(planted).cache()
    for i, model in enumerate((rs.fit_dependent_model(patterns, BALANCE, 12), lm.fit_label_model(patterns, BALANCE, 12))):
        rs.write_model(spark, model, str(tmp_path / str(i)))
        assert rs.read_model(spark, str(tmp_path / str(i))) == model


def test_odd_patterns(spark):
    """Rules that never vote, always vote, or are alone; no rows at all."""
    empty = spark.createDataFrame([], "votes array<int>, n bigint")
    assert rs.dependencies(empty, 3) == []
    rows = [([0, 1, 1], 5), ([0, 1, 0], 5), ([0, 1, 2], 3)]
    patterns = spark.createDataFrame(rows, "votes array<int>, n bigint")
    assert [d for d in rs.dependencies(patterns, 3) if d.used and 0 in (d.left, d.right)] == []
    model = rs.fit_dependent_model(patterns, (0.5, 0.25, 0.25), 3)
    assert all(abs(sum(r.proba) - 1) < 1e-9 for r in model.with_posterior(patterns).collect())
    assert rs.dependencies(spark.createDataFrame([([1],), ([0],)], "votes array<int>").withColumn("n", F.lit(1)), 1) == []
