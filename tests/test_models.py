import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakloom.functions import loss
from weakloom.operators import end_model as em
from weakloom.operators import evaluation as ev
from weakloom.operators import features as ft
from weakloom.operators import label_model as lm
from weakloom.operators import lf_stats
from weakloom.plans import training


@pytest.fixture(scope="module")
def planted(spark):
    """Votes of seven independent rules of known accuracy on rows of known class."""
    rng = np.random.default_rng(3)
    accuracy = [0.9, 0.85, 0.6, 0.55, 0.55, 0.5, 0.8]
    gold = rng.choice([1, 2, 3], size=6000, p=[0.5, 0.2, 0.3])
    rows = []
    for i, y in enumerate(gold):
        votes = []
        for a in accuracy:
            if rng.random() < 0.3:
                votes.append(0)
            elif rng.random() < a:
                votes.append(int(y))
            else:
                votes.append(int(rng.choice([c for c in (1, 2, 3) if c != y])))
        rows.append((i, int(y), votes))
    return spark.createDataFrame(rows, "id int, class int, votes array<int>").cache()


def accuracy_of(frame):
    return frame.select(F.avg((F.col("predicted") == F.col("class")).cast("double"))).first()[0]


def test_label_model_beats_majority(planted):
    patterns = lf_stats.vote_patterns(planted)
    balance = lm.balance_of(lf_stats.vote_patterns(planted, "class"), "class")
    model = lm.fit_label_model(patterns, balance, 7)
    scored = model.with_posterior(planted)
    sums = scored.select(F.abs(F.aggregate("proba", F.lit(0.0), lambda s, x: s + x) - 1).alias("d")).agg(F.max("d")).first()[0]
    assert sums < 1e-9
    fitted = accuracy_of(scored.withColumn("predicted", model.predict(F.col("proba"))))
    majority = accuracy_of(planted.withColumn("predicted", lf_stats.majority_vote(F.col("votes"))))
    assert fitted > majority
    assert abs(model.given[0][0][0] - 0.63) < 0.08
    again = lm.fit_label_model(patterns, balance, 7)
    assert again == model


def test_supervised_model(planted):
    patterns = lf_stats.vote_patterns(planted, "class")
    model = lm.supervised_model(patterns, "class", 7)
    assert abs(model.given[0][1][1] - 0.63) < 0.04
    predicted = model.with_posterior(planted).withColumn("predicted", model.predict(F.col("proba")))
    assert accuracy_of(predicted) > 0.85
    assert model.weights(planted.sparkSession).count() == 63
    with pytest.raises(ValueError):
        lm.balance_of(patterns.where("class = 9"), "class")


def test_majority_ties_take_the_lowest_class(spark):
    frame = spark.createDataFrame([([0, 3, 2],), ([3, 3, 2],), ([0, 0, 0],)], "votes array<int>")
    assert [r.p for r in frame.select(lf_stats.majority_vote(F.col("votes")).alias("p")).collect()] == [2, 3, None]


def test_scores_by_hand(spark):
    frame = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 1), (None, 1)], "gold int, pred int")
    got = {r["class"]: r for r in ev.class_scores(ev.confusion(frame, "gold", "pred")).collect()}
    assert (got[1].precision, got[1].recall, got[1].f1) == (0.5, 0.5, 0.5)
    assert got[3].f1 == 0.0 and got[2].recall == 1.0 and got[1].accuracy == 0.5


def test_losses(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0, 700.0], [0.0, 1.0, 0.0], 1)], "id int, z array<double>, t array<double>, y int")
    row = frame.select(loss.soft_cross_entropy(F.col("z"), F.col("t"), 3).alias("s"),
                       loss.hard_cross_entropy(F.col("z"), F.col("y"), 3).alias("h")).first()
    assert row.s == row.h == pytest.approx(698.0)
    with pytest.raises(ValueError):
        loss.reduce_loss(frame, "id", "other")
    with pytest.raises(ValueError):
        loss.soft_cross_entropy(F.col("z"), F.col("t"), 3, [1.0])
    many = spark.range(101).select(F.col("id"), F.col("id").cast("double").alias("loss"))
    want = np.mean([np.mean(range(50)), np.mean(range(50, 100)), 100.0])
    assert em.batched_mean_loss(many, "id", "loss").first().loss == pytest.approx(want)


def test_noise_aware_training(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        y = int(rng.integers(3))
        x = [float(v) for v in rng.normal(size=4) + np.eye(3, 4)[y] * 3]
        soft = np.full(3, 0.1)
        soft[y if rng.random() > 0.15 else int(rng.integers(3))] = 0.8
        rows.append((i, x, [float(v) for v in soft], y + 1))
    data = spark.createDataFrame(rows, "id int, features array<double>, proba array<double>, class int")
    predictions, scores = training.train_and_score(data.where("id < 500"), data.where("id >= 500"), "id", max_iter=25)
    assert scores.first().accuracy > 0.8
    assert predictions.agg(F.avg("loss")).first()[0] < math.log(3)


def test_experiments_keep_rows_apart(spark, planted):
    """No row a model is judged on is among those it learned from, and both beat answering the class balance."""
    vectors = planted.where("id < 2000").select(
        "id", "votes", F.when(F.col("id") % 4 == 0, F.col("class")).alias("class"), F.col("class").alias("_true")).withColumn(
        "features", F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: (F.when(i == F.col("_true"), 2.0).otherwise(0.0)
                                                                          + F.rand(3)).cast("float"))).drop("_true").cache()
    baseline = training.gold_experiment(vectors, "id", max_iter=20, reg=0.01)
    noisy, model = training.noisy_experiment(vectors, "id", 7, max_iter=20, reg=0.01)
    assert (baseline.train.count(), baseline.predictions.count()) == (400, 100)
    assert baseline.train.agg(F.max("id")).first()[0] < baseline.predictions.agg(F.min("id")).first()[0]
    assert (noisy.train.count(), noisy.predictions.count()) == (1500, 500)
    for done in (baseline, noisy):
        assert done.train.join(done.predictions, "id").count() == 0
        assert done.scores.first().accuracy > 0.8
        guess = training.balance_loss(done.train, done.predictions).first().loss
        assert done.validation_loss.first().loss < guess < 2
    assert noisy.train.agg(F.count("class")).first()[0] == 0 and "proba" in noisy.train.columns
    assert len(model.given) == 7


def test_leading_share(spark):
    frame = spark.createDataFrame([(i * 7 % 11, "x") for i in range(11)], "k int, _x string")
    for share, n in ((0.8, 8), (0.0, 0), (1.0, 11)):
        first, rest = em.leading_share(frame, "k", share)
        assert sorted(r.k for r in first.collect()) == list(range(n)) and rest.count() == 11 - n
        assert first.columns == frame.columns


def test_features(spark):
    docs = spark.createDataFrame([(1, "Red blue  red"), (2, None), (3, "w " * 60)], "id int, text string")
    table = spark.createDataFrame([("red", [1.0, 2.0]), ("w", [3.0, 3.0])], "token string, vector array<float>")
    small = {r.id: r.features for r in ft.encode_by_lookup(docs, "id", "text", table, 2).collect()}
    assert all(len(f) == 50 for f in small.values())
    assert small[1][:4] == [[1.0, 2.0], [0.0, 0.0], [1.0, 2.0], [0.0, 0.0]]
    assert small[2] == [[0.0, 0.0]] * 50 and small[3] == [[3.0, 3.0]] * 50
    limit, ft.TABLE_BYTES = ft.TABLE_BYTES, 1
    try:
        salted = {r.id: r.features for r in ft.encode_by_lookup(docs, "id", "text", table, 2).collect()}
    finally:
        ft.TABLE_BYTES = limit
    assert salted == small
    plan = ft.encode_by_lookup(docs, "id", "text", table, 2)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan
    empty = ft.encode_by_lookup(docs, "id", "text", table.where("false"), 2).collect()
    assert len(empty) == 3 and all(r.features == [[0.0, 0.0]] * 50 for r in empty)
    model = {r.id: r.features for r in ft.encode_by_model(
        docs, "id", "text", lambda ts: [np.ones((len(t.split(" ")), 2)) for t in ts], 2).collect()}
    assert sum(map(sum, model[1])) == 8.0 and len(model[3]) == 50
