"""Hidden states against a plain forward-backward."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weakloom.operators import hmm
from weakloom.plans import queries

MODEL = hmm.HiddenStates((0.6, 0.3, 0.1), ((0.7, 0.2, 0.1), (0.1, 0.8, 0.1), (0.3, 0.3, 0.4)),
                         ((0.5, 0.3, 0.1, 0.1), (0.1, 0.1, 0.4, 0.4), (0.25, 0.25, 0.25, 0.25)))


def forward_backward(model, symbols):
    """Posteriors, expected steps and log-likelihood of one sequence."""
    start, step, emit = (np.array(x) for x in (model.start, model.step, model.emit))
    seen = [emit[:, s] if s is not None and 0 <= s < emit.shape[1] else np.ones(len(start)) for s in symbols]
    alpha, logs = [], 0.0
    for t, b in enumerate(seen):
        now = (start if t == 0 else alpha[-1] @ step) * b
        logs += math.log(now.sum())
        alpha.append(now / now.sum())
    beta = [np.ones(len(start))]
    for b in reversed(seen[1:]):
        now = step @ (b * beta[0])
        beta.insert(0, now / now.sum())
    gamma = [a * b / (a @ b) for a, b in zip(alpha, beta)]
    steps = np.zeros(step.shape)
    for t in range(1, len(seen)):
        both = alpha[t - 1][:, None] * step * (seen[t] * beta[t])[None, :]
        steps += both / both.sum()
    return gamma, steps, logs


def drawn(pick, model, n):
    state = pick.choices(range(model.n_states), model.start)[0]
    for _ in range(n):
        yield pick.choices(range(model.n_symbols), model.emit[state])[0]
        state = pick.choices(range(model.n_states), model.step[state])[0]


def sequences():
    pick = random.Random(1)
    out = {doc: list(drawn(pick, MODEL, n)) for doc, n in enumerate([1, 2, 7, 8, 9, 16, 17, 40, 333, 1000])}
    out[None] = list(drawn(pick, MODEL, 30))
    out[20] = [None, 3, 99, -1, 0] * 5
    return out


def table_of(spark, docs, gap=1):
    rows = [(doc, i * gap - 5, s) for doc, symbols in docs.items() for i, s in enumerate(symbols)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id bigint, para_id bigint, symbol int").repartition(3)


@pytest.mark.parametrize("chunk, group, gap", [(8, 4, 1), (8, 1000, 3), (2000, 4096, 1), (1, 7, 1)])
def test_posteriors_and_counts(spark, chunk, group, gap):
    docs = sequences()
    if chunk == 1:
        docs = {k: v[:100] for k, v in docs.items()}
    chunks = hmm.chunked(table_of(spark, docs, gap), "doc_id", "para_id", "symbol", chunk)
    found = {(r.doc, r.place): r.proba for r in hmm.state_posteriors(chunks, MODEL, group).collect()}
    plain = {doc: forward_backward(MODEL, symbols) for doc, symbols in docs.items()}
    assert set(found) == {(doc, i * gap - 5) for doc, symbols in docs.items() for i in range(len(symbols))}
    for doc, (gamma, _, _) in plain.items():
        assert np.allclose([found[doc, i * gap - 5] for i in range(len(gamma))], gamma, atol=1e-9)
    starts, steps, emitted, total = hmm.expected_counts(chunks, MODEL, group)
    assert np.allclose(starts, sum(g[0] for g, _, _ in plain.values()))
    assert np.allclose(steps, sum(s for _, s, _ in plain.values()))
    assert math.isclose(total, sum(x for _, _, x in plain.values()), rel_tol=1e-9)
    for symbol in range(4):
        wanted = sum(g for doc, (gamma, _, _) in plain.items() for g, s in zip(gamma, docs[doc]) if s == symbol)
        assert np.allclose(emitted[:, symbol], wanted)


def test_long_document_is_spread(spark):
    """One document of 30,000 paragraphs: chunks are dealt to all tasks, none holds more than its chunk."""
    one = spark.range(30000).select(F.lit(1).alias("doc_id"), F.col("id").alias("para_id"), (F.xxhash64("id") % 4).cast("int").alias("symbol"))
    chunks = hmm.chunked(one.withColumn("symbol", F.abs("symbol")), "doc_id", "para_id", "symbol", 64)
    assert chunks.count() == 469 and chunks.agg(F.max(F.size("symbols"))).first()[0] == 64
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    surrounded = hmm.with_surroundings(chunks, MODEL, group=16).withColumn("task", F.spark_partition_id())
    assert surrounded.select("task").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = hmm.state_posteriors(chunks, MODEL, group=16).orderBy("place").collect()
    symbols = [s for r in chunks.orderBy("chunk").collect() for s in r.symbols]
    gamma, _, _ = forward_backward(MODEL, symbols)
    assert np.allclose([r.proba for r in found], gamma, atol=1e-9)


def test_training(spark):
    """The likelihood rises with every round, and planted parameters come out again."""
    pick = random.Random(4)
    planted = hmm.HiddenStates((0.5, 0.5), ((0.9, 0.1), (0.2, 0.8)), ((0.8, 0.1, 0.1), (0.1, 0.2, 0.7)))
    docs = {doc: list(drawn(pick, planted, 150)) for doc in range(60)}
    begin = hmm.HiddenStates((0.5, 0.5), ((0.6, 0.4), (0.4, 0.6)), ((0.5, 0.3, 0.2), (0.2, 0.3, 0.5)))
    chunks = hmm.chunked(table_of(spark, docs), "doc_id", "para_id", "symbol", 64)
    model, likelihoods = hmm.fit_states(chunks, begin, rounds=15)
    assert len(likelihoods) == 16 and all(b > a - 1e-3 for a, b in zip(likelihoods, likelihoods[1:]))
    assert likelihoods[-1] > likelihoods[0] + 100
    assert np.abs(np.array(model.step) - planted.step).max() < 0.05 and np.abs(np.array(model.emit) - planted.emit).max() < 0.05


def test_odd_input(spark):
    empty = hmm.chunked(spark.createDataFrame([], "doc_id bigint, para_id bigint, symbol int"), "doc_id", "para_id", "symbol")
    assert hmm.state_posteriors(empty, MODEL).count() == 0
    assert hmm.expected_counts(empty, MODEL)[3] == 0.0
    without = hmm.chunked(spark.createDataFrame([("a", 1, 0), ("a", None, 0)], "d string, p int, s string").withColumn("s", F.lit(0)), "d", "p", "s")
    assert [(r.doc, r.place) for r in hmm.state_posteriors(without, MODEL).collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        hmm.HiddenStates((1.0, 0.0), ((0.5, 0.5), (0.5, 0.5)), ((1.0,), (1.0,)))
    with pytest.raises(ValueError):
        hmm.HiddenStates((0.5, 0.5), ((0.5, 0.5),), ((1.0,), (1.0,)))


def test_query_likelihoods_rise(spark, sf_dir):
    found = [r.log_likelihood for r in queries.all_queries()["state_likelihoods"](spark, sf_dir).orderBy("round").collect()]
    assert len(found) == 5 and all(b > a for a, b in zip(found, found[1:]))
