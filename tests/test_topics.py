"""Topics against planted ones and a plain round."""

import random

import numpy as np
from pyspark.sql import functions as F

from weakloom.operators import topics as tp


def planted(n=240, seed=3):
    """Documents of mostly one of three topics with words of their own, and words that all share."""
    pick = random.Random(seed)
    words = [[f"t{k}w{i}" for i in range(25)] for k in range(3)]
    rows = []
    for doc in range(n):
        main = doc % 3
        rows.append((doc, " ".join(pick.choice(words[main if pick.random() < 0.85 else pick.randrange(3)]) if pick.random() < 0.8
                                   else f"common{pick.randrange(10)}" for _ in range(80)), main))
    return rows


def plain_round(model, docs):
    """One round, document by document."""
    places = {t: i for i, t in enumerate(model.terms)}
    sums, logs = np.zeros(model.shares.shape), 0.0
    for words in docs:
        own = [places[w] for w in words if w in places]
        if not own:
            continue
        mix = np.full(model.n_topics, 1 / model.n_topics)
        for _ in range(model.steps):
            parts = [mix * model.shares[i] / (mix * model.shares[i]).sum() for i in own]
            mix = np.sum(parts, axis=0) / len(own)
        for i in own:
            both = mix * model.shares[i]
            logs += np.log(both.sum())
            sums[i] += both / both.sum()
    return sums, logs


def test_round_equals_plain(spark):
    rows = planted(40) + [(100, None, 0), (101, "", 0), (102, "unknown words", 0), (103, "t0w1 " * 3000, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, main int").repartition(3)
    words = tp.vocabulary(frame, "text", size=60)
    counts = tp.counted(frame, "doc_id", "text", words)
    model = tp.start_topics(spark, words, 4, steps=3)
    assert len(words) == 60 and np.allclose(model.shares.sum(axis=0), 1)
    limit, tp.NUMBERS_AT_ONCE = tp.NUMBERS_AT_ONCE, 64
    try:
        sums, logs = tp.term_sums(counts, model)
    finally:
        tp.NUMBERS_AT_ONCE = limit
    want, want_logs = plain_round(model, [(t or "").split() for _, t, _ in rows])
    assert np.allclose(sums, want) and np.isclose(logs, want_logs)
    mixed = {r.key: r.mixture for r in tp.mixtures(counts, model).collect()}
    assert len(mixed) == len(rows) and mixed[100] == mixed[102] == [0.25] * 4
    assert all(abs(sum(m) - 1) < 1e-9 for m in mixed.values())


def test_planted_topics_come_out(spark):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, main int").repartition(4)
    model, counts, logs = tp.fit_topics(frame, "doc_id", "text", 3, rounds=40)
    assert all(b >= a - 1.0 for a, b in zip(logs, logs[1:])) and logs[-1] > logs[0]
    leading = [{w[:2] for w in words if not w.startswith("common")} for words in tp.leading_terms(model, 12)]
    assert sorted(map(tuple, leading)) == [("t0",), ("t1",), ("t2",)]
    main = {r.doc_id: r.main for r in frame.collect()}
    best = {r.key: int(np.argmax(r.mixture)) for r in tp.mixtures(counts, model).collect()}
    name = {k: int(next(iter(words))[1]) for k, words in enumerate(leading)}
    assert np.mean([name[best[d]] == m for d, m in main.items()]) > 0.95
    again, _, _ = tp.fit_topics(frame.repartition(7), "doc_id", "text", 3, rounds=40)
    assert np.allclose(again.shares, model.shares, atol=1e-6)
    assert model.table(spark).count() == 3 * len(model.terms)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id bigint, text string")
    model, counts, logs = tp.fit_topics(frame, "doc_id", "text", 3)
    assert model.terms == () and counts.count() == 0 and logs == []
    blank = spark.createDataFrame([(1, None), (2, "once")], "doc_id bigint, text string")
    model, counts, _ = tp.fit_topics(blank, "doc_id", "text", 2)
    assert {tuple(r.mixture) for r in tp.mixtures(counts, model).collect()} == {(0.5, 0.5)}
    assert blank.select(tp.start_weight(F.lit("x"), 0).alias("w")).where("w < 1 or w >= 2").count() == 0


def test_counts_are_made_for_whole_batches(spark):
    """Rows without known terms keep their place, and no list of words is turned into Python objects."""
    frame = spark.createDataFrame([(1, "b a b x"), (2, None), (3, "x"), (None, "a"), (4, "c b c")], "doc_id bigint, text string")
    rows = tp.counted(frame.coalesce(1), "doc_id", "text", ["a", "b", "c"]).collect()
    assert [(r.key, r.terms, r.counts) for r in rows] == [
        (1, [0, 1], [1, 2]), (2, [], []), (3, [], []), (None, [0], [1]), (4, [1, 2], [1, 2])]
    assert {r.key: r.terms for r in tp.counted(frame, "doc_id", "text", []).collect()} == {1: [], 2: [], 3: [], None: [], 4: []}
    assert "as_py" not in "".join(
        n for c in tp.counted.__code__.co_consts if hasattr(c, "co_names") for n in c.co_names)
