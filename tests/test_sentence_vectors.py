"""Sentence vectors against a plain version."""

import random

import numpy as np

from weakloom.operators import sentence_vectors as sv


def data(spark):
    pick = random.Random(2)
    rows = [(i, " ".join(pick.choice(["a", "a", "a", "b", "c", "d", "unknown"]) for _ in range(pick.randrange(1, 30)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "unknown words"), (5, "a b"), (103, "A, b! " * 2000)]
    rng = np.random.default_rng(1)
    table = {t: [float(np.float32(x)) for x in rng.standard_normal(6) + 0.5] for t in ("a", "b", "c", "d", "never")}
    return rows, table, spark.createDataFrame(rows, "id bigint, text string"), spark.createDataFrame(list(table.items()), "token string, vector array<float>")


def plain(rows, table, half):
    texts = [[w.strip(",!").lower() for w in (t or "").split()] for _, t in rows]
    every = [w for t in texts for w in t]
    weight = {w: half / (half + every.count(w) / len(every)) for w in set(every)}
    means = np.array([np.mean([weight[w] * np.array(table[w]) for w in t if w in table], axis=0) if any(w in table for w in t) else np.zeros(6) for t in texts])
    _, _, vt = np.linalg.svd(means, full_matrices=False)
    return means, vt[0], means - np.outer(means @ vt[0], vt[0])


def rows_of(found):
    return sorted((r.key, [round(x, 7) + 0.0 for x in r.vector]) for r in found.collect())


def test_equals_plain(spark):
    rows, table, frame, vectors = data(spark)
    means, direction, want = plain(rows, table, 1e-2)
    want = sorted((i, [round(float(x), 7) + 0.0 for x in v]) for (i, _), v in zip(rows, want))
    found = rows_of(sv.sentence_vectors(frame.repartition(3), "id", "text", vectors, 6, 1e-2))
    assert [r[0] for r in found] == [r[0] for r in want]
    assert np.allclose([r[1] for r in found], [r[1] for r in want], atol=1e-6)
    joined = sv.weighted_means(frame.repartition(3), "id", "text", vectors, 6, 1e-2, table_bytes=10)
    sent = sv.weighted_means(frame, "id", "text", vectors, 6, 1e-2)
    assert np.allclose([r[1] for r in rows_of(joined)], [r[1] for r in rows_of(sent)], atol=1e-6)


def test_direction_is_stable(spark):
    rows, table, frame, vectors = data(spark)
    means, direction, _ = plain(rows, table, 1e-2)
    found = []
    for n in (1, 3, 8):
        table_of = sv.weighted_means(frame.repartition(n), "id", "text", vectors, 6, 1e-2).cache()
        found.append(sv.shared_direction(table_of, 6))
    for d in found:
        assert abs(abs(d.vector @ direction) - 1) < 1e-9 and np.allclose(d.vector, found[0].vector, atol=1e-9)
        assert d.vector[np.abs(d.vector).argmax()] > 0 and 1 < d.rounds < 50


def test_nothing_to_go_by(spark):
    _, _, frame, vectors = data(spark)
    none = sv.sentence_vectors(frame.where("id > 1000"), "id", "text", vectors, 6)
    assert none.count() == 0
    blank = sv.sentence_vectors(frame.where("id in (100, 101)"), "id", "text", vectors, 6)
    assert all(r.vector == [0.0] * 6 for r in blank.collect()) and blank.count() == 2
