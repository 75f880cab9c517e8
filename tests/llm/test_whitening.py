"""Whitening against a dense eigenvalue routine."""

import math

import llm_plain as plain
import numpy as np
import pytest

from weakloom.llm import queries, whitening


def spectra():
    rng = np.random.default_rng(1)
    yield "random", np.sort(rng.random(40))[::-1]
    yield "close", np.r_[5.0, 1 + 1e-3 * np.arange(30), 0.2]
    yield "repeated", np.r_[3.0, np.ones(9), np.full(9, 0.5), 0.1, 0, 0]
    yield "equal", np.full(12, 2.0)
    yield "falling", 10.0 ** -np.arange(14)
    yield "one", np.array([4.0])
    yield "low rank", np.r_[7.0, 3.0, np.zeros(20)]


@pytest.mark.parametrize("name, values", list(spectra()), ids=lambda x: x if isinstance(x, str) else "")
def test_eigenpairs(name, values):
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = turn @ np.diag(values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    wanted = min(16, len(values))
    found, vectors = whitening.leading(matrix, 16)
    assert np.allclose(found, np.sort(values)[::-1][:wanted], atol=1e-12 * max(values))
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * max(values)


def test_inertia():
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((30, 30))
    matrix += matrix.T
    values = np.linalg.eigvalsh(matrix)
    diagonal, beside = whitening.tridiagonal(matrix)
    for value in np.r_[values - 1e-6, values + 1e-6, -1e3, 1e3]:
        assert whitening.below(diagonal, beside, value) == (values < value).sum()
    parts = whitening.intervals(matrix, 16)
    assert sum(p.count for p in parts) >= 16 and all(a.low == b.high for a, b in zip(parts, parts[1:]))
    for p in parts:
        assert p.count == ((values > p.low) & (values < p.high)).sum()


def brute_force(rows, k=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in good]
    distinct = sorted(set(map(tuple, x)))
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct)]
    centred = lambda rows: np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in rows])
    d = centred(distinct)
    v = d.T @ d / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    kept = values > 1e-12 * np.trace(v)
    values, vectors = values[kept], vectors[:, kept]
    return good, n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], centred(x) @ vectors / np.sqrt(values), values / np.trace(v)


def agree(found, rows, key="vec_id"):
    good, n, deviation, white, explained = brute_force(rows)
    k = len(explained)
    table = found.toPandas()
    assert len(table) == len(good) * k and (table["n"] == n).all()
    by_row = table.sort_values([key, "deviation", "component"], kind="stable")
    order = sorted(range(len(good)), key=lambda i: (good[i][0], deviation[i]))
    assert by_row["deviation"].tolist() == [deviation[i] for i in order for _ in range(k)]
    assert np.allclose(by_row["explained"].to_numpy().reshape(-1, k), explained, rtol=1e-9)
    ours, theirs = by_row["whitened"].to_numpy().reshape(-1, k), white[order]
    assert np.allclose(ours * np.sign((ours * theirs).sum(axis=0)), theirs, atol=1e-6)
    assert table["identity_error"].nunique() == 1 and table["identity_error"][0] < 1e-9


def test_given_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.op12_embedding_whitening(spark, sf_dir)
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    agree(found, rows)


SCHEMA = "vec_id bigint, embedding array<float>, label bigint, x string, key int, vector int, component int, n string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4, "n") for i, v in rows], SCHEMA).repartition(3)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(20) * np.arange(1, 21)]) for i in range(200)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (502, None), (503, [None] * 20), (504, [math.nan] + [0.0] * 19), (505, [math.inf] * 20),
             (506, [0.0] * 20), (507, rows[1][1])]
    agree(whitening.whiten(table_of(spark, rows + [(600, [1.0, 2.0]), (601, [])])), rows)


def test_few_rows_and_large_entries(spark):
    assert whitening.whiten(table_of(spark, [])).count() == 0
    assert whitening.whiten(table_of(spark, [(1, None), (2, [math.nan])])).count() == 0
    assert whitening.whiten(table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whitening.whiten(table_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0]), (None, [1.0, 3.0])]))
    assert plain.as_rows(two, "vec_id", "component", "n", "deviation", "whitened") == [
        (1, 1, 2, 4096, -1.0), (2, 1, 2, 4096, 1.0), (None, 1, 2, 4096, 1.0)]
    wide = whitening.whiten(table_of(spark, [(1, [1e30, 2.0]), (2, [-1e30, 2.0]), (3, [0.0, 1.0])]))
    assert plain.as_rows(wide, "vec_id", "component", "deviation") == [(1, 1, None), (2, 1, None), (3, 1, 128 ** 2)]
