"""Nearest rows against all pairs."""

import math

import numpy as np
import pytest

from weakloom.operators import search


def plain(rows, queries, k):
    """``(query, key, rank, score)`` of ``(key, vector)`` pairs."""
    out = []
    for q, a in queries:
        scored = []
        for key, b in rows:
            x, y = np.array(a, float), np.array(b, float)
            scored.append((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9), key))
        out += [(q, key, rank, -s + 0.0) for rank, (s, key) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rows_of(found):
    return sorted((r["query"], r.key, r["rank"], r.score + 0.0) for r in found.collect())


def same(ours, theirs):
    assert [r[:3] for r in ours] == [r[:3] for r in theirs]
    assert np.allclose([r[3] for r in ours], [r[3] for r in theirs])


def vectors(n, width, seed, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, width)) * 2
    return [(i, [float(np.float32(x)) for x in centres[i % groups] + rng.standard_normal(width)]) for i in range(n)]


def table_of(spark, rows, name="vec_id"):
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>").repartition(3)


@pytest.mark.parametrize("block_bytes, k", [(1 << 20, 5), (2000, 5), (100, 300), (1, 1)])
def test_exact(spark, block_bytes, k):
    rows = vectors(200 if block_bytes > 1 else 30, 12, 1)
    asked = rows[::7] + [(1000, rows[3][1]), (1001, [-x for x in rows[4][1]])]
    found = search.nearest(table_of(spark, rows), table_of(spark, asked, "q"), k, "vec_id", "embedding", "q", block_bytes)
    same(rows_of(found), plain(rows, asked, k))


def test_ties_and_copies(spark):
    """Copies of one vector: a hot group over many blocks, ranked by key."""
    rows = vectors(50, 4, 2) + [(100 + i, [1.0, 0.5, -0.25, 2.0]) for i in range(300)]
    asked = [(1, [1.0, 0.5, -0.25, 2.0]), (2, [2.0, 1.0, -0.5, 4.0])]
    found = search.nearest(table_of(spark, rows), table_of(spark, asked), 20, "vec_id", "embedding", block_bytes=40 * 32)
    got = rows_of(found)
    assert [r[1] for r in got if r[0] == 1] == list(range(100, 120)) == [r[1] for r in got if r[0] == 2]


def test_odd_rows(spark):
    rows = vectors(20, 3, 3)
    odd = [(50, None), (51, []), (52, [0.0] * 3), (53, [math.nan, 1.0, 1.0]), (54, [None, 1.0, 1.0]), (55, [math.inf] * 3), (56, [1.0, 2.0]),
           (None, [1.0, 1.0, 1.0])]
    found = search.nearest(table_of(spark, rows + odd), table_of(spark, rows[:4] + odd), 3, "vec_id", "embedding")
    same(rows_of(found), plain(rows, rows[:4], 3))
    empty = table_of(spark, [])
    some = table_of(spark, rows)
    assert search.nearest(empty, some, 3, "vec_id", "embedding").count() == 0
    assert search.nearest(some, empty, 3, "vec_id", "embedding").count() == 0
    index = search.build_index(empty, "vec_id", "embedding")
    assert search.search_index(index, some, 3, "vec_id", "embedding", 1).count() == 0
    assert search.probes_needed(index, some, 3, "vec_id", "embedding") == 1


def test_index(spark):
    rows = vectors(600, 16, 4, groups=12)
    frame, asked = table_of(spark, rows), table_of(spark, rows[::5])
    index = search.build_index(frame, "vec_id", "embedding", cells=16)
    assert index.rows.count() == 600 and index.rows.select("key").distinct().count() == 600
    exact = search.nearest(frame, asked, 10, "vec_id", "embedding").cache()
    every = search.search_index(index, asked, 10, "vec_id", "embedding", probes=16, block_bytes=4096)
    same(rows_of(every), rows_of(exact))
    probes = search.probes_needed(index, asked, 10, "vec_id", "embedding", audited=40)
    assert 1 <= probes < 16
    few = search.search_index(index, asked, 10, "vec_id", "embedding", probes)
    assert search.recall_of(few, exact) >= 0.9
    assert search.recall_of(search.search_index(index, asked, 10, "vec_id", "embedding", 1), exact) < 1
    again = search.build_index(frame.repartition(7), "vec_id", "embedding", cells=16)
    assert np.array_equal(again.centres, index.centres)


def test_no_cross_join(spark):
    rows = table_of(spark, vectors(50, 4, 5))
    plan = search.nearest(rows, rows, 3, "vec_id", "embedding")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
