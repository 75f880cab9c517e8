"""Near-duplicate vectors against all pairs."""

import math

import llm_plain as plain
import numpy as np
import pytest

from weakloom.llm import queries, vector_graph


def brute_force(rows, threshold=0.93):
    """Rows ``(key, vector, label)`` by position."""
    n = len(rows)
    fine = [v is not None and label is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v)
            for _, v, label in rows]
    above = list(range(n))

    def root(i):
        while above[i] != i:
            i = above[i]
        return i

    count = [0] * n
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for ok, (_, v, _) in zip(fine, rows)]
    for i in range(n):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= threshold:
                count[i] += 1
                count[j] += 1
                above[root(i)] = root(j)
    least = {}
    for i, (key, _, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((key, count[i], least.get(root(i)), key == least.get(root(i))) for i, (key, _, _) in enumerate(rows)), key=repr)


COLUMNS = ("vec_id", "n_links", "component_id", "kept")
SCHEMA = "vec_id bigint, embedding array<float>, label bigint, node int, size string, vector int, key int, shard int, graph string, a int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, "s", 2, 3, 4, "g", 5) for i, v, k in rows], SCHEMA).repartition(3)


def family(rng, size, width, spread):
    centre = rng.standard_normal(width)
    return [[float(np.float32(c)) for c in centre + spread * rng.standard_normal(width)] for _ in range(size)]


def test_given_embeddings(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    found = queries.op13_vector_duplicates(spark, sf_dir)
    assert found.columns == list(COLUMNS)
    assert plain.as_rows(found, *COLUMNS) == brute_force(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    v = family(rng, 3, 8, 0.01)
    rows = [(10, v[0], 1), (9, v[1], 1), (9, v[1], 1), (8, v[2], 2), (7, v[2], None), (6, None, 1), (5, [0.0] * 8, 1), (4, [math.nan] * 8, 1),
            (3, [None] * 8, 1), (2, [], 1), (1, v[0] + [0.0], 1), (None, v[2], 1), (None, v[2], 2), (20, v[0], 1), (None, None, 1), (21, [math.inf] * 8, 1),
            (30, [2 * c for c in v[0]], 1), (31, [-0.0] * 7 + [1.0], 3), (32, [0.0] * 7 + [2.0], 3), (None, [1.0, 0.0], 5)]
    assert plain.as_rows(vector_graph.near_duplicates(table_of(spark, rows)), *COLUMNS) == brute_force(rows)
    assert vector_graph.near_duplicates(table_of(spark, [])).count() == 0
    assert plain.as_rows(vector_graph.near_duplicates(table_of(spark, [(1, None, 1)])), *COLUMNS) == [(1, 0, 1, True)]


def test_families_over_shards(spark):
    """A frequent label over many shards, chains of links, a family larger than the first beam, and very frequent copies."""
    rng = np.random.default_rng(6)
    vectors = family(rng, 90, 16, 0.05) + [x for _ in range(25) for x in family(rng, 6, 16, 0.25)] + family(rng, 200, 16, 3.0)
    rows = [(i, v, 1 if i % 4 else 2) for i, v in enumerate(vectors)] + [(1000 + i, vectors[95], 1) for i in range(300)]
    found = vector_graph.near_duplicates(table_of(spark, rows), beam=8, shard=40)
    assert plain.as_rows(found, *COLUMNS) == brute_force(rows)


@pytest.mark.parametrize("size", [1, 2, 7, 600])
def test_graph(size):
    rng = np.random.default_rng(size)
    vectors = rng.standard_normal((size, 24))
    g = vector_graph.build(vectors)
    for level, links in enumerate(g.links):
        on = np.flatnonzero(g.levels >= level)
        for node in range(size):
            own = links[node][links[node] >= 0]
            assert len(set(own)) == len(own) and node not in own and (g.levels[own] >= level).all()
            assert node in on or not len(own)
    units = vector_graph._units(vectors)
    nodes, _ = vector_graph._beam(g, 0, units, vector_graph._entries(g, units, 0), min(48, size))
    best = np.argsort(-(units @ units.T), axis=1)[:, :min(10, size)]
    assert np.mean([np.isin(b, n).mean() for b, n in zip(best, nodes)]) > 0.9
    again = vector_graph.build(vectors)
    assert all((a == b).all() for a, b in zip(g.links, again.links))


def test_audit_widens_beams():
    """A graph whose links were cut finds nothing by itself; the audit widens the beam until all links are there."""
    rng = np.random.default_rng(9)
    vectors = np.array(family(rng, 60, 12, 0.05) + family(rng, 60, 12, 0.05))
    g = vector_graph.build(vectors)
    for links in g.links:
        links[:] = -1
    true = vector_graph.cosines(np.repeat(vectors, 120, 0), np.tile(vectors, (120, 1))) >= 0.93
    query, node, (links, hit, beam) = vector_graph.search(g, vectors, 0.93, beam=4)
    assert links == hit == true.sum() and beam == 120 and len(query) == true.sum()
    assert len(vector_graph.search(g, vectors, 0.93, beam=4, recall=0.0)[0]) < true.sum()
