"""Entity links against all pairs and a plain flow of ranks."""

import random

import numpy as np
import pytest

from weakloom.operators import entity_links as el


def groups(name, n=3):
    padded = f"^{name.strip().lower()}$"
    return {padded[i:i + n] for i in range(max(1, len(padded) - n + 1))}


def overlap(a, b):
    return len(groups(a) & groups(b)) / len(groups(a) | groups(b))


@pytest.mark.parametrize("similar", [0.5, 0.6, 0.9, 1.0])
def test_similar_names(spark, similar):
    pick = random.Random(int(similar * 10))
    names = ["".join(pick.choice("abc ") for _ in range(pick.randrange(1, 12))).strip() for _ in range(120)]
    left = names[:70] + ["World Bank", "world bank ", "x", "ä", None, "", "   "]
    right = names[40:] + ["The World Bank", "World Bank", "X", "Ä", None]
    found = el.similar_names(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "name string"), similar)
    got = {(r.left, r.right): r.score for r in found.collect()}
    want = {(a, b): overlap(a, b) for a in left if a and a.strip() for b in right if b and b.strip() and overlap(a, b) >= similar - 1e-12}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def graph_data(spark, seed=1):
    pick = random.Random(seed)
    aliases = [(1, "central bank"), (2, "central bank"), (2, "reserve bank"), (3, "river bank"), (4, "solar fund"), (5, "solar funds"), (6, "hub")]
    names = ["central bank", "reserve bank", "river bank", "solar fund", "solar funds", "unknown thing"]
    mentions = [(d, pick.choice(names)) for d in range(40) for _ in range(pick.randrange(1, 6))] + [(d, "hub") for d in range(40)]
    mentions += [(100, "reserve bank"), (100, "central bank"), (101, None), (None, "hub")]
    return (aliases, mentions, spark.createDataFrame(aliases, "entity int, alias string"),
            spark.createDataFrame(mentions, "doc int, mention string").repartition(3))


def plain_ranks(aliases, mentions, rounds, damping=0.85):
    score = {}
    for m in {m for _, m in mentions if m}:
        for e, a in aliases:
            if overlap(m, a) >= 0.6 - 1e-12:
                score[m, e] = max(score.get((m, e), 0), overlap(m, a))
    weight = {}
    for d, m in mentions:
        for (name, e), s in score.items():
            if name == m:
                weight[d, e] = weight.get((d, e), 0) + s
    entities = sorted({e for _, e in weight})
    of_doc = {d: sum(w for (x, _), w in weight.items() if x == d) for d, _ in weight}
    of_entity = {e: sum(w for (_, x), w in weight.items() if x == e) for e in entities}
    rank = {e: 1 / len(entities) for e in entities}
    for _ in range(rounds):
        doc = {}
        for (d, e), w in weight.items():
            doc[d] = doc.get(d, 0) + rank[e] * w / of_entity[e]
        flow = dict.fromkeys(entities, 0.0)
        for (d, e), w in weight.items():
            flow[e] += doc[d] * w / of_doc[d]
        rank = {e: (1 - damping) / len(entities) + damping * flow[e] for e in entities}
    return score, rank


def test_ranks_and_links(spark):
    aliases, mentions, alias_table, mention_table = graph_data(spark)
    found = el.candidates(mention_table, alias_table).cache()
    graph = el.mention_graph(mention_table.where("mention is not null and doc is not null"), found)
    known = [(d, m) for d, m in mentions if m and d is not None]
    for rounds in (0, 3, 12):
        score, want = plain_ranks(aliases, known, rounds)
        ranks = {r.entity: r["rank"] for r in el.entity_ranks(graph, rounds).collect()}
        assert set(ranks) == set(want) and np.allclose([ranks[e] for e in want], list(want.values()))
        assert abs(sum(ranks.values()) - 1) < 1e-9
    assert {(r.mention, r.entity): round(r.score, 9) for r in found.collect()} == {k: round(v, 9) for k, v in score.items()}
    links = el.link_mentions(mention_table, found, el.entity_ranks(graph, 12)).collect()
    assert len(links) == len(set(mentions)) and sum(r.n for r in links) == len(mentions)
    for r in links:
        options = [(-round(s * want[e], 15), e) for (m, e), s in score.items() if m == r.mention]
        assert r.entity == (min(options)[1] if options else None)
    # Two entities are called "central bank"; the one that also goes by another name found in the texts ranks higher.
    assert {r.entity for r in links if r.mention == "central bank"} == {2}


def test_empty(spark):
    _, _, alias_table, mention_table = graph_data(spark)
    none = mention_table.where("false")
    found = el.candidates(none, alias_table)
    graph = el.mention_graph(none, found)
    assert found.count() == 0 and el.entity_ranks(graph, 3).count() == 0
    assert el.link_mentions(mention_table, found, el.entity_ranks(graph, 3)).where("entity is not null").count() == 0
