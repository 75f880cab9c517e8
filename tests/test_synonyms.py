"""Words used alike, and augmented texts."""

import math
import random
from collections import Counter

import numpy as np

from weakloom.operators import synonyms as sy
from weakloom.operators import topics as tp


def texts():
    """``big`` and ``large`` stand in the same places, and so do ``cat`` and ``dog``."""
    pick = random.Random(3)
    rows = []
    for i in range(300):
        rows.append((i, " ".join(f"the {pick.choice(['big', 'large'])} house near {pick.choice(['cat', 'dog'])} sleeps {pick.choice(['x', 'y', 'z', 'w'])}"
                                 for _ in range(3))))
    return rows + [(1000, None), (1001, ""), (1002, "Big"), (1003, "Unknown words!")]


def plain_vectors(rows, terms, window):
    counts = Counter()
    for _, t in rows:
        words = (t or "").lower().replace("!", "").split()
        for i, a in enumerate(words):
            for b in words[i + 1:i + 1 + window]:
                if a in terms and b in terms and a != b:
                    counts[a, b] += 1
                    counts[b, a] += 1
    total, alone = sum(counts.values()), Counter()
    for (a, _), n in counts.items():
        alone[a] += n
    return counts, {k: math.log(n * total / alone[k[0]] / alone[k[1]]) for k, n in counts.items() if n * total > alone[k[0]] * alone[k[1]]}


def test_vectors_and_neighbours(spark):
    rows = texts()
    frame = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    terms = tp.vocabulary(frame, "text")
    counts, want = plain_vectors(rows, terms, 2)
    meetings = sy.meeting_words(frame, "text", terms)
    assert {(r.a, r.b): r.n for r in meetings.collect()} == counts
    vectors = sy.mutual_information(meetings).cache()
    got = {(r.a, r.b): r.weight for r in vectors.collect()}
    assert set(got) == set(want) and np.allclose([got[k] for k in want], list(want.values()))
    found = {(r.word, r.neighbour): (r.cosine, r["rank"]) for r in sy.neighbours(vectors, tables=16, planes=2).collect()}
    norm = {a: math.sqrt(sum(w * w for (x, _), w in want.items() if x == a)) for a in terms}
    for (a, b), (cosine, _) in found.items():
        dot = sum(w * want.get((b, c), 0) for (x, c), w in want.items() if x == a)
        assert abs(cosine - dot / norm[a] / norm[b]) < 1e-6
    assert found["big", "large"][1] == 1 and found["large", "big"][1] == 1 and found["cat", "dog"][1] == 1
    every = {(a, b) for a in terms for b in terms if a != b and norm[a] and norm[b]
             and sum(w * want.get((b, c), 0) for (x, c), w in want.items() if x == a) / norm[a] / norm[b] >= 0.2}
    all_found = {(r.word, r.neighbour) for r in sy.neighbours(vectors, tables=1, planes=1, most=99).collect()} | set(found)
    assert set(found) <= every and all_found <= every


def test_augmented(spark):
    frame = spark.createDataFrame(texts(), "id bigint, text string")
    near = spark.createDataFrame([("big", "large", 0.9, 1), ("big", "huge", 0.8, 2), ("cat", "dog", 0.9, 1)], "word string, neighbour string, cosine double, rank int")
    found = {(r.id, r.copy): r.text for r in sy.augmented(frame, "id", "text", near, copies=3, share=0.5, seed=4).collect()}
    again = {(r.id, r.copy): r.text for r in sy.augmented(frame.repartition(5), "id", "text", near, copies=3, share=0.5, seed=4).collect()}
    other = {(r.id, r.copy): r.text for r in sy.augmented(frame, "id", "text", near, copies=3, share=0.5, seed=5).collect()}
    assert found == again != other and len(found) == 3 * len(texts())
    given = dict(texts())
    changed = kept = 0
    for (i, _), t in found.items():
        if not given[i]:
            assert t == given[i]
            continue
        old, new = given[i].split(), t.split()
        assert len(old) == len(new)
        for a, b in zip(old, new):
            if a in ("big", "cat"):
                changed += a != b
                kept += a == b
                assert b in {"big": ("big", "large", "huge"), "cat": ("cat", "dog")}[a]
            elif a != "Big":
                assert a == b
    assert 0.45 < changed / (changed + kept) < 0.55
    assert {found[1002, c] for c in (1, 2, 3)} <= {"Big", "Large", "Huge"}
    everything = sy.augmented(frame.where("id = 1002"), "id", "text", near, share=1.0).first()
    assert everything.text in ("Large", "Huge") and everything.copy == 1


def test_empty(spark):
    frame = spark.createDataFrame([], "id bigint, text string")
    vectors = sy.mutual_information(sy.meeting_words(frame, "text", []))
    assert vectors.count() == 0 and sy.neighbours(vectors).count() == 0
    assert sy.augmented(frame, "id", "text", sy.neighbours(vectors)).count() == 0
