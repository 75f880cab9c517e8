"""Phrases in texts against a comparison at every place."""

import random
import re

import pytest

from weakloom.operators import phrase_spans as ps


def plain(text, phrases):
    tokens = re.findall(r"\w+", (text or "").lower())
    known = {}
    for phrase, label in phrases:
        words = tuple(re.findall(r"\w+", phrase.lower()))
        if words and (words not in known or known[words] is None or (label is not None and label < known[words])):
            known[words] = label
    out, at = [], 0
    while at < len(tokens):
        best = max((len(w) for w in known if tuple(tokens[at:at + len(w)]) == w), default=0)
        if best:
            words = tuple(tokens[at:at + best])
            out.append((at, best, " ".join(words), known[words]))
        at += best or 1
    return out


def listed(found):
    return sorted(((r.doc_id, r.begin, r["size"], r.phrase, r.label) for r in found.collect()), key=repr)


@pytest.mark.parametrize("list_bytes", [1 << 20, 60])
def test_spans(spark, list_bytes):
    pick = random.Random(7)
    texts = [(i, " ".join(pick.choice("abcde") for _ in range(pick.randrange(40)))) for i in range(60)]
    texts += [(None, "a b c"), (3, "a b c a b c"), (3, "a b c a b c"), (90, None), (91, ""), (92, "A, b; C! D"), (93, "a " * 3000)]
    phrases = [(" ".join(pick.choice("abcde") for _ in range(pick.randrange(1, 6))), pick.choice(["x", "y", None])) for _ in range(25)]
    phrases += [("", "x"), ("...", "x"), ("B c", "z"), ("b C", "y"), ("c d e f g h", "q")]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    table = spark.createDataFrame(phrases, "phrase string, label string")
    found = ps.find_phrases(frame, "doc_id", "text", table, list_bytes, per_task=20)
    assert listed(found) == sorted(((i, *span) for i, t in texts for span in plain(t, phrases)), key=repr)


def test_failure_links():
    """Phrases inside, at the end of and across other phrases."""
    automaton = ps.Automaton([("a b c d".split(), "1"), ("b c".split(), "2"), ("c d e".split(), "3"), (["c"], "4")])
    assert automaton.longest("a b c d e".split()) == {0: (4, "1"), 1: (2, "2"), 2: (3, "3")}
    assert automaton.longest("a b c e c".split()) == {1: (2, "2"), 2: (1, "4"), 4: (1, "4")}
    assert ps.without_overlaps([(1, 2, "2"), (0, 4, "1"), (2, 3, "3"), (4, 1, "5")]) == [(0, 4, "1"), (4, 1, "5")]
    assert ps.Automaton([]).longest(["a"]) == {}


def test_empty_list(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert ps.find_phrases(frame, "doc_id", "text", spark.createDataFrame([], "phrase string, label string")).count() == 0


def test_windows(spark):
    frame = spark.createDataFrame([("A b c",), ("a",), (None,), ("a b",)], "text string")
    assert sorted(r.phrase for r in ps.windows_of(frame, "text", (2, 3)).collect()) == ["a b", "a b c", "b c"]


def test_small_lists_move_no_text(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    table = spark.createDataFrame([("a", "x")], "phrase string, label string")
    plan = ps.find_phrases(frame, "doc_id", "text", table)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_runs_skip_what_no_phrase_holds():
    """Only neighbours that stand side by side in a phrase, and words that are phrases, reach the automaton."""
    import pyarrow as pa

    runs = ps.Runs([["a", "b"], ["b", "c", "a"], ["d"]])
    texts = pa.array([["x", "a", "b", "c", "x"], [], ["a", "a", "d", "d"], ["b"], ["c", "a"]])
    assert list(runs.of(texts)) == [(0, 1, ["a", "b", "c"]), (2, 2, ["d"]), (2, 3, ["d"]), (4, 0, ["c", "a"])]
    assert list(runs.of(texts[2:4])) == [(0, 2, ["d"]), (0, 3, ["d"])]
    assert list(ps.Runs([]).of(texts)) == []
