"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import llm_plain as plain
import pytest

from weakloom.llm import queries, spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_force(rows, shortest=6, least=5, slip=199, times=5):
    total = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(plain.AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    words = {w: n for w, n in total.items() if len(w) >= shortest and n >= least}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w, n in words.items():
        beside = [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, []) if near(w, v)]
        count[w] = len(beside)
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, count[w], None if form[w] is None else words[form[w]]))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.op11_spelling_variants(spark, sf_dir)
    assert found.columns[:6] == list(COLUMNS)
    assert plain.as_rows(found, *COLUMNS) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_documents(spark):
    words = ["abcdef", "abcdefg", "abcdxef", "bcdefg", "éàüößÿ", "éàüößÿa", "ababababab", "abababababa", "bababababa", "aaaaaaaa", "aaaaaaa",
             "aaaaaaaaa", "abc÷×f", "ABCDEF", "ÀBCDEF", "àbcdef", "x" * 3000, "x" * 3001]
    pick = random.Random(3)
    rows = [(i, " ".join(pick.choices(words, weights=[40, 9, 3] * 6, k=60)) + " 漢字abcdef\x00abcdef", "aa") for i in range(40)]
    rows += plain.odd_rows() + [(3, "abcdef " * 30000, "aa")]
    found = spelling.variants(plain.odd_documents(spark, rows), least=2)
    assert plain.as_rows(found, *COLUMNS) == brute_force(rows, least=2)
    assert spelling.variants(plain.odd_documents(spark, [(1, None, None)])).count() == 0


@pytest.mark.parametrize("short, long, share", [(2, 4, 1 / 300), (1, 3, 1 / 50), (2, 6, 1 / 1000), (3, 5, 1 / 10)])
def test_bounds_and_pairs(spark, short, long, share):
    """Families of words over few letters: every near pair shares what the bound says, and the join finds it."""
    pick = random.Random(short * 10 + long)
    words = {"".join(pick.choices("abc", k=pick.randrange(2, 9))) for _ in range(250)}
    for word in sorted(words):
        at = pick.randrange(len(word))
        words |= {word[:at] + pick.choice("abcd") + word[at:], word[:at] + word[at + 1:], word[:at] + "d" + word[at + 1:]} - {""}
    counts = Counter()
    for word in words:
        text = spelling.padded(word, long)
        counts.update(text[i:i + size] for size in range(short, long + 1) for i in range(len(text) - size + 1))
    book = spelling.dictionary_of(counts.items(), short, long, share, share / 5)
    assert book.grams
    grams, least = {}, {}
    for word in words:
        text = spelling.padded(word, long)
        places = spelling.decompose(text, book)
        grams[word] = {text[a:b]: a for a, b in places}
        least[word] = len(grams[word]) - spelling.affected(text, places, book)
    pairs = {(a, b) for a in words for b in words if a < b and near(a, b)}
    for a, b in pairs:
        assert len(set(grams[a]) & set(grams[b])) >= max(least[a], least[b])
    table = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n bigint")
    found = spelling.near_pairs(table, short, long, share, share / 5)
    key = lambda a, b: (a, b) if a < b else (b, a)
    assert {key(r.a, r.b) for r in found.collect()} == pairs
    assert min(least.values()) <= 0 or long < 6


def test_cut_is_bounded(spark):
    """The dictionary holds no more grams per length than its share allows, however many words there are."""
    pick = random.Random(8)
    words = spark.createDataFrame([("".join(pick.choices("abcdefgh", k=8)), 1) for _ in range(3000)], "word string, n bigint")
    book = spelling.fit_dictionary(words, extend=1 / 200, keep=1 / 400)
    for size in (3, 4):
        assert sum(len(g) == size for g in book.grams) <= 400
    assert book.grams and not any("\x00" in g for g in book.grams)
