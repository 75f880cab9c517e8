"""Substring dedup, Jaccard join, line dedup and decontamination against plain versions."""

import random
from pathlib import Path

import llm_plain as plain
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weakloom import session
from weakloom.llm import decontamination, graph, jaccard_join, line_dedup, store, substring_dedup

EMPTY = []


@pytest.mark.parametrize("width", [13, 5, 30])
def test_substrings(spark, width):
    rows = plain.odd_rows()
    found = substring_dedup.remove_repeats(plain.odd_documents(spark), width)
    assert plain.as_rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == plain.substring_dedup(rows, width)


def test_substrings_text(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c y"), (3, "a b c")], "doc_id bigint, text string")
    found = substring_dedup.remove_repeats(docs, width=3, shortest=1, with_text=True)
    assert plain.as_rows(found, "doc_id", "n_removed", "kept") == [(1, 0, None), (2, 3, "x y"), (3, 3, "")]


def test_levels():
    assert substring_dedup.levels(13) == [7, 13]
    assert substring_dedup.levels(50) == [7, 13, 25, 50]
    assert all(b <= 2 * a for w in range(2, 200) for a, b in zip(substring_dedup.levels(w), substring_dedup.levels(w)[1:]))


@pytest.mark.parametrize("percent", [85, 50])
def test_jaccard(spark, percent):
    found = jaccard_join.near_duplicates(plain.odd_documents(spark), percent=percent)
    assert plain.as_rows(found, "doc_id", "n_shingles", "component_id") == plain.jaccard(plain.odd_rows(), percent)


def test_jaccard_groups(spark):
    """Families of near copies whose members are partly within and partly beyond the threshold of each other."""
    pick, rows = random.Random(5), []
    for family in range(6):
        base = plain.prose(100 + family, 120, 10**6).split()
        if family % 2:
            base[:60] = rows[-1][1].split()[:60]  # shares half with the family before
        for _ in range(25):
            words = list(base)
            for _ in range(pick.randrange(6)):
                words[pick.randrange(len(words))] = f"x{pick.random()}"
            rows.append((len(rows), " ".join(words), "aa"))
    pick.shuffle(rows)
    for percent in (85, 70):
        found = jaccard_join.near_duplicates(plain.odd_documents(spark, rows), percent=percent)
        assert plain.as_rows(found, "doc_id", "n_shingles", "component_id") == plain.jaccard(rows, percent)


def test_jaccard_appended_and_cut(spark):
    """Members that are subsets or supersets of their leader still have to be compared with other blocks."""
    pick, rows = random.Random(0), []
    footer = [f"f{k}" for k in range(20)]
    for family in range(12):
        base = plain.prose(1000 + family, 103, 10**6).split()
        changed = list(base)
        changed[pick.randrange(20, 80)] = "changed"
        for words in (base + footer[:15], base, changed, base[:-15], changed[:-14], base + footer, changed[13:]):
            if len(rows) % 7 < 3 or pick.random() < 0.5:
                rows.append((len(rows), " ".join(words), "aa"))
    for percent in (85, 80):
        found = jaccard_join.near_duplicates(plain.odd_documents(spark, rows), percent=percent)
        assert plain.as_rows(found, "doc_id", "n_shingles", "component_id") == plain.jaccard(rows, percent)


def test_jaccard_subsets_of_a_leader(spark):
    """The leader X holds s; t is near s and not near X."""
    rows, footer = [], [f"f{k}" for k in range(15)]
    for family in range(40):
        s = [f"{family}s{k}" for k in range(103)]
        t = s[:50] + [f"{family}t"] + s[51:]
        rows += [(3 * family, " ".join(s + footer), "aa"), (3 * family + 1, " ".join(s), "aa"), (3 * family + 2, " ".join(t), "aa")]
    found = jaccard_join.near_duplicates(plain.odd_documents(spark, rows))
    assert plain.as_rows(found, "doc_id", "n_shingles", "component_id") == plain.jaccard(rows)


def profiles_of(texts, width=4):
    sets = jaccard_join.shingle_sets(pa.array(texts, pa.string()), width)
    tokens = [set(sets.token[a:b].tolist()) for a, b in zip(sets.first, sets.first[1:])]
    return tokens, jaccard_join.profiles(sets), np.diff(sets.first)


def test_profiles_bound_the_overlap():
    """Never below the overlap, whatever the sizes, and far below the sizes where texts have nothing in common."""
    base = plain.prose(1, 3000, 10**6).split()
    texts = [" ".join(base[a:b]) for a, b in [(0, 3000), (0, 2600), (100, 1500), (200, 203), (5, 90), (0, 33), (0, 36), (0, 0)]]
    texts += [plain.prose(2 + k, n, 10**6) for k, n in enumerate((3000, 2600, 1400, 90, 33))] + [None, "one", "one"]
    tokens, found, n = profiles_of(texts)
    pairs = [(a, b) for a in range(len(texts)) for b in range(len(texts))]
    a, b = (pa.array([p[k] for p in pairs]) for k in range(2))
    shared = np.array([len(tokens[x] & tokens[y]) for x, y in pairs])
    most = jaccard_join.most_shared(found.take(a), found.take(b), n[a], n[b])
    assert (most >= shared).all() and (most <= np.minimum(n[a], n[b])).all()
    unlike = [k for k, (x, y) in enumerate(pairs) if (shared[k] == 0) & (min(n[x], n[y]) > 80) & (n[x] < 2 * n[y]) & (n[y] < 2 * n[x])]
    assert len(unlike) > 10 and all(most[k] < 0.8 * min(n[x] for x in pairs[k]) for k in unlike)
    cut = jaccard_join.most_shared(found.take(a).slice(7, 60), found.take(b).slice(7, 60), n[a][7:67], n[b][7:67])
    assert cut.tolist() == most[7:67].tolist()


def unlike_documents():
    """Ten texts of nine passages, each of which is in one other text, and a family whose members are near some and not near others."""
    passages = {(a, b): plain.prose(300 + 10 * a + b, 40, 10**6) for a in range(10) for b in range(a)}
    rows = [(k, " ".join(passages[max(k, j), min(k, j)] for j in range(10) if j != k), "aa") for k in range(10)]
    base = plain.prose(7, 200, 10**6).split()
    return rows + [(100 + k, " ".join(base[:8 * k] + [f"{k}x{j}" for j in range(8)] + base[8 * k + 8:]), "aa") for k in range(12)]


def test_whole_sets_are_fetched_only_for_pairs_that_may_count(spark, monkeypatch):
    """Texts that share passages with others and are like none of them are told apart by their profiles."""
    ids, kept = [], store.Scratch.stored

    def seen(self, df, label):
        table = kept(self, df, label)
        ids.extend(r.doc_id for r in table.select("doc_id").collect()) if label == "sets" else None
        return table

    monkeypatch.setattr(store.Scratch, "stored", seen)
    found = jaccard_join.near_duplicates(plain.odd_documents(spark, unlike_documents()))
    assert plain.as_rows(found, "doc_id", "n_shingles", "component_id") == plain.jaccard(unlike_documents())
    assert ids and min(ids) >= 100


def test_pipeline_fetches_whole_sets_only_for_pairs_that_may_count(spark, monkeypatch, tmp_path):
    found, kept = [], store.Scratch.stored

    def seen(self, df, label):
        table = kept(self, df, label)
        found.append(table.count()) if label == "sets" else None
        return table

    monkeypatch.setattr(store.Scratch, "stored", seen)
    left = corpus_pipeline.drop_near_duplicates(spark, plain.odd_documents(spark, unlike_documents()), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [*range(10), 100]
    assert max(found) <= 12


def test_pairs_are_compared_in_parts(spark, monkeypatch):
    """Pairs that would move more tokens than all their sets have are dealt over several parts."""
    tables, kept = [], store.Scratch.stored
    monkeypatch.setattr(store.Scratch, "stored", lambda self, df, label: tables.append(label) or kept(self, df, label))
    monkeypatch.setattr(jaccard_join, "MOVED", 100)
    rows = plain.odd_rows() + [(1000 + i, t, g) for i, t, g in unlike_documents()]
    found = jaccard_join.near_duplicates(plain.odd_documents(spark, rows), percent=60)
    assert plain.as_rows(found, "doc_id", "n_shingles", "component_id") == plain.jaccard(rows, 60)
    assert tables.count("leader-pairs") + tables.count("block-heads") + tables.count("member-pairs") > 3


def test_components(spark):
    pick = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(pick.randrange(90), pick.randrange(90)) for _ in range(70)]
    found = graph.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    expected = plain.components({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in found.collect()} == {k: v for k, v in expected.items() if k != v}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    pick, pairs = random.Random(edits), []
    while len(pairs) < 300:
        a = [pick.choice("abé") for _ in range(pick.randint(edits, 14))]
        b = list(a)
        for _ in range(pick.randint(0, edits + 2)):
            k = pick.randrange(len(b) + 1)
            b[k:k + pick.randint(0, 1)] = pick.choice([[], ["a"], ["x"]])
        if abs(len(a) - len(b)) <= edits <= len(b):
            pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select("a", "b", line_dedup.within(F.split("a", ""), F.split("b", ""), edits).alias("w")).collect()
    assert [r.w for r in found] == [plain.edit_distance(r.a, r.b) <= edits for r in found]


def line_rows(df):
    return plain.as_rows(df.withColumn("kept", F.sha2(F.coalesce("text", F.lit("")), 256)), "doc_id", "n_lines", "n_removed", "n_near", "kept")


def test_lines(spark):
    docs = plain.odd_documents(spark)
    found = line_dedup.without_repeats(docs)
    assert line_rows(found) == plain.line_dedup(plain.odd_rows())
    assert set(docs.columns) <= set(found.columns)


def test_near_lines(spark):
    pick, rows = random.Random(8), []
    for k in range(12):
        base, lines = plain.prose(200 + k, 8, 10**4).replace("\n", " "), []
        for _ in range(6):
            text = list(base)
            for _ in range(pick.randint(0, 4)):
                at = pick.randrange(len(text) + 1)
                text[at:at + pick.randint(0, 1)] = pick.choice([[], ["z"], ["é"]])
            lines.append("".join(text))
        rows += [(pick.randrange(1000), "\n".join(lines[:3]), "aa"), (1000 + k, "\n".join(lines[3:]), "aa")]
    for edits in (1, 2):
        found = line_dedup.without_repeats(plain.odd_documents(spark, rows), edits=edits)
        assert line_rows(found) == plain.line_dedup(rows, edits)


def test_lines_stay_in_the_engine(spark):
    plan = line_dedup.without_repeats(plain.odd_documents(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_of_all_lengths(spark, edits):
    """Edits at all places of lines whose length is at the border of two sizes."""
    pick, rows = random.Random(edits), []
    for length in [24, 25, 27, 28, 29, 59, 60, 62, 63, 64, 65, 66, 79, 80, 81, 82, 96]:
        base = "".join(pick.choice("abcdé ") for _ in range(length - 1)) + "."
        lines = [base]
        for k in range(3):
            line = list(base)
            for part in range(edits + (k == 2)):
                at = min(len(line) - 1, (2 * part + 1) * len(line) // (2 * edits + 2) + pick.randint(-3, 3))
                line[at:at + pick.randint(0, 1)] = pick.choice([[], ["z"], ["é"]])
            lines.append("".join(line))
        rows.append((len(rows), "\n".join(lines), "aa"))
    found = line_dedup.without_repeats(plain.odd_documents(spark, rows), edits=edits)
    assert line_rows(found) == plain.line_dedup(rows, edits)


def test_line_tables_are_deleted(spark, monkeypatch):
    """Of the tables of a run only the one that the result reads stays."""
    made = []
    monkeypatch.setattr(store, "fresh_path", lambda *args: made.append(session.fresh_path(*args)) or made[-1])
    found = line_dedup.without_repeats(plain.odd_documents(spark))
    left = [path for path in made if Path(path).exists()]
    assert len(left) == 1 and "lines-to-go" in left[0]
    assert line_rows(found) == plain.line_dedup(plain.odd_rows())


def test_pieces_of_unrelated_lines(spark):
    """Only pieces that two lines share are kept, and a line's own pieces are few."""
    rows = [(k, "\n".join(plain.prose(1000 * k + j, 12, 10**6) for j in range(30)), "aa") for k in range(20)]
    lines = line_dedup.hashed_lines(plain.odd_documents(spark, rows), 2, 24, "text")
    assert lines.where("size(keys) + coalesce(size(more), 0) > 8").count() == 0
    assert line_dedup.entries(lines).count() < lines.count() // 10


def test_text_is_hashed_once(spark):
    """The hash of a text is taken below the generator that makes its lines."""
    plan = line_dedup.lines_of(plain.odd_documents(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64(doc_id")


ITEMS = [(1, plain.odd_rows()[7][1]), (2, "ONE two"), (3, None), (4, "..."), (5, plain.prose(2, 40, 10**6)[:90]), (6, plain.prose(3, 25, 5000)), (7, "one, TWO!")]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


REPORT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination(spark):
    found = decontamination.report(decontamination.find(plain.odd_documents(spark), benchmark(spark)))
    assert plain.as_rows(found, *REPORT) == plain.decontamination(plain.odd_rows(), ITEMS)


def test_decontamination_in_blocks_and_over_all_terms(spark, monkeypatch):
    expected = plain.decontamination(plain.odd_rows(), ITEMS)
    found = decontamination.find(plain.odd_documents(spark), benchmark(spark), block_words=10)
    assert plain.as_rows(decontamination.report(found), *REPORT) == expected
    monkeypatch.setattr(decontamination, "vocabulary_of", lambda items: None)
    found = decontamination.find(plain.odd_documents(spark), benchmark(spark))
    assert plain.as_rows(decontamination.report(found), *REPORT) == expected


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a x b c d"), (3, "b a c d q"), (4, "a b x x x x c d")], "doc_id bigint, text string")
    items = benchmark(spark, [(1, "a b c d")])
    hits = {slack: [r.doc_id for r in decontamination.find(docs, items, slack=slack).orderBy("doc_id").collect() if r["items"]] for slack in (0, 1, 4)}
    assert hits == {0: [1], 1: [1, 2, 3], 4: [1, 2, 3, 4]}


def test_proximity_stays_in_the_document(spark):
    docs = spark.createDataFrame([(1, "x a b c"), (2, "d y z w"), (3, "x a b c"), (4, "x a b c d")], "doc_id bigint, text string").coalesce(1)
    found = decontamination.find(docs, benchmark(spark, [(1, "a b c d")]), slack=1)
    assert [r.doc_id for r in found.collect() if r["items"]] == [4]


def test_no_items(spark):
    found = decontamination.report(decontamination.find(plain.odd_documents(spark), benchmark(spark, [(1, None)])))
    assert found.where("contaminated").count() == 0 and found.count() == len(plain.odd_rows())


def test_empty_tables(spark):
    docs = plain.odd_documents(spark, EMPTY)
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert jaccard_join.near_duplicates(docs).count() == 0
    assert line_dedup.without_repeats(docs).count() == 0
    assert decontamination.find(docs, benchmark(spark)).count() == 0
