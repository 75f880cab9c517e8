import pytest
from plain import distance, first_index, words
from pyspark.sql import functions as F

from weakloom.functions import lexicons
from weakloom.functions import tokens as tk
from weakloom.operators import labeling as lb
from weakloom.operators import lf_stats, stemming
from weakloom.plans import standins as sd

RULES = lb.default_rules()
AT = {r.name: i for i, r in enumerate(RULES)}


def votes_of(spark, texts, groups=lexicons.POLICY, rules=RULES, stem=False):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lexicon = lb.stemmed_lexicon(spark, groups) if stem else lb.plain_lexicon(groups)
    rows = lb.vote_matrix(frame, "text", rules, lexicon).orderBy("id").collect()
    return [r.votes for r in rows]


def test_thirty_five_rules_in_order():
    assert len(RULES) == 35
    assert RULES[1].name == "implementing_x_budget_10" and RULES[1].limit == 15
    assert [r.name for r in RULES[25:27]] == ["neutral_fuzzy", "neutral"]
    assert RULES[28].name == "neg_verbs_x_nouns" and RULES[28].vote == lb.POSITIVE
    assert "encourage" not in AT


def test_distances_match_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lexicon = lb.plain_lexicon(sd.PHRASES)
    frame = lb.with_distances(lb.with_occurrences(docs, "text", lexicon), RULES, lexicon)
    pairs = {(r.left, r.right) for r in RULES if r.kind == "near"}
    assert len(pairs) == 17
    for row in frame.collect():
        tokens = words(row.text)
        for a, b in pairs:
            assert row[lb.distance_name(a, b)] == distance(tokens, sd.PHRASES[a], sd.PHRASES[b]), (row.doc_id, a, b)


@pytest.mark.parametrize("left, right, want", [
    ([0, 20], [18, 40], 18), ([5], [1, 6], 4), ([], [3], 999), ([3], None, 999), ([1, 2], [2, None], 1)])
def test_rank_distance(spark, left, right, want):
    frame = spark.createDataFrame([(left, right)], "a array<int>, b array<int>")
    assert frame.select(tk.rank_distance("a", "b").alias("d")).first().d == want


def test_quirks(spark):
    rules = [lb.near("five", "l", "r", 5, 3), lb.near("ten", "l", "r", 15, 3), lb.contains("sub", "s", 2),
             lb.near("blank", "b", "r", 999, 3), lb.tally("none", 1), lb.tally("few", 2)]
    groups = {"l": ["left"], "r": ["right"], "s": ["fine", " access of"], "b": [" left"]}
    twelve = "left " + "x " * 11 + "right"
    got = votes_of(spark, [twelve, "left right", "redefined terms", "access of it", "the access of it", None, ""], groups, rules)
    assert got == [[0, 3, 0, 0, 0, 1], [3, 3, 0, 0, 0, 0], [0, 0, 2, 0, 0, 1], [0, 0, 0, 0, 1, 1],
                   [0, 0, 2, 0, 0, 1], [0, 0, 0, 0, 1, 1], [0, 0, 0, 0, 1, 1]]


def test_stemmed_policy_rules(spark):
    texts = ["The ministry will provide concessional financing to farmers and establish carbon markets.",
             "Penalties and levies hamper investments; insufficient budgets limited the allocations.",
             "Nothing of interest is said here."]
    plain, stemmed = votes_of(spark, texts), votes_of(spark, texts, stem=True)
    assert stemmed[0][AT["implementing_x_funds_5"]] == lb.POSITIVE
    assert plain[1][AT["neg_all_x_base"]] == 0 and stemmed[1][AT["neg_all_x_base"]] == lb.NEGATIVE
    assert stemmed[1][AT["neg_verbs_x_nouns"]] == lb.POSITIVE
    assert stemmed[2][AT["neutral"]] == lb.NEUTRAL and sum(stemmed[2]) == 2


def test_stems_keep_repetitions(spark):
    stems = stemming.stem_table(spark, stemming.lexicon_words(lexicons.POLICY))
    phrases = stemming.stem_phrases(lexicons.POLICY, stems)
    assert phrases["budgets"][:2] == ["alloc", "alloc"]
    assert phrases["negative_verbs"][4] == " evas"
    assert len(phrases["negative_all"]) == 22


def test_join_form_equals_literal_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    literal = lb.vote_matrix(docs, "text", RULES, lb.stemmed_lexicon(spark, sd.PHRASES)).select("doc_id", "votes")
    joined = lb.stemmed_votes_by_join(docs, "doc_id", "text", RULES, sd.PHRASES).select("doc_id", "votes")
    assert literal.exceptAll(joined).count() == 0 and literal.count() == joined.count()


def test_stemmed_votes_need_no_vocabulary(spark):
    """Forms that no other table holds count in every table."""
    groups = {**lexicons.POLICY, "fines": [], "budgets": ["budget"], "implementing": ["implement"]}
    texts = ["the budgets were implemented", "budgeting and implementations", "implementing a budget", "nothing of the kind"]
    votes = votes_of(spark, texts, groups, stem=True)
    assert [v[AT["implementing_x_budget_5"]] for v in votes] == [3, 3, 3, 0]
    assert [votes_of(spark, [t], groups, stem=True)[0] for t in texts] == votes


def test_invariants(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for row in lb.vote_matrix(docs, "text", RULES, lb.plain_lexicon(sd.PHRASES)).collect():
        v = row.votes
        assert all(not v[i] or v[i + 1] for i in range(0, 20, 2))
        assert not v[AT["neutral"]] or v[AT["neutral_fuzzy"]]
        assert any(v)


def test_filters_on_votes_keep_the_plan_small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    voted = lb.vote_matrix(docs, "text", RULES, lb.plain_lexicon(sd.PHRASES))
    predicted = voted.withColumn("predicted", lf_stats.majority_vote(F.col("votes")))
    plan = predicted.where("predicted = 2 and doc_id > 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert "doc_id" in plan.split("Filter")[-1]


def test_bad_rules():
    with pytest.raises(ValueError):
        lb.Rule("x", "nearby", 1)
    with pytest.raises(ValueError):
        lb.Rule("x", "near", 1, left="a")


def test_user_rules(spark):
    rules = [lb.Rule("long", "custom", 2, build=lambda t: F.when(F.length(t) > 3, 2)), lb.reduce_words_rule(),
             lb.encourage_rule(), lb.tally("quiet", 1)]
    assert votes_of(spark, ["abcd", "a", "they lower cost", "we support"], rules=rules) == [
        [2, 0, 0, 0], [0, 0, 0, 1], [2, 3, 0, 0], [2, 0, 3, 0]]


def test_first_index_agrees(spark):
    assert first_index(["a", "b", "a"], "b a") == 1
