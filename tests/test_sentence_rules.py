"""Rules from sentences against plain conditions."""

import re

import pytest
from pyspark.sql import functions as F

from weakloom.operators import labeling as lb
from weakloom.operators import lf_stats
from weakloom.operators import sentence_rules as sr

GROUPS = {"budgets": ["budget", "tax credit"], "fines": ["fine", "penalty"]}
SENTENCES = {
    "has": 'label positive because the text contains "tax credit" or "Subsidy"',
    "near": "label negative because a phrase of fines is within 3 words of a phrase of budgets",
    "short": "label neutral because the text has fewer than 4 words",
    "order": 'label positive because "offers" comes before "loans".',
    "count": "label positive because at least 2 words of the text are in fines",
    "both": 'label negative because the text contains "a or b" and does not contain "c and d"',
    "mixed": 'label neutral because the text has more than 5 words and contains "x" or the text has fewer than 2 words',
}
TEXTS = ["A SUBSIDY for all", "tax  credit", "the fine on the budget", "fine one two three four budget", "offers then loans", "loans then offers",
         "fine penalty fine", "a or b", "a or b, c and d", "one", "x y z w v u", "", None]


def words(t):
    return re.findall(r"\w+", (t or "").lower())


PLAIN = {
    "has": lambda t: "tax credit" in (t or "").lower() or "subsidy" in (t or "").lower(),
    "short": lambda t: len(words(t)) < 4,
    "order": lambda t: "offers" in (t or "") and t.index("offers") < t.find("loans"),
    "count": lambda t: sum(w in ("fine", "penalty") for w in words(t)) >= 2,
    "both": lambda t: "a or b" in (t or "") and "c and d" not in (t or ""),
    "mixed": lambda t: (len(words(t)) > 5 and "x" in (t or "")) or len(words(t)) < 2,
}


def test_votes(spark):
    rules, failed = sr.parse_all(SENTENCES, GROUPS)
    assert not failed and [r.kind for r in rules].count("near") == 1
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in lb.vote_matrix(frame, "text", rules, lb.plain_lexicon(GROUPS)).collect():
        for rule, vote in zip(rules, r.votes):
            if rule.name == "near":
                assert vote == (2 if r.text == "the fine on the budget" else 0)
            else:
                assert vote == (rule.vote if PLAIN[rule.name](r.text) else 0), (rule.name, r.text)


@pytest.mark.parametrize("sentence", [
    "label great because the text has fewer than 4 words", "the text has fewer than 4 words", "label positive because it is nice",
    "label positive because a phrase of nothing is within 3 words of a phrase of budgets", "label positive because at least 2 words of the text are in x",
    'label positive because the text contains "a" and it rains', "label positive because the text has fewer than many words"])
def test_not_understood(sentence):
    with pytest.raises(ValueError):
        sr.parse("r", sentence, GROUPS)
    rules, failed = sr.parse_all({"bad": sentence, "good": SENTENCES["short"]}, GROUPS)
    assert [r.name for r in rules] == ["good"] and list(failed) == ["bad"]


def test_filters(spark):
    """Rules that always, never or equally vote, or against the others, go; the rest stays in order."""
    sentences = {
        "long": "label positive because the text has more than 3 words", "twin": "label positive because the text has more than 3 words",
        "always": "label neutral because the text has fewer than 1000 words", "never": 'label negative because the text contains "zzz"',
        "wrong": "label negative because the text has more than 4 words", "short": "label neutral because the text has fewer than 4 words"}
    rules, _ = sr.parse_all(sentences, GROUPS)
    frame = spark.createDataFrame([(i, "w " * (i % 8), 3 if i % 8 > 3 else 1) for i in range(80)], "id int, text string, class int")
    voted = lb.vote_matrix(frame, "text", rules, lb.plain_lexicon(GROUPS))
    report = sr.rule_report(voted, "id", [r.name for r in rules], "class")
    found = {r.rule: r for r in report.collect()}
    assert [r.name for r in sr.kept_rules(rules, report)] == ["long", "short"]
    assert found["twin"].same_as == 0 and found["wrong"].agreement == 0 and found["always"].coverage == 1 and found["never"].agreement is None
    majority = voted.withColumn("majority", lf_stats.majority_vote(F.col("votes")))
    assert sr.rule_report(majority, "id", [r.name for r in rules], "majority").count() == 6
