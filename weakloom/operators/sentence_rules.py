"""Labeling rules written as sentences, and filters that keep the useful ones.

    label positive because the text contains "tax credit" or "subsidy"
    label negative because a phrase of fines is within 10 words of a phrase of finance
    label neutral because the text has fewer than 40 words and does not contain "fund"
    label positive because "offers" comes before "loans"
    label positive because at least 3 words of the text are in budgets

A sentence names a class and a condition. A condition joins clauses with *and* and *or* (*and* binds closer). Sentences become rules of
the vote matrix, so all of them, and rules built by hand, run as one projection over the text.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.functions import tokens as tk
from weakloom.operators.labeling import ABSTAIN, NEGATIVE, NEUTRAL, POSITIVE, Rule

CLASS_NAMES = {"neutral": NEUTRAL, "negative": NEGATIVE, "positive": POSITIVE}
#: A rule that votes on less or more than these shares of the rows tells nothing.
LEAST, MOST = 0.001, 0.98
#: A rule must agree with the majority of the other votes on this share of the rows it votes on.
AGREES = 0.3

_QUOTED = r'"[^"]+"'
_LIST = rf"{_QUOTED}(?: or {_QUOTED})*"

Condition = Callable[[Column], Column]


# --- reading ----------------------------------------------------------------------------------------

def _phrases(text: str) -> list[str]:
    return [p.lower() for p in re.findall(r'"([^"]+)"', text)]


def _contains(match: re.Match, groups: Mapping[str, Sequence[str]]) -> Condition:
    wanted = _phrases(match["list"])
    return lambda text: _any(text, wanted)


def _any(text: Column, phrases: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return functools.reduce(operator.or_, [low.contains(p) for p in phrases], F.lit(False))


def _length(match: re.Match, groups: Mapping[str, Sequence[str]]) -> Condition:
    n = int(match["n"])
    if match["way"] == "fewer":
        return lambda text: F.size(tk.tokens(text)) < n
    return lambda text: F.size(tk.tokens(text)) > n


def _order(match: re.Match, groups: Mapping[str, Sequence[str]]) -> Condition:
    first, second = match["first"].strip('"').lower(), match["second"].strip('"').lower()

    def before(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        at, then = F.position(F.lit(first), low), F.position(F.lit(second), low)
        return (at > 0) & (then > at)

    return before


def _words(match: re.Match, groups: Mapping[str, Sequence[str]]) -> Condition:
    n, words = int(match["n"]), [w.lower() for w in _group(match["group"], groups)]
    return lambda text: F.size(F.filter(tk.tokens(text), lambda t: t.isin(words))) >= n


def _group(name: str, groups: Mapping[str, Sequence[str]]) -> Sequence[str]:
    if name not in groups:
        raise ValueError(f"no list named {name}")
    return groups[name]


#: What a clause looks like, and what makes a condition of it.
CLAUSES = (
    (re.compile(rf"the text (?P<no>does not contain|contains) (?P<list>{_LIST})"), _contains),
    (re.compile(r"the text has (?P<way>fewer|more) than (?P<n>\d+) words"), _length),
    (re.compile(rf"(?P<first>{_QUOTED}) comes before (?P<second>{_QUOTED})"), _order),
    (re.compile(r"at least (?P<n>\d+) words of the text are in (?P<group>\w+)"), _words),
)
_NEAR = re.compile(r"a phrase of (?P<left>\w+) is within (?P<n>\d+) words of a phrase of (?P<right>\w+)")
_SENTENCE = re.compile(r"label (?P<label>\w+) because (?P<condition>.+?)\.?")


def _outside_quotes(text: str, joint: str) -> list[str]:
    """``text`` cut at a joining word that stands before a new clause, so not at the *or* of a list of quoted words."""
    starts = r'(?=the text |does not contain |contains |has |at least |a phrase of |"[^"]+" comes before )'
    kept, quoted = [], re.split(r'("[^"]*")', text)
    masked = "".join(p if i % 2 == 0 else '"' + "q" * (len(p) - 2) + '"' for i, p in enumerate(quoted))
    at = 0
    for found in re.finditer(rf" {joint} {starts}", masked):
        kept.append(text[at:found.start()])
        at = found.end()
    return [*kept, text[at:]]


def _clause(text: str, groups: Mapping[str, Sequence[str]]) -> Condition:
    whole = text if not re.match("does not contain |contains |has ", text) else f"the text {text}"
    for pattern, build in CLAUSES:
        match = pattern.fullmatch(whole)
        if match:
            condition = build(match, groups)
            if match.groupdict().get("no") == "does not contain":
                return lambda column: ~condition(column)
            return condition
    raise ValueError(f"no clause of a known form: {text}")


def parse(name: str, sentence: str, groups: Mapping[str, Sequence[str]]) -> Rule:
    """The rule a sentence describes; ``groups`` are the phrase lists it may name. Raises ``ValueError`` with the part not understood.

    A sentence that only says how near two lists stand, or that a list occurs, becomes a rule of that kind and shares its work with others.
    """
    found = _SENTENCE.fullmatch(" ".join(sentence.split()))
    if not found or found["label"] not in CLASS_NAMES:
        raise ValueError(f'no sentence of the form "label <class> because <condition>": {sentence}')
    vote, text = CLASS_NAMES[found["label"]], found["condition"]
    near = _NEAR.fullmatch(text)
    if near:
        _group(near["left"], groups), _group(near["right"], groups)
        return Rule(name, "near", vote, left=near["left"], right=near["right"], limit=int(near["n"]) + 1)
    either = [[_clause(c, groups) for c in _outside_quotes(part, "and")] for part in _outside_quotes(text, "or")]

    def build(column: Column) -> Column:
        holds = functools.reduce(operator.or_, [functools.reduce(operator.and_, [c(column) for c in every]) for every in either])
        return F.when(holds, F.lit(vote)).otherwise(F.lit(ABSTAIN))

    return Rule(name, "custom", vote, build=build)


def parse_all(sentences: Mapping[str, str], groups: Mapping[str, Sequence[str]]) -> tuple[list[Rule], dict[str, str]]:
    """The rules of all sentences that can be read, and for the others what was not understood."""
    rules, failed = [], {}
    for name, sentence in sentences.items():
        try:
            rules.append(parse(name, sentence, groups))
        except ValueError as error:
            failed[name] = str(error)
    return rules, failed


# --- filters ----------------------------------------------------------------------------------------

def rule_report(voted: DataFrame, key: str, names: Sequence[str], reference: str, votes: str = "votes", least: float = LEAST,
                most: float = MOST, agrees: float = AGREES) -> DataFrame:
    """``(rule_no, rule, coverage, agreement, same_as, kept)``, one row per rule, from one pass over the votes.

    ``reference`` is a column with a class to agree with, null where there is none: gold, or the majority of other rules. A rule is dropped if it
    votes on too few or too many rows, if it votes exactly as an earlier rule does, or if it agrees too seldom; a rule that never meets
    a reference is kept. ``key`` tells rows apart.
    """
    rows = voted.select(F.col(key).alias("_key"), F.col(reference).alias("_reference"), F.posexplode(votes).alias("rule_no", "vote"))
    fires = F.col("vote") > 0
    judged = fires & F.col("_reference").isNotNull()
    facts = rows.groupBy("rule_no").agg(
        F.avg(fires.cast("double")).alias("coverage"),
        F.avg(F.when(judged, (F.col("vote") == F.col("_reference")).cast("double"))).alias("agreement"),
        # Rules with equal votes have equal marks; two marks of 64 bits.
        F.bit_xor(F.when(fires, F.xxhash64("_key", "vote"))).alias("_mark"), F.bit_xor(F.when(fires, F.xxhash64("vote", "_key"))).alias("_check"))
    # One row per rule from here on.
    first = facts.groupBy(F.col("_mark").alias("_m"), F.col("_check").alias("_c"), F.col("coverage").alias("_share")).agg(F.min("rule_no").alias("_first"))
    same = F.col("_mark").eqNullSafe(F.col("_m")) & F.col("_check").eqNullSafe(F.col("_c")) & (F.col("coverage") == F.col("_share"))
    joined = facts.join(F.broadcast(first), same)
    copy = F.when(F.col("rule_no") != F.col("_first"), F.col("_first"))
    keep = F.col("coverage").between(least, most) & copy.isNull() & (F.coalesce("agreement", F.lit(1.0)) >= agrees)
    return joined.select("rule_no", F.get(F.expr(lit.string_array(names)), F.col("rule_no")).alias("rule"), "coverage", "agreement",
                         copy.alias("same_as"), keep.alias("kept"))


def kept_rules(rules: Sequence[Rule], report: DataFrame) -> list[Rule]:
    """The rules that passed, in their order."""
    passed = {r.rule_no for r in report.where("kept").select("rule_no").collect()}
    return [rule for i, rule in enumerate(rules) if i in passed]
