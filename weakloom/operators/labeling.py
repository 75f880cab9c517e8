"""Labeling rules and the vote matrix.

Rules are data. The matrix is one projection over the text, built in stages that Catalyst
keeps apart: tokens, occurrences, phrase arrays, positions per phrase group, distances per
pair of groups, votes. Each is computed once per row, however many rules use it, and nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.functions import lexicons
from weakloom.functions import literals as lit
from weakloom.functions import tokens as tk
from weakloom.functions.fence import fenced
from weakloom.functions.forms import common_forms
from weakloom.operators import stemming

# The label domain.
ABSTAIN, NEUTRAL, NEGATIVE, POSITIVE = 0, 1, 2, 3
CLASSES = (NEUTRAL, NEGATIVE, POSITIVE)
LETTERS = {"n": NEUTRAL, "d": NEGATIVE, "i": POSITIVE}


@dataclass(frozen=True)
class Rule:
    """One labeling rule; it votes ``vote`` when it fires and abstains otherwise.

    near      a phrase of ``left`` and one of ``right`` are less than ``limit`` tokens apart
    contains  a phrase of ``left`` is a substring of the lower-cased text
    tally     fewer than ``limit`` of the other rules fire; other tally rules do not count
    pattern   ``regex`` is found in the lower-cased text
    custom    ``build(text_column)`` gives a vote column, from expressions or a pandas UDF
    """

    name: str
    kind: str
    vote: int
    left: str | None = None
    right: str | None = None
    limit: int | None = None
    regex: str | None = None
    build: Callable[[Column], Column] | None = None

    def __post_init__(self) -> None:
        needed = {"near": ("left", "right", "limit"), "contains": ("left",), "tally": ("limit",),
                  "pattern": ("regex",), "custom": ("build",)}
        if self.kind not in needed:
            raise ValueError(f"unknown rule kind: {self.kind}")
        missing = [f for f in needed[self.kind] if getattr(self, f) is None]
        if missing:
            raise ValueError(f"rule {self.name} lacks {', '.join(missing)}")


def near(name: str, left: str, right: str, limit: int, vote: int) -> Rule:
    return Rule(name, "near", vote, left=left, right=right, limit=limit)


def contains(name: str, group: str, vote: int) -> Rule:
    return Rule(name, "contains", vote, left=group)


def tally(name: str, limit: int, vote: int = NEUTRAL) -> Rule:
    return Rule(name, "tally", vote, limit=limit)


def default_rules() -> list[Rule]:
    """The 35 rules in matrix-column order."""
    targets = [("budget", "budgets"), ("finance", "finance"), ("funds", "funds"),
               ("incentive", "financial_incentives"), ("base", "base_words")]
    # The rules named _10 use a limit of 15.
    limits = {"5": 5, "10": 15}
    rules = [near(f"{verb}_x_{short}_{label}", group, target, limit, POSITIVE)
             for verb, group in (("implementing", "implementing"), ("encourage", "encouraging"))
             for short, target in targets
             for label, limit in limits.items()]
    rules += [
        contains("budget", "budgets", POSITIVE),
        contains("finance_fn", "finance", POSITIVE),
        contains("fund", "funds", POSITIVE),
        contains("incentive", "financial_incentives", POSITIVE),
        contains("specific", "specific_incentives", POSITIVE),
        tally("neutral_fuzzy", 2),
        tally("neutral", 1),
        near("neg_verbs_x_adj", "negative_verbs", "negative_adj", 10, NEGATIVE),
        near("neg_verbs_x_nouns", "negative_verbs", "negative_nouns", 15, POSITIVE),
        near("neg_nouns_x_adj", "negative_nouns", "negative_adj", 10, NEGATIVE),
        near("neg_all_x_finance", "negative_all", "finance", 10, NEGATIVE),
        near("neg_all_x_budget", "negative_all", "budgets", 10, NEGATIVE),
        near("neg_all_x_funds", "negative_all", "funds", 10, NEGATIVE),
        near("neg_all_x_base", "negative_all", "base_words", 10, NEGATIVE),
        contains("neg_fines", "fines", NEGATIVE),
    ]
    return rules


def encourage_rule() -> Rule:
    """Defined beside the default rules but not one of them."""
    return contains("encourage", "encouraging", POSITIVE)


def reduce_words_rule() -> Rule:
    """Cost-reduction wording, an optional pattern rule."""
    return Rule("reduce_words", "pattern", POSITIVE, regex=lexicons.REDUCE_WORDS)


@dataclass(frozen=True)
class Lexicon:
    """Phrase groups ready for matching.

    ``raw`` serves the substring rules, ``phrases`` the token rules. ``words`` are the words of ``phrases``: tokens
    count if they equal one of them or, in a ``stemmed`` lexicon, if their stem does. ``forms`` has the stems of
    common forms; others are stemmed where they occur.
    """

    raw: Mapping[str, Sequence[str]]
    phrases: Mapping[str, Sequence[str]]
    words: Sequence[str]
    stemmed: bool = False
    forms: Mapping[str, str] = field(default_factory=dict)


def plain_lexicon(groups: Mapping[str, Sequence[str]]) -> Lexicon:
    """Tokens must equal the phrase words."""
    words = {w for ps in groups.values() for p in ps for w in tk.phrase_words(p) if w}
    return Lexicon(groups, groups, sorted(words))


def stemmed_lexicon(spark: SparkSession, groups: Mapping[str, Sequence[str]]) -> Lexicon:
    """Tokens must share their stem with the phrase words. Only the phrase lists are read, so it serves every table and stream."""
    stems = stemming.stem_table(spark, stemming.lexicon_words(groups))
    wanted = sorted(set(stems.values()))
    forms = {w: s for w, s in stemming.stem_table(spark, common_forms(wanted)).items() if s in set(wanted)}
    return Lexicon(groups, stemming.stem_phrases(groups, stems), wanted, stemmed=True, forms=forms)


def _groups_used(rules: Sequence[Rule]) -> list[str]:
    return list(dict.fromkeys(g for r in rules if r.kind == "near" for g in (r.left, r.right)))


def _check_names(rules: Sequence[Rule]) -> None:
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError("rule names must be unique")


def with_occurrences(df: DataFrame, text: str, lexicon: Lexicon, out: str = "_hits") -> DataFrame:
    """Add the matching tokens of each row."""
    kept = df.columns
    tokenised = df.select(*kept, tk.tokens(F.col(text)).alias("_tokens"))
    if not lexicon.words:
        hits = F.lit(None).cast("array<struct<word:string,at:int>>")
    elif lexicon.stemmed:
        # Stages of their own: the stems of a row are made before its tokens are looked up in them.
        tokenised = tokenised.select(*kept, tk.likely_occurrences("_tokens", lexicon.words, lexicon.forms).alias("_likely"))
        tokenised = tokenised.select(*kept, "_likely", tk.stem_forms("_likely", lexicon.words).alias("_forms"))
        hits = tk.stem_occurrences("_likely", "_forms")
    else:
        hits = tk.occurrences("_tokens", lexicon.words)
    return tokenised.select(*kept, hits.alias(out))


def with_phrase_arrays(df: DataFrame, longest: int, hits: str = "_hits") -> DataFrame:
    """Add ``_at`` and ``_g1`` … ``_gN``: positions and the phrases starting there."""
    kept = [c for c in df.columns if c != hits]
    flat = df.select(*kept, F.transform(hits, lambda x: x["at"]).alias("_at"),
                     F.transform(hits, lambda x: x["word"]).alias("_g1"))
    grams = [tk.adjacent("_g1", "_at", n).alias(f"_g{n}") for n in range(2, longest + 1)]
    return flat.select(*kept, "_at", "_g1", *grams)


def group_positions(phrases: Sequence[str]) -> Column:
    """First positions of all phrases of a group, sorted, missing ones last as null.

    A phrase listed twice, or two phrases with equal stems, contribute their position twice.
    """
    by_width: dict[int, list[str]] = {}
    for phrase in phrases:
        words = tk.phrase_words(phrase)
        if all(words):
            by_width.setdefault(len(words), []).append(phrase)
    if not by_width:
        return F.array().cast("array<int>")
    # One lambda per phrase width rather than one expression per phrase keeps the generated
    # code of the stage below the size the JVM compiles.
    found = ", ".join(tk.first_positions("_at", f"_g{n}", listed) for n, listed in by_width.items())
    # Most texts hold no phrase word at all and need no search.
    return F.expr(f"CASE WHEN size(_at) > 0 THEN array_sort(concat({found})) END")


def with_distances(df: DataFrame, rules: Sequence[Rule], lexicon: Lexicon) -> DataFrame:
    """Replace the occurrence column by one distance per pair of groups used by the rules."""
    groups = _groups_used(rules)
    longest = max((len(tk.phrase_words(p)) for g in groups for p in lexicon.phrases[g]), default=1)
    kept = [c for c in df.columns if c != "_hits"]
    arrays = with_phrase_arrays(df, longest)
    placed = arrays.select(*kept, *[group_positions(lexicon.phrases[g]).alias(f"_p_{g}") for g in groups])
    pairs = list(dict.fromkeys((r.left, r.right) for r in rules if r.kind == "near"))
    if not pairs:
        return placed
    return fenced(placed, kept, {
        distance_name(a, b): tk.rank_distance(f"_p_{a}", f"_p_{b}") for a, b in pairs})


def distance_name(left: str, right: str) -> str:
    return f"gap_{left}_x_{right}"


def _votes(frame: DataFrame, kept: Sequence[str], text: str, rules: Sequence[Rule], lexicon: Lexicon) -> DataFrame:
    """Votes from a frame that holds the distances."""
    def condition(rule: Rule) -> str:
        if rule.kind == "near":
            return f"`{distance_name(rule.left, rule.right)}` < {rule.limit}"
        if rule.kind == "contains":
            return tk.contains_any("_lower", lexicon.raw[rule.left])
        return f"_lower RLIKE {lit.string(rule.regex)}"

    primary = [r for r in rules if r.kind != "tally"]
    custom = {r.name: f"_custom_{i}" for i, r in enumerate(primary) if r.kind == "custom"}
    frame = frame.select("*", F.lower(F.coalesce(text, F.lit(""))).alias("_lower"), *[
        r.build(F.col(text)).cast("int").alias(custom[r.name]) for r in primary if r.kind == "custom"])
    base = [f"coalesce({custom[r.name]}, {ABSTAIN})" if r.kind == "custom"
            else f"CASE WHEN {condition(r)} THEN {r.vote} ELSE {ABSTAIN} END" for r in primary]
    frame = frame.select(*kept, F.expr(f"array({', '.join(base)})").alias("_base"))
    frame = frame.select(*kept, "_base", F.expr("size(filter(_base, v -> v > 0))").alias("_fired"))
    slot = {r.name: i for i, r in enumerate(primary)}
    votes = [f"CASE WHEN _fired < {r.limit} THEN {r.vote} ELSE {ABSTAIN} END" if r.kind == "tally"
             else f"_base[{slot[r.name]}]" for r in rules]
    return fenced(frame, kept, {"votes": F.expr(f"array({', '.join(votes)})")})


def vote_matrix(df: DataFrame, text: str, rules: Sequence[Rule], lexicon: Lexicon) -> DataFrame:
    """``df`` plus ``votes ARRAY<INT>``, one entry per rule in the given order.

    Null text counts as empty. A stateless projection: it runs unchanged on a stream.
    """
    _check_names(rules)
    kept = df.columns
    frame = with_occurrences(df, text, lexicon)
    frame = with_distances(frame, rules, lexicon)
    return _votes(frame, kept, text, rules, lexicon)


def stemmed_votes_by_join(df: DataFrame, key: str, text: str, rules: Sequence[Rule],
                          groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """The same votes with each distinct word of the text stemmed once, at the price of shuffling tokens."""
    _check_names(rules)
    stems = stemming.stem_table(df.sparkSession, stemming.lexicon_words(groups))
    lexicon = Lexicon(groups, stemming.stem_phrases(groups, stems), sorted(set(stems.values())), stemmed=True)
    hits = stemming.occurrences_by_join(df, key, text, stemming.surface_forms(df, text, stems), lexicon.words)
    frame = df.join(hits.withColumnRenamed("hits", "_hits"), key, "left")
    frame = with_distances(frame, rules, lexicon)
    return _votes(frame, df.columns, text, rules, lexicon)


def long_votes(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """One row per key and rule: ``(key, rule_no, rule, vote)``."""
    names = F.expr(lit.string_array(r.name for r in rules))
    return df.select(key, F.posexplode("votes").alias("rule_no", "vote")).select(
        key, "rule_no", F.get(names, F.col("rule_no")).alias("rule"), "vote")
