"""Phrase lists behind the default labeling rules.

Fixed values. Order, repetitions after stemming and leading spaces all matter for the result.
"""

IMPLEMENTING = [
    "improve", "provide", "establish", "implement", "assist", "raise", "facilitate",
    "increase", "offer", "earmark", "obtain", "access", "aid", "promote", "found",
    "create", "initiate",
]
ENCOURAGING = [
    "encourage", "assist", "mobilize", "motivate", "stimulate", "support", "endorse",
    "recommend", "strengthen", "foster", "prompt",
]
BASE_WORDS = ["fund", "investment", "finance", "credit", "budget", "resource"]
BUDGETS = [
    "allocation", "allocate", "budget", "financial", "financing commitment",
    "increase resource allocation", "will be financed", "delivery of financial", "resource",
]
FINANCE = [
    "microfinance", "institutional finance", "concessional finance", "bilateral finance",
    "micro finance", "results based finance", "philanthropic finance",
    "multilateral finance", "financing commitment", "international finance",
    "private sector finance", "financial mechanism",
]
FUNDS = [
    "capital", "concessional", "results based", "carbon market", "grant fund",
    "youth enterprise fund", "devolution fund", "green climate fund", "development fund",
    "adequate fund", "devolved fund", "revolving fund", "financial mechanism",
]
FINANCIAL_INCENTIVES = [
    "payment for", "results based", "tax break", "tax incentive", "financial incentive",
    "access to credit", "taxation incentive",
]
SPECIFIC_INCENTIVES = [
    "market connection", "low transaction cost", "credit package", "carbon credit",
    "transfer pricing", "access to finance", "market access", " access of",
    " new investment", "green growth", "tax free",
]
NEGATIVE_VERBS = [
    "limit", "mismanage", "challenge", "levy", " evasion", "hamper", "impede", "fail",
    "corrupt", "seize",
]
NEGATIVE_ADJ = ["inadequate", "insufficient", "little", "high", "lack"]
NEGATIVE_NOUNS = ["barrier", "obstacle", "penalty", "fee", "disincentive"]
NEGATIVE_OTHER = ["there is not", "there has not been"]
FINES = ["fine", "penalty", "excise", "guilty"]
REDUCE_WORDS = r"\b(reduce cost|lower cost|remove barriers|cost reduction|cost effective)"


def with_negative_all(groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Add the group that chains all negative lists."""
    chained = [p for name in ("negative_verbs", "negative_adj", "negative_nouns", "negative_other")
               for p in groups[name]]
    return {**groups, "negative_all": chained}


POLICY = with_negative_all({
    "implementing": IMPLEMENTING,
    "encouraging": ENCOURAGING,
    "base_words": BASE_WORDS,
    "budgets": BUDGETS,
    "finance": FINANCE,
    "funds": FUNDS,
    "financial_incentives": FINANCIAL_INCENTIVES,
    "specific_incentives": SPECIFIC_INCENTIVES,
    "negative_verbs": NEGATIVE_VERBS,
    "negative_adj": NEGATIVE_ADJ,
    "negative_nouns": NEGATIVE_NOUNS,
    "negative_other": NEGATIVE_OTHER,
    "fines": FINES,
})
