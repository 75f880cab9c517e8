"""Tokens, phrase occurrences and distances as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.functions.forms import may_have_stem, stem_of
from weakloom.functions.stem import STEP2, STEP3, STEP4, stem_array

# Letters, digits and underscore of every script.
WORD = r"[\p{L}\p{N}_]+"
# Distance reported when one of the two phrase groups does not occur.
NOT_FOUND = 999


def tokens(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def phrase_words(phrase: str) -> list[str]:
    """Words of a phrase, split on single spaces; a leading space gives an empty first word."""
    return phrase.split(" ")


def occurrences(token_array: str, words: Iterable[str]) -> Column:
    """``(word, at)`` for every token of the array column found in ``words``, in text order.

    The list has the size of the phrase lists, not of the text, and most rows keep only a few entries, so the
    searches that follow run on short arrays.
    """
    return F.expr(f"filter(transform({token_array}, (t, i) -> named_struct('word', t, 'at', i)), x -> x.word IN ({lit.strings(words)}))")


def likely_occurrences(token_array: str, stems: Iterable[str], forms: Mapping[str, str]) -> Column:
    """``(word, at, stem)`` for every token of the array column that may have one of the stems, in text order.

    ``stem`` is null if the word is not in the table ``forms``.
    """
    likely, known = may_have_stem(stems), stem_of(forms)
    found = F.transform(token_array, lambda t, i: F.when(likely(t), F.struct(t.alias("word"), i.alias("at"), known(t).alias("stem"))))
    return F.filter(found, lambda x: x.isNotNull())


def stem_forms(occurrences: str, stems: Iterable[str]) -> Column:
    """Map of the words that have one of the stems to that stem, for words that came without. Each distinct word of a row is stemmed once."""
    words = F.array_distinct(F.transform(F.filter(occurrences, lambda x: x["stem"].isNull()), lambda x: x["word"]))
    # The stemmer carries a second field along; here it is the token itself.
    stemmed = F.filter(stem_array(F.transform(words, lambda t: F.struct(t.alias("word"), t.alias("at")))), lambda x: x["word"].isin(list(stems)))
    return F.map_from_entries(F.transform(stemmed, lambda x: F.struct(x["at"].alias("key"), x["word"].alias("value"))))


def stem_occurrences(occurrences: str, forms: str) -> Column:
    """``(word, at)`` with the stem for the word, where it is known or in the row's map ``forms``."""
    def placed(stem: Callable[[Column], Column]) -> Column:
        all_placed = F.transform(occurrences, lambda x: F.struct(stem(x).alias("word"), x["at"].alias("at")))
        return F.filter(all_placed, lambda x: x["word"].isNotNull())

    return F.when(F.size(forms) > 0, placed(lambda x: F.coalesce(x["stem"], F.element_at(F.col(forms), x["word"])))).otherwise(
        placed(lambda x: x["stem"]))


def adjacent(words: str, at: str, n: int) -> Column:
    """The ``n``-word phrase starting at each occurrence, null where a gap interrupts it."""
    starts = F.size(words) - (n - 1)
    return F.when(starts > 0, F.transform(
        F.sequence(F.lit(1), starts),
        lambda j: F.when(F.element_at(at, j + (n - 1)) - F.element_at(at, j) == n - 1,
                         F.array_join(F.slice(words, j, n), " "))))


def first_at(at: str, phrases: str, phrase: str) -> Column:
    """Token position of the first occurrence of a phrase, null if there is none."""
    return F.get(at, F.array_position(phrases, phrase).cast("int") - 1)


def first_positions(at: str, phrases: str, wanted: Iterable[str]) -> str:
    """``first_at`` of each wanted phrase, as an array expression."""
    return f"transform({lit.string_array(wanted)}, p -> get({at}, cast(array_position({phrases}, p) AS int) - 1))"


def rank_distance(left: str, right: str) -> Column:
    """Smallest gap between equally ranked positions of two sorted position arrays.

    The longer array is cut to the length of the shorter one: padding with null makes those
    differences null, and the minimum skips them. Missing positions sort last and are null too.
    """
    return F.expr(f"coalesce(array_min(zip_with(`{left}`, `{right}`, (a, b) -> abs(a - b))), {NOT_FOUND})")


def contains_any(lowered: str, phrases: Iterable[str]) -> str:
    """Any of the phrases is a substring of the text, as a condition."""
    return "(" + (" OR ".join(f"contains({lowered}, {lit.string(p)})" for p in phrases) or "false") + ")"


def shared_head(stem: str) -> str:
    """Letters every word with this stem starts with.

    The stemmer rewrites at most the last letter of what becomes the stem, two of them in
    -bility to -ble and in dying, lying and tying, none in stems of one or two letters.
    """
    if len(stem) <= 2:
        return stem
    return stem[:-2] if stem.endswith("ble") or stem in ("die", "lie", "tie") else stem[:-1]


def _ending_pattern() -> str:
    """What can stand between the head of a word and its end: up to two letters, the rest of an ending whose beginning stayed in the stem, then
    endings that the stemmer takes off or rewrites.

    An ending may lack its last e (before ing), end in y instead of i, and ing and ed may follow a doubled letter.
    """
    listed = {*STEP2, *STEP3, *STEP4, "s", "es", "ies", "ied", "y", "i", "e", "l", "ed", "edly", "eed", "eedly", "ing", "ingly"}
    # What an ending is rewritten to may be the end of a longer one: -bility becomes -ble, and -able goes.
    listed |= {w.removesuffix(new) + old for old, new in {**STEP2, **STEP3}.items() if new for w in listed if w.endswith(new)}
    listed |= {w[:-1] for w in listed if w.endswith("e") and len(w) > 1} | {w[:-1] + "y" for w in listed if w.endswith("i")}
    rests = {w[i:] for w in listed for i in range(1, len(w))}

    def either(words: set[str]) -> str:
        return "|".join(sorted(words, key=lambda w: (-len(w), w)))

    return ".{0,2}(?:" + either(rests) + ")?(?:" + either(listed) + "|[bdfgmnprt](?=ed|ing))*$"


def prefix_pattern(stems: Iterable[str]) -> str:
    """Matches the tokens that may have one of the stems, by their first letters and their endings."""
    heads = sorted({shared_head(s) for s in stems if s})
    return "^(?:" + "|".join(re.escape(h) for h in heads) + ")" + _ending_pattern()
