"""Words that may have a given stem: the stemmer's steps, undone one by one.

Each step here gives every value from which the stemmer's step of the same name may come to a value, and a few others. What a step
needs of the letters it leaves alone (a region, a vowel, a letter before the ending) bounds the words, so that a list of stems has
a list of words whatever the data. The stemmer decides which of them count.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from weakloom.functions.stem import (
    IRREGULAR,
    LI_ENDING,
    PAST,
    REGION_1,
    REGION_2,
    SHORT_END,
    SHORT_WHOLE,
    STEP2,
    STEP3,
    STEP4,
)

#: Places of the set for each of its words, of which each word takes two; about one in 70 other words passes, too.
PLACES = 16
#: Letters that a common form may be longer than its stem.
COMMON = 4


def _ends(word: str, *patterns: str) -> bool:
    return any(re.search(p, word) for p in patterns)


def _region_1(word: str) -> bool:
    """Region 1 begins in or right behind these letters."""
    return re.match(REGION_1, word) is not None


def _region_2(word: str) -> bool:
    first = re.match(REGION_1, word)
    return first is not None and re.match(REGION_2, word[first.end():]) is not None


def _longest(word: str, suffixes: Iterable[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _final_e_and_l(w: str) -> set[str]:
    found = {w + "l"} if w.endswith("l") and _region_2(w) else set()
    if _region_2(w) or (_region_1(w) and not _ends(w, SHORT_END)):
        found.add(w + "e")
    return found


def _deleted(w: str) -> set[str]:
    if not _region_2(w):
        return set()
    return {w + s for s in STEP4 if _longest(w + s, STEP4) == s and (s != "ion" or w.endswith(("s", "t")))}


def _rewritten(table: Mapping[str, str], allowed: Callable[[str, str], bool]) -> Callable[[str], set[str]]:
    def step(w: str) -> set[str]:
        heads = [(w.removesuffix(new), old) for old, new in table.items() if w.endswith(new)]
        return {h + old for h, old in heads if _region_1(h) and _longest(h + old, table) == old and allowed(h, old)}
    return step


def _final_y(w: str) -> set[str]:
    return {w[:-1] + "y"} if _ends(w, ".[^aeiouy]i$") else set()


def _past(w: str) -> set[str]:
    found = {w + "d", w + "dly"} if w.endswith("ee") and _region_1(w[:-2]) else set()
    cut = {w}
    if _ends(w, "[bdfgmnprt]$"):
        cut.add(w + w[-1])
    if w.endswith("e") and _ends(w[:-1], "(?:at|bl|iz)$", SHORT_END, SHORT_WHOLE):
        cut.add(w[:-1])
    return found | {c + s for c in cut if _ends(c, "[aeiouy]") for s in ("ingly", "edly", "ing", "ed") if _longest(c + s, PAST) == s}


def _plural(w: str) -> set[str]:
    found = {w + "es"} if w.endswith("ss") else set()
    if w.endswith("i"):
        found |= {w + "es", w + "ed"}
    if w.endswith("ie"):
        found |= {w + "s", w + "d"}
    if _ends(w, "[aeiouy].+$"):
        found.add(w + "s")
    return found


_STEPS = (
    _final_e_and_l, _deleted,
    _rewritten(STEP3, lambda head, old: old != "ative" or _region_2(head)),
    _rewritten(STEP2, lambda head, old: _ends(head + old, LI_ENDING) if old == "li" else old != "ogi" or head.endswith("l")),
    _final_y, _past, _plural,
)


@lru_cache(maxsize=4096)
def forms_of(stem: str) -> frozenset[str]:
    """Lower-case words without apostrophes that may have this stem: all that have it, and a few that have not."""
    # A y that counts as a consonant is a capital, as in the stemmer; letters before it are never rewritten.
    words = {re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", stem))}
    for step in _STEPS:
        words |= {x for w in words for x in step(w)}
    return frozenset({w.replace("Y", "y") for w in words} | {w for w, s in IRREGULAR.items() if s == stem})


def common_forms(stems: Iterable[str]) -> list[str]:
    """The shorter of the forms, among them nearly all in use."""
    return sorted({w for s in stems for w in forms_of(s) if len(w) <= len(s) + COMMON})


@lru_cache(maxsize=16)
def _places(stems: tuple[str, ...]) -> bytes:
    """A set of the forms' checksums, with seven places in each byte, which thus is a character."""
    words = {w for s in stems for w in forms_of(s)}
    data = bytearray(max(1, -(-PLACES * len(words) // 7)))
    for w in words:
        for text in (w, w + w):
            byte, bit = divmod(zlib.crc32(text.encode()) % (7 * len(data)), 7)
            data[byte] |= 1 << bit
    return bytes(data)


def may_have_stem(stems: Iterable[str]) -> Callable[[Column], Column]:
    """A test for words that have one of the stems; few others pass.

    It is two look-ups in a literal whose size depends on the stems alone.
    """
    places = _places(tuple(sorted(set(stems))))
    literal, size = F.lit(places), F.lit(7 * len(places))

    def holds(text: Column) -> Column:
        place = F.crc32(text.cast("binary")) % size
        byte = F.ascii(F.substring(literal, F.call_function("div", place, F.lit(7)).cast("int") + 1, F.lit(1)).cast("string"))
        return F.call_function("getbit", byte, (place % 7).cast("int")) == 1

    return lambda word: holds(word) & holds(F.concat(word, word))


def stem_of(stems: Mapping[str, str]) -> Callable[[Column], Column]:
    """The stem that a table gives a word, or null. The table is a literal: small maps, chosen by the word's checksum."""
    maps: list[dict[str, str]] = [{} for _ in range(max(1, len(stems)))]
    for word, stem in stems.items():
        maps[zlib.crc32(word.encode()) % len(maps)][word] = stem
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return lambda word: F.element_at(F.get(table, (F.crc32(word.cast("binary")) % len(maps)).cast("int")), word)
