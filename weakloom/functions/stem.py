"""English (Porter2) stemming with Spark expressions: of a column of words, or of an array of words in a row.

A column of distinct words is the cheaper way where a vocabulary is at hand; the array form needs nothing but the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.functions.fence import fenced

# Fixed values of the published algorithm: suffix tables and irregular words.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
    "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing",
    "canning": "canning", "cannings": "canning", "herring": "herring", "herrings": "herring",
    "earring": "earring", "earrings": "earring",
    "proceed": "proceed", "proceeds": "proceed", "proceeded": "proceed", "proceeding": "proceed",
    "exceed": "exceed", "exceeds": "exceed", "exceeded": "exceed", "exceeding": "exceed",
    "succeed": "succeed", "succeeds": "succeed", "succeeded": "succeed", "succeeding": "succeed",
}
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive",
    "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate",
    "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {
    "ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic",
    "ative": "", "ical": "ic", "ness": "", "ful": "",
}
STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
    "ive", "ize", "ion", "al", "er", "ic",
)
PAST = ("eedly", "ingly", "edly", "eed", "ing", "ed")
REGION = r"[^aeiouy]*[aeiouy]+[^aeiouy]"
REGION_1 = rf"^(?:gener|commun|arsen|{REGION})"
REGION_2 = rf"^(?:{REGION})"
LI_ENDING = r"[cdeghkmnrt]li$"
# Ends in a short syllable: consonant, vowel, consonant other than w, x or Y.
SHORT_END = r"[^aeiouy][aeiouy][^aeiouywxY]$"
SHORT_WHOLE = r"^[aeiouy][^aeiouy]$"


def _one_of(suffixes) -> str:
    return "(?:" + "|".join(suffixes) + ")$"


def _suffix(word: Column, suffixes) -> Column:
    """The longest of ``suffixes`` the word ends with, or an empty string."""
    return F.regexp_extract(word, _one_of(suffixes), 0)


def _drop(word: Column, n: Column | int) -> Column:
    return F.left(word, F.length(word) - n)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.expr(lit.string_map(table)), key)


def _ends_in(x: dict[str, Column], suffix: Column | int) -> Column:
    """A suffix of this length lies inside region 1."""
    return F.length(x["w"]) - suffix >= x["r1"]


def _ends_in_2(x: dict[str, Column], suffix: Column | int) -> Column:
    return F.length(x["w"]) - suffix >= x["r2"]


def _apostrophes(x):
    return {"w": F.regexp_replace(F.regexp_replace(x["raw"], "^'", ""), "('s'|'s|')$", "")}


def _consonant_y(x):
    return {"w": F.regexp_replace(F.regexp_replace(x["w"], "^y", "Y"), "([aeiouy])y", "$1Y")}


def _head_1(x):
    return {"h1": F.length(F.regexp_extract(x["w"], REGION_1, 0))}


def _head_2(x):
    return {"h2": F.length(F.regexp_extract(F.substring(x["w"], x["h1"] + 1, F.length(x["w"])), REGION_2, 0))}


def _plural(x):
    w = x["w"]
    return {
        "r1": F.when(x["h1"] > 0, x["h1"]).otherwise(F.length(w)),
        "r2": F.when((x["h1"] > 0) & (x["h2"] > 0), x["h1"] + x["h2"]).otherwise(F.length(w)),
        "w": F.when(F.endswith(w, F.lit("sses")), _drop(w, 2))
        .when(w.rlike("(?:ied|ies)$"), F.when(F.length(w) > 4, _drop(w, 2)).otherwise(_drop(w, 1)))
        .when(w.rlike("(?:us|ss)$"), w)
        .when(w.rlike("[aeiouy].+s$"), _drop(w, 1))
        .otherwise(w)}


def _ending(suffixes):
    return lambda x: {"s": _suffix(x["w"], suffixes)}


def _is_cut(x):
    return {"cut": x["w"].rlike(r"[aeiouy].*(?:ingly|edly|ing|ed)$") & ~x["s"].isin("", "eed", "eedly")}


def _past(x):
    w, n = x["w"], F.length(x["s"])
    return {"w": F.when(x["cut"], _drop(w, n))
            .when(x["s"].isin("eed", "eedly") & _ends_in(x, n), F.concat(_drop(w, n), F.lit("ee"))).otherwise(w)}


def _repair(x):
    w = x["w"]
    short = (F.length(w) <= x["r1"]) & (w.rlike(SHORT_END) | w.rlike(SHORT_WHOLE))
    return {"w": F.when(~x["cut"], w)
            .when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(w.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _drop(w, 1))
            .when(short, F.concat(w, F.lit("e")))
            .otherwise(w)}


def _final_y(x):
    return {"w": F.regexp_replace(x["w"], "^(.+[^aeiouy])[yY]$", "$1i")}


def _derived(x):
    """Derivational suffixes in region 1."""
    w, s, n = x["w"], x["s"], F.length(x["s"])
    allowed = F.when(s == "ogi", F.endswith(w, F.lit("logi"))).when(s == "li", w.rlike(LI_ENDING)).otherwise(F.lit(True))
    return {"w": F.when((s != "") & _ends_in(x, n) & allowed, F.concat(_drop(w, n), _lookup(STEP2, s))).otherwise(w)}


def _derived_more(x):
    w, s, n = x["w"], x["s"], F.length(x["s"])
    allowed = F.when(s == "ative", _ends_in_2(x, n)).otherwise(F.lit(True))
    return {"w": F.when((s != "") & _ends_in(x, n) & allowed, F.concat(_drop(w, n), _lookup(STEP3, s))).otherwise(w)}


def _deleted(x):
    """Suffixes deleted in region 2."""
    w, s, n = x["w"], x["s"], F.length(x["s"])
    allowed = F.when(s == "ion", w.rlike("[st]ion$")).otherwise(F.lit(True))
    return {"w": F.when((s != "") & _ends_in_2(x, n) & allowed, _drop(w, n)).otherwise(w)}


def _final_e_and_l(x):
    w = x["w"]
    after_short = (F.length(w) >= 4) & ~F.regexp_replace(w, "e$", "").rlike(SHORT_END)
    return {"w": F.when(F.endswith(w, F.lit("ll")) & _ends_in_2(x, 1), _drop(w, 1))
            .when(F.endswith(w, F.lit("e")) & _ends_in_2(x, 1), _drop(w, 1))
            .when(F.endswith(w, F.lit("e")) & _ends_in(x, 1) & after_short, _drop(w, 1))
            .otherwise(w)}


def _stem(x):
    return F.when(F.length(x["raw"]) <= 2, x["raw"]).otherwise(
        F.coalesce(_lookup(IRREGULAR, x["raw"]), F.translate(x["w"], "Y", "y")))


#: Each step gives new values of some fields from those of the step before.
STEPS = (
    _apostrophes, _consonant_y, _head_1, _head_2, _plural, _ending(PAST), _is_cut, _past,
    _repair, _final_y, _ending(STEP2), _derived, _ending(STEP3), _derived_more, _ending(STEP4), _deleted, _final_e_and_l,
)


def stem_words(df: DataFrame, word: str, out: str) -> DataFrame:
    """``df`` with the stem of column ``word`` added as ``out``.

    One ``select`` per step keeps each generated expression small; the steps run in one stage.
    """
    given = df.columns
    t, fields = df.select(*given, F.lower(F.col(word)).alias("_raw")), ["raw"]
    for step in STEPS:
        now = {n: F.col(f"_{n}") for n in fields}
        now |= step(now)
        t, fields = t.select(*given, *[c.alias(f"_{n}") for n, c in now.items()]), list(now)
    return fenced(t, given, {out: _stem({n: F.col(f"_{n}") for n in fields})})


def stem_array(words: Column) -> Column:
    """``array<struct<word, at>>`` with each word replaced by its stem.

    Each step is a pass over the array, so every field is computed once per word.
    """
    def begin(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), F.lower(x["word"]).alias("raw"))

    def passing(step, fields):
        def run(x: Column) -> Column:
            now = {n: x[n] for n in fields}
            return F.struct(x["at"].alias("at"), *[c.alias(n) for n, c in (now | step(now)).items()])
        return run

    done, fields = F.transform(words, begin), ["raw"]
    for step in STEPS:
        done = F.transform(done, passing(step, fields))
        fields = list(dict.fromkeys([*fields, *_fields_of(step)]))
    return F.transform(done, lambda x: F.struct(_stem({n: x[n] for n in fields}).alias("word"), x["at"].alias("at")))


def _fields_of(step) -> list[str]:
    """Names of the fields a step gives."""
    return list(step({n: F.lit("") for n in ("raw", "w", "h1", "h2", "r1", "r2", "s", "cut")}))
