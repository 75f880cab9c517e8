"""Stems by vocabulary: distinct words first, then one cheap pass over them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.functions import literals as lit
from weakloom.functions import tokens as tk
from weakloom.functions.forms import may_have_stem
from weakloom.functions.stem import stem_words
from weakloom.operators.skew import salted_join


def vocabulary(df: DataFrame, text: str, keep: Column | None = None) -> DataFrame:
    """Distinct tokens of a text column.

    Repetitions are dropped inside the row and again before the shuffle, so no frequent word
    makes a heavy partition.
    """
    words = df.select(F.explode(F.array_distinct(tk.tokens(F.col(text)))).alias("token"))
    if keep is not None:
        words = words.where(keep)
    return words.distinct()


def stemmed_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``(token, stem)`` for every distinct token of the text."""
    return stem_words(vocabulary(df, text), "token", "stem")


def lexicon_words(groups: Mapping[str, Iterable[str]]) -> list[str]:
    """Distinct non-empty words of all phrases."""
    return sorted({w.lower() for phrases in groups.values() for p in phrases
                   for w in tk.phrase_words(p) if w})


def stem_table(spark: SparkSession, words: list[str]) -> dict[str, str]:
    """Stems of a phrase list's words or forms; as small as the list itself."""
    frame = spark.range(1).select(F.explode(F.split(F.lit("\n".join(words)), "\n")).alias("word"))
    return {r.word: r.stem for r in stem_words(frame, "word", "stem").collect()} if words else {}


def stem_phrases(groups: Mapping[str, list[str]], stems: Mapping[str, str]) -> dict[str, list[str]]:
    """Phrases with each word replaced by its stem; order and repetitions stay."""
    return {
        name: [" ".join(stems.get(w.lower(), w.lower()) for w in tk.phrase_words(p)) for p in phrases]
        for name, phrases in groups.items()
    }


def surface_forms(df: DataFrame, text: str, stems: Mapping[str, str]) -> DataFrame:
    """``(token, stem)`` of the text's tokens that share a stem with a phrase word.

    Tokens that cannot share one are dropped before the shuffle.
    """
    wanted = sorted(set(stems.values()))
    candidates = vocabulary(df, text, may_have_stem(wanted)(F.col("token")))
    return stem_words(candidates, "token", "stem").where(f"stem IN ({lit.strings(wanted)})")


def occurrences_by_join(df: DataFrame, key: str, text: str, forms: DataFrame, stems: Iterable[str] | None = None) -> DataFrame:
    """``(key, hits)``: matching tokens of each row found by joining on the token.

    Rows without a match are absent. A token found everywhere is spread over tasks. Only tokens that occur in ``forms`` reach the second
    shuffle, and what is gathered per key is a part of that row's own text. If ``forms`` has no other stems than ``stems``, tokens that
    cannot have one of them do not reach the first.
    """
    exploded = df.select(key, F.posexplode(tk.tokens(F.col(text))).alias("at", "token"))
    if stems is not None:
        exploded = exploded.where(may_have_stem(stems)(F.col("token")))
    matched = salted_join(exploded, forms, "token", [key, "at"])
    return matched.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("at"), F.col("stem").alias("word")))).alias("_found")
    ).select(key, F.transform("_found", lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"))).alias("hits"))
