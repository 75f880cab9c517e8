"""Stand-ins that let the registered queries exercise every operator on the given tables.

The default phrase lists hardly occur in those texts, so most labeling queries use the lists
below, made of words that do.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.functions import vectors
from weakloom.functions.lexicons import with_negative_all
from weakloom.operators import features as ft
from weakloom.operators.hmm import HiddenStates
from weakloom.operators.labeling import NEGATIVE, NEUTRAL, POSITIVE
from weakloom.operators.stemming import vocabulary
from weakloom.sources import files

PHRASES = with_negative_all({
    "implementing": ["was", "from", "this", "be", "of the", "by"],
    "encouraging": ["for the", "it", "as the", "with", "are", "in the"],
    "base_words": ["thre", "wh", "ou", "er"],
    "budgets": ["rewh", "ononst", "thatin", "that", "er", "as the", "be"],
    "finance": ["nd", "tion", "in the", "ti", "edtion"],
    "funds": ["ing", "ed", "to the", "ble", "thon the in"],
    "financial_incentives": ["thble", "thti", "that the", "is a"],
    "specific_incentives": ["ention", " eron", "anea", "license"],
    "negative_verbs": ["die", "der", " und", "la", "que", "thing", "things"],
    "negative_adj": ["en", "le", "de", "only"],
    "negative_nouns": ["lich", "ment", "es", "un", "sh"],
    "negative_other": ["is the", "the of the"],
    "fines": ["stupid", "worthless", "thth", "queque"],
})

# A scored row counts as a hit from here on; the default threshold keeps next to nothing.
THRESHOLD = 0.10


# Three hidden states over the eight symbols of ``paragraph_symbol``.
STATES = HiddenStates(
    start=(0.5, 0.3, 0.2),
    step=((0.8, 0.15, 0.05), (0.1, 0.7, 0.2), (0.05, 0.25, 0.7)),
    emit=((0.30, 0.20, 0.15, 0.05, 0.15, 0.05, 0.05, 0.05), (0.05, 0.05, 0.05, 0.25, 0.05, 0.10, 0.15, 0.30),
          (0.10, 0.15, 0.10, 0.15, 0.10, 0.20, 0.10, 0.10)))
# Rules as sentences; the last two vote alike, and one votes on every row.
SENTENCES = {
    "has_license": 'label positive because the text contains "license" or "ention"',
    "fines_near_funds": "label negative because a phrase of negative_nouns is within 8 words of a phrase of funds",
    "short_text": "label neutral because the text has fewer than 120 words and does not contain \"license\"",
    "die_before_und": 'label negative because "die" comes before "und"',
    "many_budget_words": "label positive because at least 6 words of the text are in implementing",
    "any_length": "label neutral because the text has more than 0 words",
    "long_text": "label positive because the text has more than 300 words",
    "long_text_again": 'label positive because the text has more than 300 words or the text contains "no such words"',
}
# Characters from which a paragraph counts as long.
LONG_PARAGRAPH = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents, on all cores."""
    return files.spread(table(spark, sf_dir, "documents").select(*columns))


def gold_class(quality: Column, toxic: Column) -> Column:
    """Gold class of a labelled document, null where there is no label."""
    return (F.when(toxic == 1, F.lit(NEGATIVE)).when(quality == 1, F.lit(POSITIVE))
            .when(quality.isNotNull(), F.lit(NEUTRAL)))


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", gold_class(F.col("quality"), F.col("toxic")).alias("class"))


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their gold class, null for unlabelled ones."""
    return documents(spark, sf_dir, "doc_id", "lang", "text").join(
        gold_labels(spark, sf_dir), "doc_id", "left")


def title_path(text: Column) -> Column:
    """A path whose title words are the first five words of the text."""
    return F.concat(F.lit("../data/raw/"), F.array_join(F.slice(F.split(text, " ", -1), 1, 5), " "), F.lit(".pdf"))


def paragraph_symbol(text: Column) -> Column:
    """0 to 7: whether a paragraph holds a specific incentive (1), a negative noun (2), and is long (4)."""
    low = F.lower(text)
    hold = [functools.reduce(operator.or_, [low.contains(p) for p in PHRASES[g]]) for g in ("specific_incentives", "negative_nouns")]
    return hold[0].cast("int") + 2 * hold[1].cast("int") + 4 * (F.length(text) >= LONG_PARAGRAPH).cast("int")


def query_vector(spark: SparkSession, sf_dir: str) -> Column:
    """The embedding with id 0 as a scalar subquery."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").scalar()


def logits_and_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three logits, a soft target and a 0-based hard label per embedding."""
    e = F.col("embedding")

    def at(i: int) -> Column:
        return F.get(e, F.lit(i)).cast("double")

    mass = [F.abs(at(i)) + 0.01 for i in (3, 4, 5)]
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.array(*[at(i) * 10 for i in range(3)]).alias("logits"),
        F.array(*[m / (mass[0] + mass[1] + mass[2]) for m in mass]).alias("target"),
        (F.col("label") % 3).cast("int").alias("hard"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(token, vector)``: every token of the benchmark texts with the embedding whose id is
    five times the token's length."""
    words = vocabulary(table(spark, sf_dir, "benchmark"), "text")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"))
    return words.withColumn("_id", F.length("token") * 5).join(vectors, "_id").select("token", "vector")


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, features)``: the mean vector of a document's first tokens."""
    matrices = ft.encode_by_lookup(documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", token_vectors(spark, sf_dir), 64)
    return matrices.select("doc_id", vectors.mean_row(F.col("features"), 64).alias("features"))
