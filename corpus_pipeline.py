"""The whole preparation of a corpus: language, lines, near copies, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)``, with ``docs`` holding the columns of ``documents`` (and any others), and
works on everything the stage before kept. ``run`` writes each result to the shared folder and reads it again.

* language_id drops documents without a letter (or text), for which no language can be told.
* line_dedup takes out lines that are near an earlier one, and drops documents that lose all lines.
* near_duplicates keeps, of each group of linked texts, the row with the smallest id, and the first of those without an id. Each row
  is a text of its own, those of one id included; ties go to the row that stands first.
* decontamination drops documents with a passage of a benchmark item.
* packing returns the pieces of the remaining documents and their places in sequences of 4096 tokens.

Stages that send texts to Python have Spark do so in small batches (``small_batches``). Their results are computed later, so the setting stays in
the session; ``run``, which computes them, takes it back.

SQL cannot express the first and the last stage, so there is no SQL for the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.llm import decontamination, jaccard_join, language_id, line_dedup, packing
from weakloom.llm.store import stored
from weakloom.llm.tokens import vocabulary_path
from weakloom.session import BATCH_SETTING, small_batches


def _aside(docs: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its own columns of these names renamed, and how to name them back."""
    taken = {c.lower() for c in docs.columns}
    back = {}
    for c in docs.columns:
        if c.lower() in names:
            free = next(f"{c}_{i}" for i in range(len(taken) + 1) if f"{c}_{i}".lower() not in taken)
            back[free] = c
    return docs.withColumnsRenamed({c: free for free, c in back.items()}), back


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language."""
    small_batches(spark)
    known = docs.where(~language_id.held_out(F.col("doc_id")))
    profiles = language_id.fit(known.select("text", "lang"))
    own, back = _aside(docs, ("lang_pred", "score"))
    found = language_id.predict(own, profiles).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.drop("lang_pred", "score").withColumnsRenamed(back)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near an earlier line."""
    own, back = _aside(docs, ("n_lines", "n_removed", "n_near"))
    left = line_dedup.without_repeats(own)
    left = left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.drop("n_lines", "n_removed", "n_near").withColumnsRenamed(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group of linked texts, and the first of those without an id.

    Rows are numbered in a table, so what goes is a column of numbers, and no text is compared. Those that go are looked up and not those that stay:
    they are few, and texts need not be moved to meet them.
    """
    small_batches(spark)
    own, back = _aside(docs, ("row_number",))
    numbered = stored(own.withColumn("row_number", F.monotonically_increasing_id()), "numbered-documents")
    found = jaccard_join.near_duplicates(numbered.select(F.col("row_number").alias("doc_id"), "text"), width=5, percent=80)
    groups = found.select(F.col("doc_id").alias("row_number"), F.col("component_id").alias("group"))
    ids = numbered.select("row_number", "doc_id")
    # Of several rows of one id in a group the first in the table stays.
    first = ids.join(groups, "row_number").groupBy("group", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "row_number")).alias("first"))
    gone = stored(ids.select("row_number").join(first.select("first.row_number"), "row_number", "left_anti"), "near-duplicates")
    return numbered.join(gone, "row_number", "left_anti").drop("row_number").withColumnsRenamed(back)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Rows are told apart by id and text."""
    small_batches(spark)
    key = F.xxhash64("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find(docs.select(key.alias("doc_id"), "text"), items)
    hit = stored(found.where(F.size("items") > 0).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, key == hit["_hit"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' tokens in training sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("language_id", drop_unknown_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language profiles and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    changed = small_batches(spark)
    try:
        for name, stage in STAGES:
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        if changed:
            spark.conf.unset(BATCH_SETTING)
    return docs
