"""What is held at once by executors and their Python workers."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weakloom.llm import jaccard_join
from weakloom.llm.words import released
from weakloom.session import BATCH_BYTES, BATCH_SETTING

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def texts(spark, tmp_path):
    """150 documents of 100 KB in one partition, and no benchmark items."""
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    yield spark.range(150).coalesce(1).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("Word"), F.col("id").cast("string"), F.lit(" ")), 100_000 // 8).alias("text"), F.lit("en").alias("lang"))
    spark.conf.unset(BATCH_SETTING)


@pytest.mark.parametrize("stage", ["language_id", "near_duplicates", "decontamination", "packing"])
def test_texts_are_sent_in_small_batches(spark, texts, tmp_path, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    dict(corpus_pipeline.STAGES)[stage](spark, texts, str(tmp_path))
    found = [r.size for r in texts.mapInArrow(sizes, "size bigint").collect()]
    assert sum(found) > 2 * BATCH_BYTES and max(found) < 1.5 * BATCH_BYTES


def test_settings_of_the_session_stay(spark, texts, tmp_path):
    texts.limit(3).write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path))
    assert BATCH_SETTING not in spark.conf.getAll
    spark.conf.set(BATCH_SETTING, "1m")
    corpus_pipeline.run(spark, str(tmp_path))
    assert spark.conf.get(BATCH_SETTING) == "1m"


def test_frequent_tokens_do_not_depend_on_batches(spark):
    docs = spark.range(8).coalesce(1).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four x"), F.col("id").cast("string")).alias("text"))
    spark.conf.set(RECORDS, "2")
    try:
        found = jaccard_join.survey(docs, 4).where("token is not null").collect()
    finally:
        spark.conf.unset(RECORDS)
    assert [r.n for r in found] == [8]


def test_freed_memory_is_given_back():
    def run(batches):
        for batch in batches:
            yield batch

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    small = [bytes(1000) for _ in range(100_000)]
    held = small[::100]  # what stays keeps the allocator's arenas
    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    full = resident()
    del small
    assert list(released(run)(iter([batch]))) == [batch]
    assert len(held) == 1000 and full - resident() > 20_000_000
