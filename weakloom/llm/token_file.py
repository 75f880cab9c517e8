"""Token ids as Parquet list columns, in key order, for selective reads.

One row per document: ``key``, ``part``, ``place`` (ids of the same part before it), ``n_tokens`` and
``ids``. Parts are range partitions of the key, one file each, so a reader after some keys opens few
files, and the page index of the sorted key column then skips pages. Metadata is read without the ids.
The place over the whole corpus is ``place`` plus the ids in earlier parts: a sum over one row per part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.llm.tokens import encoder
from weakloom.llm.words import slices

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000

#: Dictionary pages hold a whole vocabulary; without one, version 2 files store differences.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(4 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int, keep_blanks: bool = True, key: str = "doc_id",
              text: str = "text", encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
              page_bytes: int = PAGE_BYTES, mode: str = "errorifexists") -> None:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending key order.

    Null text is empty and has the end id alone. Rows without a key come first; rows of one key follow
    each other in the order of their texts. Other columns are not read. An empty table
    gives files without rows. ``encoding`` is ``dictionary`` or ``delta``.
    """
    slim = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = slim.repartitionByRange("key").sortWithinPartitions("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, keep_blanks).encode
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, border = encode(rows.column("text"))
                ids, border = with_end(ids, border, end_id)
                counts = np.diff(border)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key"), pa.array(np.full(rows.num_rows, part, np.int32)),
                     pa.array(place + border[:-1]), pa.array(counts),
                     pa.ListArray.from_arrays(pa.array(border.astype(np.int32)), pa.array(ids.view(np.int32)))],
                    ["key", "part", "place", "n_tokens", "ids"])
                place += int(border[-1])

    rows = ordered.mapInArrow(run, "key bigint, part int, place bigint, n_tokens bigint, ids array<int>")
    (rows.write.mode(mode).options(**ENCODINGS[encoding])
     .option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
     .option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path))


def with_end(ids: np.ndarray, border: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id after the ids of each text."""
    n = len(border) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    mine = np.ones(len(out), bool)
    mine[border[1:] + np.arange(n)] = False
    out[mine] = ids
    return out, border + np.arange(n + 1)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``key, start, n_tokens``: where each document's ids are in the whole corpus; no ids are read."""
    return _with_start(spark, path, spark.read.parquet(path).select("key", "part", "place", "n_tokens"))


def read_ids(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """``key, start, n_tokens, ids`` of all documents, or of those that ``where`` (over ``key`` or ``n_tokens``) selects."""
    rows = spark.read.parquet(path)
    return _with_start(spark, path, rows if where is None else rows.where(where))


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row per file, whatever the number of documents.
    offsets = parts.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("place")).drop(
        "part", "_before", "place")


def checksums(rows: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of rows with ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, border = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(border[:-1], border[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                ["key", "start", "n_tokens", "ids_crc32"])

    return rows.select("key", "start", "n_tokens", "ids").mapInArrow(
        run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
