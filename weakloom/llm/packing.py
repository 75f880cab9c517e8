"""Sum-of-squares packing of token pieces into sequences of fixed length.

Each piece goes where the sum over all residual gaps of (open sequences with that gap) squared becomes
smallest; a new sequence counts like any other place. Longest pieces come first, so the gaps
left by long pieces meet many short ones. Documents longer than a sequence are cut into full
pieces and a rest; nothing else is cut.

The pieces are dealt by hash into groups of about ``GROUP_ROWS``, and each group is packed by itself.
A group leaves about one sequence partly empty, so what the split costs does not grow with the data.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.llm.token_file import with_end
from weakloom.llm.tokens import encoder
from weakloom.llm.words import released, slices
from weakloom.session import durable

CAPACITY = 4096
GROUP_ROWS = 8192


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, keep_blanks: bool = False,
                 capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each piece of each document.

    Null text is empty and has the end id alone.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, keep_blanks).encode
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, border = with_end(*encode(rows.column("text")), end_id)
                counts = np.diff(border)
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(rows.num_rows), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[row] - start, capacity)
                ids = ids.astype("<u4", copy=False)
                sums = [zlib.crc32(ids[a:a + n]) for a, n in zip(border[row] + start, length)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start),
                     pa.array(length), pa.array(sums, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        released(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, placed in the given order."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences by gap; full ones don't count
    weight = np.zeros(capacity + 1, np.int64)  # twice the count, what one more or less changes
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    far = np.int64(1) << 40
    for i, size in enumerate(lengths.tolist()):
        # Change of the sum: the gap left gains one, the gap used loses one.
        change = weight[:capacity - size] + 1 if size < capacity else weight[:0]
        if len(change):
            change[0] = 0  # gap 0 does not count
            change = np.where(count[size:capacity] > 0, change - weight[size:capacity] + 1, far)
            best = int(change.argmin())
            value = change[best]
        else:
            best, value = 0, far
        fresh = weight[capacity - size] + 1 if size < capacity else 0
        if value <= fresh:
            gap = best + size
            at = open_with[gap].pop()
            count[gap] -= 1
            weight[gap] -= 2
        else:
            gap, at = capacity, made
            made += 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > size:
            open_with[gap - size].append(at)
            count[gap - size] += 1
            weight[gap - size] += 2
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens.

    ``pieces`` are computed once and stored with a number of the row, so that equal rows spread over the groups, too.
    Equal pieces of a group are placed one after the other; an empty table stays empty.
    """
    columns = pieces.columns
    pieces = durable(pieces.withColumn("pack_salt", F.monotonically_increasing_id()))
    groups = max(1, round(pieces.count() / group_rows))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "pack_salt"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                               ("ids_crc32", "ascending")])
        sequence, offset = sum_of_squares(table["length"].to_numpy(), capacity)
        base = np.int64(table["pack_group"][0].as_py()) << np.int64(32)
        return (table.drop_columns(["pack_group", "pack_salt"]).append_column("sequence_id", pa.array(base + sequence))
                .append_column("offset", pa.array(offset)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return dealt.groupBy("pack_group").applyInArrow(run, schema + ", sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, keep_blanks: bool = False,
                   capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document, with its sequence and place there.

    Only ``doc_id`` and ``text`` are read. Rows with the same id, or none, are packed as rows of their own.
    """
    return pack(token_pieces(docs, vocabulary, end_id, keep_blanks, capacity), capacity)
