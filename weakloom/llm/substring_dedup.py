"""Substring dedup by level-wise doubling.

A span of ``width`` words goes when the same words also start in a document with a smaller id.
Shorter windows are examined first: only where a window repeats between documents is it extended to
twice its length, until ``width`` is reached or nothing repeats any more.

Below ``width`` a level does not look at every window. Each span stands for itself by the
window with the smallest hash among the windows inside it: equal spans choose equal windows, so no
repetition is lost, and most windows of a text are never shuffled.

Per level one aggregation by window hash (smallest and largest document, combined in the map tasks, so
a passage in a third of all documents is one row per task). What repeats goes into a bit set
of fixed size that lets most spans die before the next level. The last level is exact: of each
surviving span only the first document is kept, and every other document with it loses it.
The last comparison uses 96 bits of hash. Texts are shuffled only for documents that lose something.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.llm import bitmap
from weakloom.llm.store import stored
from weakloom.llm.words import BLANK, Words, mix, signed, slices, whole, windows, words_of

WIDTH = 13
SHORTEST = 4


def levels(width: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths: each at most twice the one before, the last is ``width``."""
    out = [width]
    while out[0] > 2 * shortest - 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def representatives(words: Words, length: int, width: int) -> np.ndarray:
    """For each span of ``width`` words the smallest hash of the windows of ``length`` in it."""
    h = windows(words.hashes, length, seed=length)
    n = len(words.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, width - length + 1):
        np.minimum(out, h[i:i + n], out=out)
    return out


def survivors(words: Words, width: int, known: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Spans inside one document that repeat at every shorter length examined so far."""
    alive = whole(words, width)
    for length, bits in known:
        at = np.flatnonzero(alive)
        if not len(at):
            break
        alive[at] = bitmap.contains(bits, representatives(words, length, width)[at])
    return alive


def _known(sent: list[tuple[int, Broadcast]]) -> list[tuple[int, np.ndarray]]:
    return [(length, b.value) for length, b in sent]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def level_rows(docs: DataFrame, length: int, width: int, sent: list[tuple[int, Broadcast]]) -> DataFrame:
    """``(hash, doc_id)`` of the windows that stand for surviving spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(sent)
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), BLANK)
                at = np.flatnonzero(survivors(words, width, known))
                if not len(at):
                    continue
                h, row = representatives(words, length, width)[at], words.row[at]
                new = np.ones(len(at), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[new])), pa.array(_ids(part)[row[new]])],
                                                 ["hash", "doc_id"])

    return docs.mapInArrow(run, "hash bigint, doc_id bigint")


def _spans(words: Words, alive: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, first and second hash of the spans alive."""
    at = np.flatnonzero(alive)
    first, second = windows(words.hashes, width, seed=1)[at], windows(words.hashes, width, seed=2)[at]
    return at, signed(first), (second >> np.uint64(32)).astype(np.uint32).view(np.int32)


def span_rows(docs: DataFrame, width: int, sent: list[tuple[int, Broadcast]]) -> DataFrame:
    """``(span, guard, doc_id)`` of the spans that outlived all shorter lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(sent)
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), BLANK)
                at, span, guard = _spans(words, survivors(words, width, known), width)
                if not len(at):
                    continue
                row = words.row[at]
                _, one = np.unique(mix(span.view(np.uint64) + mix(row.astype(np.uint64))), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(span[one]), pa.array(guard[one]), pa.array(_ids(part)[row[one]])],
                    ["span", "guard", "doc_id"])

    return docs.mapInArrow(run, "span bigint, guard int, doc_id bigint")


def _digest(words: Words, keep: np.ndarray, begin: int, end: int) -> str:
    """Hash of the kept words of one document, joined by one space."""
    at = begin + np.flatnonzero(keep[begin:end])
    data = words.data
    return hashlib.sha256(b" ".join(data[a:b].tobytes() for a, b in zip(words.starts[at], words.ends[at]))).hexdigest()


def digests(docs: DataFrame, width: int, sent: list[tuple[int, Broadcast]]) -> DataFrame:
    """Per document, as it came: word count, hash of its words, and number and XOR of its surviving spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(sent)
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), BLANK)
                at, span, _ = _spans(words, survivors(words, width, known), width)
                border = np.searchsorted(words.row[at], np.arange(part.num_rows + 1))
                kinds = [np.unique(span[border[i]:border[i + 1]]) for i in range(part.num_rows)]
                keep = np.ones(len(words.starts), bool)
                hashes = [_digest(words, keep, words.first[i], words.first[i + 1]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(signed(mix(_ids(part).astype(np.int64).view(np.uint64)))),
                     pa.array(np.diff(words.first)), pa.array(hashes, pa.string()),
                     pa.array([len(k) for k in kinds], pa.int64()),
                     pa.array([np.bitwise_xor.reduce(k) if len(k) else 0 for k in kinds], pa.int64())],
                    ["doc_id", "id_hash", "n_words", "digest", "n_spans", "xor_spans"])

    return docs.mapInArrow(run, "doc_id bigint, id_hash bigint, n_words bigint, digest string, n_spans bigint, "
                                "xor_spans bigint")


def texts_of(docs: DataFrame, flagged: Broadcast) -> DataFrame:
    """The rows whose id may be among the flagged ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bitmap.contains(flagged.value, mix(_ids(batch).astype(np.int64).view(np.uint64)))
            if hit.any():
                yield batch.filter(pa.array(hit))

    return docs.mapInArrow(run, "doc_id bigint, text string")


def strip(found: DataFrame, width: int, sent: list[tuple[int, Broadcast]], with_text: bool) -> DataFrame:
    """Remove from each document the surviving spans that are not listed as its own in ``own``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(sent)
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), BLANK)
                at, span, _ = _spans(words, survivors(words, width, known), width)
                border = np.searchsorted(words.row[at], np.arange(part.num_rows + 1))
                cover = np.zeros(len(words.starts) + 1, np.int64)
                own = part.column("own")
                for i in range(part.num_rows):
                    mine = slice(border[i], border[i + 1])
                    kept = own[i].values
                    gone = np.ones(mine.stop - mine.start, bool)
                    if kept is not None and len(kept):
                        gone = ~np.isin(span[mine], kept.to_numpy(zero_copy_only=False))
                    np.add.at(cover, at[mine][gone], 1)
                    np.add.at(cover, at[mine][gone] + width, -1)
                keep = np.cumsum(cover[:-1]) == 0
                counts = np.concatenate([[0], np.cumsum(~keep)])
                removed = counts[words.first[1:]] - counts[words.first[:-1]]
                hashes = [_digest(words, keep, words.first[i], words.first[i + 1]) for i in range(part.num_rows)]
                columns = [part.column("doc_id"), pa.array(np.diff(words.first)), pa.array(removed),
                           pa.array(hashes, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([_joined(words, keep, words.first[i], words.first[i + 1])
                                             for i in range(part.num_rows)], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names)

    kept = ", kept string" if with_text else ""
    return found.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + kept)


def _joined(words: Words, keep: np.ndarray, begin: int, end: int) -> str:
    at = begin + np.flatnonzero(keep[begin:end])
    return b" ".join(words.data[a:b].tobytes() for a, b in zip(words.starts[at], words.ends[at])).decode()


def remove_repeats(docs: DataFrame, width: int = WIDTH, shortest: int = SHORTEST, with_text: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_sha256``.

    ``with_text`` adds the ``kept`` words of every document that lost some (null: nothing was lost).

    Words are runs of anything but ASCII white space. Windows are judged on the input. Only
    ``doc_id`` and ``text`` are read; other columns may have any name. Null text has no words. Rows of
    one id count as one document for the judgement (none removes spans from another) and give a row
    each. A document without an id comes last in the order, and all such documents count as one. A
    document shorter than ``width`` words keeps them all. An empty table gives an empty table.
    """
    slim = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "text")
    sent: list[tuple[int, Broadcast]] = []
    for length in levels(width, shortest)[:-1]:
        seen = level_rows(slim, length, width, sent).groupBy("hash").agg(
            F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        bits = bitmap.gather(seen.where("low < high"), "hash")
        sent.append((length, bitmap.send(docs, bits)))
        if not bits.any():
            break
    first = span_rows(slim, width, sent).groupBy("span", "guard").agg(F.min("doc_id").alias("doc_id"))
    # Dealt by document before the lists are made: lists of one or two spans would weigh more than the spans.
    own = stored(first.select("doc_id", "span").repartition("doc_id").groupBy("doc_id").agg(
        F.collect_list("span").alias("own"), F.count("span").alias("n_own"), F.bit_xor("span").alias("xor_own")), "own-spans")
    seen = digests(slim, width, sent).join(own.select("doc_id", "n_own", "xor_own"), "doc_id", "left")
    same = (F.col("n_spans") == F.coalesce("n_own", F.lit(0))) & (F.col("xor_spans") == F.coalesce("xor_own", F.lit(0)))
    seen = stored(seen.withColumn("same", same), "span-digests")
    changed = seen.where("not same").select("doc_id", "id_hash").distinct()
    flagged = bitmap.send(docs, bitmap.gather(changed, "id_hash"))
    lists = changed.select("doc_id").join(own.select("doc_id", "own"), "doc_id", "left")
    touched = strip(texts_of(slim, flagged).join(lists, "doc_id"), width, sent, with_text)
    rest = seen.join(changed.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("digest").alias("kept_sha256"))
    return touched.unionByName(rest, allowMissingColumns=True).withColumn("doc_id", F.nullif("doc_id", F.lit((1 << 63) - 1)))
