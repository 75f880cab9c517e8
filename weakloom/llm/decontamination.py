"""Benchmark decontamination over a positional inverted index.

The index is sharded by document: one row per shard of about 2 MB of text holds, for every test term
that occurs in it, the ascending list of its positions (term by term, one flat array), and the documents with
their word counts. A shard is never larger than its text, whatever a source or a passage weighs, and any
executor can search it alone: nothing is shuffled, and no term has a list in one place.

Search goes window by window from the rarest test term (by counts over the whole corpus): its list, moved
back by the term's offset, gives the candidate starts, which are then intersected with the lists of
the other terms in ascending order of their counts, each moved by its own offset. What survives all
terms is an exact phrase. For proximity, each list only has to have a position near the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.llm.words import NOT_ALNUM, released, signed, slices, words_of
from weakloom.session import durable, fresh_path

WINDOW = 10
#: Words of test items searched at once; more items are searched in further blocks.
BLOCK_WORDS = 1_000_000
#: Distinct test terms up to which the index leaves out all other terms; 8 bytes each.
VOCABULARY_TERMS = 4_000_000


class TestBlock(NamedTuple):
    """Test windows of some items."""

    items: list[str]  # names of the items
    terms: np.ndarray  # hash of each word of the items, one after the other
    window_start: np.ndarray  # first word of each window among ``terms``
    window_length: np.ndarray
    window_item: np.ndarray  # item of each window
    vocabulary: np.ndarray  # distinct hashes, sorted


def test_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[TestBlock]:
    """Read the test items in blocks of bounded size. Null texts and texts without words have no window."""
    names: list[str] = []
    hashes: list[np.ndarray] = []
    held = 0
    for row in items.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        words = words_of(pa.array([row.text], pa.string()), NOT_ALNUM, fold=True).hashes
        if not len(words) or row.item is None:
            continue
        names.append(row.item)
        hashes.append(words)
        held += len(words)
        if held >= block_words:
            yield _block(names, hashes, window)
            names, hashes, held = [], [], 0
    if names:
        yield _block(names, hashes, window)


def _block(names: list[str], hashes: list[np.ndarray], window: int) -> TestBlock:
    starts, lengths, owners = [], [], []
    base = 0
    for i, words in enumerate(hashes):
        n = max(1, len(words) - window + 1)
        starts.append(base + np.arange(n))
        lengths.append(np.full(n, min(window, len(words))))
        owners.append(np.full(n, i))
        base += len(words)
    terms = np.concatenate(hashes)
    return TestBlock(names, terms, np.concatenate(starts), np.concatenate(lengths), np.concatenate(owners),
                     np.unique(terms))


def vocabulary_of(items: DataFrame, most: int = VOCABULARY_TERMS) -> np.ndarray | None:
    """Sorted hashes of all terms of the items, or None if there are more than ``most``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = np.unique(words_of(part.column("text"), NOT_ALNUM, fold=True).hashes)
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes))], ["term"])

    found = items.select("text").mapInArrow(run, "term bigint").distinct().limit(most + 1).toArrow()
    return None if len(found) > most else np.sort(found["term"].to_numpy().view(np.uint64))


def build_index(docs: DataFrame, vocabulary: Broadcast | None) -> DataFrame:
    """One row per shard: its number, documents, their word counts, terms, list borders and positions.

    Positions count the words of the shard, document after document. Given a vocabulary, terms outside are left out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"), NOT_ALNUM, fold=True)
                at, hashes = np.arange(len(words.hashes)), words.hashes
                if vocabulary is not None and len(vocabulary.value):
                    known = vocabulary.value
                    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
                elif vocabulary is not None:
                    at = at[:0]
                order = at[np.argsort(hashes[at], kind="stable")]
                kinds, begin = np.unique(hashes[order], return_index=True)
                lists = [np.diff(words.first), signed(kinds), np.append(begin, len(at)), order.astype(np.int32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), _one(part.column("doc_id")), *[_one(pa.array(x)) for x in lists]],
                    ["shard", "doc_ids", "n_words", "terms", "begins", "positions"])
                number += 1

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        released(run), "shard bigint, doc_ids array<bigint>, n_words array<bigint>, terms array<bigint>, begins array<bigint>, "
             "positions array<int>")


def _one(values: pa.Array) -> pa.ListArray:
    """All values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def term_counts(index: DataFrame) -> DataFrame:
    """``(term, n)``: positions of each term over the corpus, from the list borders alone."""
    pairs = F.explode(F.arrays_zip(
        F.col("terms"), F.transform("terms", lambda _, i: F.get("begins", i + 1) - F.get("begins", i)).alias("n")))
    return index.select(pairs.alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.n").alias("n"))


class Shard(NamedTuple):
    """One row of the index, and the place of each of its terms."""

    doc_ids: pa.Array
    first: np.ndarray  # first word of each document, and the number of words
    terms: np.ndarray
    begins: np.ndarray
    keys: np.ndarray  # term number and position as one ascending number
    positions: np.ndarray
    step: int


def _shard(row: dict[str, pa.Array]) -> Shard:
    positions = row["positions"].to_numpy(zero_copy_only=False).astype(np.int64)
    begins = row["begins"].to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(row["n_words"].to_numpy(zero_copy_only=False))]).astype(np.int64)
    step = int(first[-1]) + 1
    number = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    return Shard(row["doc_ids"], first, row["terms"].to_numpy(zero_copy_only=False).view(np.uint64), begins,
                 number * step + positions, positions, step)


def _terms_of(shard: Shard, hashes: np.ndarray) -> np.ndarray:
    """Number of each term in the shard, -1 for those it lacks."""
    if not len(shard.terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(shard.terms, hashes), len(shard.terms) - 1)
    return np.where(shard.terms[at] == hashes, at, -1)


def _near(shard: Shard, term: np.ndarray, position: np.ndarray, slack: int) -> np.ndarray:
    """Whether each term has a position within ``slack`` of the given one, in the same document."""
    low, top = position, position
    if slack:
        doc = np.searchsorted(shard.first, position, side="right") - 1
        low, top = np.maximum(position - slack, shard.first[doc]), np.minimum(position + slack, shard.first[doc + 1] - 1)
    low = np.searchsorted(shard.keys, term * shard.step + low)
    return (low < len(shard.keys)) & (shard.keys[np.minimum(low, len(shard.keys) - 1)] <= term * shard.step + top)


def search(shard: Shard, block: TestBlock, counts: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows found in a shard and where they start. ``counts`` are corpus counts by vocabulary place.

    With ``slack`` the terms may stand that many words off their places, in any order.
    """
    found_w, found_p = [], []
    local = _terms_of(shard, block.terms)
    rank = counts[np.searchsorted(block.vocabulary, block.terms)]
    for length in np.unique(block.window_length):
        of = np.flatnonzero(block.window_length == length)
        place = block.window_start[of, None] + np.arange(length)
        of = of[(local[place] >= 0).all(axis=1)]  # every term must occur at all
        if not len(of):
            continue
        place = block.window_start[of, None] + np.arange(length)
        order = np.argsort(rank[place], axis=1, kind="stable")
        rarest = order[:, 0]
        term = local[place[np.arange(len(of)), rarest]]
        size = shard.begins[term + 1] - shard.begins[term]
        window = np.repeat(np.arange(len(of)), size)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(size) - size, size)
        start = shard.positions[np.repeat(shard.begins[term], size) + inside] - np.repeat(rarest, size)
        if slack:  # the rarest term may itself stand off its place
            shifts = np.arange(-slack, slack + 1)
            window, start = np.repeat(window, len(shifts)), (start[:, None] + shifts).ravel()
        doc = np.searchsorted(shard.first, start, side="right") - 1
        ok = (start >= 0) & (doc >= 0)
        ok[ok] = start[ok] + length <= shard.first[np.minimum(doc[ok] + 1, len(shard.first) - 1)]
        window, start = window[ok], start[ok]
        for k in range(0 if slack else 1, length):  # a shift may have left the document of the rarest term
            if not len(window):
                break
            offset = order[window, k]
            ok = _near(shard, local[place[window, offset]], start + offset, slack)
            window, start = window[ok], start[ok]
        found_w.append(of[window])
        found_p.append(start)
    if not found_w:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_w), np.concatenate(found_p)


_MATCHES = ("shard bigint, doc bigint, doc_id bigint, n_words bigint, begins array<bigint>, ends array<bigint>, "
            "items array<string>")


def matches(index: DataFrame, block: Broadcast, counts: Broadcast, slack: int = 0) -> DataFrame:
    """Per document of the index the covered runs of words and the items found in it.

    ``(shard, doc)`` tells rows apart whose ids are equal or missing. The shard number comes with the index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestBlock = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _shard({n: batch.column(n)[i].values for n in ("doc_ids", "n_words", "terms", "begins", "positions")})
                window, start = search(shard, tests, counts.value, slack)
                yield _documents(shard, batch.column("shard")[i].as_py(), tests, window, start)

    return index.mapInArrow(run, _MATCHES)


def _documents(shard: Shard, number: int, tests: TestBlock, window: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    n = len(shard.first) - 1
    cover = np.zeros(int(shard.first[-1]) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + tests.window_length[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1]
    end[:-1] &= ~hit[1:]
    some = np.diff(shard.first) > 0  # a run ends with its document
    heads, tails = shard.first[:-1][some], shard.first[1:][some] - 1
    begin[heads], end[tails] = hit[heads], hit[tails]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    doc = np.searchsorted(shard.first, begins, side="right") - 1
    border = np.searchsorted(doc, np.arange(n + 1))
    base = shard.first[doc] if len(doc) else doc
    items: list[list[str]] = [[] for _ in range(n)]
    pairs = np.unique(np.stack([np.searchsorted(shard.first, start, side="right") - 1, tests.window_item[window]]), axis=1)
    for d, item in pairs.T.tolist():
        items[d].append(tests.items[item])
    borders = pa.array(border.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, number)), pa.array(np.arange(n)), shard.doc_ids, pa.array(np.diff(shard.first)),
         pa.ListArray.from_arrays(borders, pa.array(begins - base)), pa.ListArray.from_arrays(borders, pa.array(ends - base)),
         pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
        ["shard", "doc", "doc_id", "n_words", "begins", "ends", "items"])


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = 0,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: ``doc_id, n_words, begins, ends, items`` (covered runs of words, ids of items found).

    Words are runs of ASCII digits, letters and everything outside ASCII, with A-Z lower-cased.
    An item of fewer words than ``window`` is one window. ``slack`` 0 finds exact phrases; more finds windows
    whose terms all stand within that many words of their places. Every row of ``docs`` gives one row, also
    with null text (no words), null id or an id that occurs twice. Without items nothing is found. Other columns are not
    read. The index is written to the shared folder, once per block of test items.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary_of(items)
    path = fresh_path(spark, "positions")
    build_index(docs, None if vocabulary is None else spark.sparkContext.broadcast(vocabulary)).write.parquet(path)
    index = spark.read.parquet(path)
    blocks = test_blocks(items, window, block_words)
    found, more = _found(index, next(blocks, _NOTHING), slack), next(blocks, None)
    if more is None:
        return found.drop("shard", "doc")
    found = durable(found)
    while more is not None:
        found, more = found.unionByName(durable(_found(index, more, slack))), next(blocks, None)
    return found.groupBy("shard", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends", "items")]).drop("shard", "doc")


_NOTHING = TestBlock([], *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))


def _found(index: DataFrame, block: TestBlock, slack: int) -> DataFrame:
    """Matches of one block, with the corpus counts of its terms."""
    spark = index.sparkSession
    counts = np.zeros(len(block.vocabulary), np.int64)
    if len(counts):
        terms = spark.createDataFrame(pa.table({"term": signed(block.vocabulary)}))
        counted = term_counts(index).join(F.broadcast(terms), "term").toArrow()
        counts[np.searchsorted(block.vocabulary, counted["term"].to_numpy().view(np.uint64))] = counted["n"].to_numpy()
    return matches(index, spark.sparkContext.broadcast(block), spark.sparkContext.broadcast(counts), slack)


def covered(begins: Column, ends: Column) -> Column:
    """Words in any of the runs, which may overlap."""
    runs = F.array_sort(F.arrays_zip(begins.alias("a"), ends.alias("b")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(
        runs, start,
        lambda s, r: F.struct((s.n + F.greatest(F.lit(0), r["b"] - F.greatest(s.upto, r["a"]))).alias("n"),
                              F.greatest(s.upto, r["b"]).alias("upto")),
        lambda s: s.n)


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``find`` gives."""
    items = F.array_sort(F.array_distinct("items"))
    n_hit = covered(F.col("begins"), F.col("ends"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
