"""N-gram Jaccard join with skipping by set relations.

Sets of equal shingles are folded into one first, and one document stands for them. Every such set indexes its prefix: the tokens of which two
sets at the threshold must share one, rarest first, so that a passage in very many documents stays out of the prefixes. (How
frequent a token is, is known for the most frequent ones, from runs of texts and from first prefixes; any order common to all
sets gives right results.) Only lists
of two sets and more matter: which prefix tokens repeat is found by one aggregation and a bit set of fixed size.

The lists are then used without comparing all pairs in them:

* Round one compares each set only with the leader of each of its lists, the set with most tokens in lists.
  Sets that are linked through leaders are done with each other.
* Round two cuts each list that still holds several components into blocks, one per leader, with the smallest
  and largest size and the lowest position of its sets. A pair of blocks is skipped if sizes or positions rule out the
  overlap, or if the answer of the leaders does: with X and Y compared, a set like X has at most
  |X & Y| plus what it has beyond X in common with Y. So it is if the leaders turn out to be linked, or if both
  blocks hold nothing but their leaders. Blocks that are left are expanded.

Sets that share a frequent token by chance make pairs that grow faster than the documents, and a pair moves a whole set to where it is compared.
So each set has a profile of a few bits per token, which bounds its overlap with another from above: pairs that cannot reach what
they are asked for end there. What is left is compared in as many parts as keep the sets moved at once below those held.

A skipped pair is below the threshold or inside one component, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.llm import bitmap
from weakloom.llm.graph import components
from weakloom.llm.store import Scratch
from weakloom.llm.words import BLANK, mix, released, signed, slices, whole, windows, words_of

SHINGLE = 4
PERCENT = 85
#: Tokens whose frequency is known to the order; more does not change any result.
FREQUENT = 1 << 18
#: A token counts as frequent where so many of the different sets met one after the other have it.
FREQUENT_IN_BATCH = 4
#: Tokens of sets looked at together for that, and different sets remembered, so that copies count once; bound the memory of a worker.
TOGETHER = 2_000_000
SEEN = 10_000
#: Bits of a profile for each token, at least; a profile has a power of two of them.
PROFILE = 2
#: Bytes of profiles looked at together.
PROFILES_TOGETHER = 1 << 20
#: Tokens of sets that pairs may move at once in any case.
MOVED = 1 << 27
_NO_ID = (1 << 63) - 1


class Sets(NamedTuple):
    """Distinct shingles of a slice of texts, sorted by text and hash."""

    row: np.ndarray
    token: np.ndarray
    first: np.ndarray  # border of each text
    high: np.ndarray  # 128 bits that stand for each set
    low: np.ndarray


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Sets:
    words = words_of(texts, BLANK, fold=True)
    n_rows = len(texts)
    keep = np.flatnonzero(whole(words, width))
    tokens, rows = [windows(words.hashes, width)[keep]], [words.row[keep]]
    counts = np.diff(words.first)
    for n in range(1, width):  # a shorter text is one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            tokens.append(windows(words.hashes, n, seed=n)[words.first[short]])
            rows.append(short)
    token, row = np.concatenate(tokens), np.concatenate(rows)
    order = np.argsort(token)
    order = order[np.argsort(row[order].astype(np.uint16 if n_rows < 1 << 16 else np.int64), kind="stable")]
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    token, row = token[new], row[new]
    first = np.searchsorted(row, np.arange(n_rows + 1))
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(token ^ np.uint64(salt)))]) for salt in (0x51, 0xA7)]
    high, low = (mix(s[first[1:]] - s[first[:-1]] + np.diff(first).astype(np.uint64)) for s in sums)
    return Sets(row, token, first, high, low)


def profiles(sets: Sets) -> pa.Array:
    """A bit set of its tokens for each set, of ``PROFILE`` to twice as many bits per token."""
    n = np.diff(sets.first)
    bits = np.where(n > 0, np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1) * PROFILE)).astype(np.int64)), 0)
    first = np.concatenate([[0], np.cumsum(bits)])
    held = np.zeros(first[-1], bool)
    held[first[sets.row] + (sets.token & (bits[sets.row] - 1).astype(np.uint64)).astype(np.int64)] = True
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((first >> 3).astype(np.int32)), pa.py_buffer(np.packbits(held, bitorder="little"))])


def _cut(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of binary values, and the first of each and the end."""
    first = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    return np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8), first


def _folded(rows: np.ndarray, size: int) -> np.ndarray:
    """Profiles as they are with fewer bits."""
    while rows.shape[1] > size:
        half = rows.shape[1] // 2
        rows = rows[:, :half] | rows[:, half:]
    return rows


def most_shared(a: pa.Array, b: pa.Array, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """No fewer than the tokens that sets of these profiles and sizes share: a bit that only one has stands for a token at least."""
    out = np.minimum(n_a, n_b)
    (data_a, first_a), (data_b, first_b) = _cut(a), _cut(b)
    size_a, size_b = np.diff(first_a), np.diff(first_b)
    for x, y in set(zip(size_a.tolist(), size_b.tolist())):
        rows = np.flatnonzero((size_a == x) & (size_b == y))
        step = max(1, PROFILES_TOGETHER // max(x, y, 1))
        for at in (rows[k:k + step] for k in range(0, len(rows), step)):
            own = _folded(data_a[first_a[at][:, None] + np.arange(x)], min(x, y))
            other = _folded(data_b[first_b[at][:, None] + np.arange(y)], min(x, y))
            lost = [np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((own, other), (other, own))]
            out[at] = np.minimum(n_a[at] - lost[0], n_b[at] - lost[1])
    return out


def survey(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, high, low, profile`` of each document, and ``token, n`` (no id) of tokens frequent among ``TOGETHER`` tokens, whatever batches they come in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        tokens: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                count = np.diff(sets.first)
                new = np.zeros(part.num_rows, bool)
                for i, key in enumerate(zip(sets.high.tolist(), sets.low.tolist())):
                    if key not in seen:
                        seen.add(key)
                        new[i] = True
                if len(seen) >= SEEN:
                    seen.clear()
                tokens.append(sets.token[new[sets.row]])
                yield _rows(part.column("doc_id"), count, sets.high, sets.low, None, profiles(sets))
                if sum(map(len, tokens)) >= TOGETHER:
                    yield _rows(None, *_frequent(tokens))
                    tokens = []
        yield _rows(None, *_frequent(tokens))

    return docs.mapInArrow(released(run), "doc_id bigint, n bigint, high bigint, low bigint, token bigint, profile binary")


def _frequent(tokens: list[np.ndarray]) -> tuple[np.ndarray, None, None, np.ndarray]:
    """How many of the sets have each frequent token."""
    ordered = np.concatenate([np.zeros(0, np.uint64), *tokens])
    ordered.sort()
    far = FREQUENT_IN_BATCH - 1
    some = np.unique(ordered[far:][ordered[far:] == ordered[:len(ordered) - far]])
    return np.searchsorted(ordered, some, side="right") - np.searchsorted(ordered, some), None, None, some


def _rows(doc_id, n, high, low, token, profile=None) -> pa.RecordBatch:
    def column(values: np.ndarray | None) -> pa.Array:
        return pa.nulls(len(n), pa.int64()) if values is None else pa.array(signed(values))

    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(n), pa.int64()) if doc_id is None else doc_id, pa.array(n.astype(np.int64)), column(high), column(low), column(token),
         pa.nulls(len(n), pa.binary()) if profile is None else profile],
        ["doc_id", "n", "high", "low", "token", "profile"])


class Order(NamedTuple):
    """Frequent tokens by value, and their rank by frequency (from 2). All others come first: those not known to be in two sets, then those
    that may be (1)."""

    token: np.ndarray
    rank: np.ndarray
    repeated: np.ndarray | None = None


def order_of(counts: DataFrame, repeated: np.ndarray | None = None) -> Order:
    """The order from ``token, n``, which may hold a token more than once, and a bit set of tokens known to be in two sets."""
    best = counts.groupBy("token").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "token")
    found = best.limit(FREQUENT).toArrow()
    token, n = found["token"].to_numpy().view(np.uint64), found["n"].to_numpy()
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(2, len(token) + 2)
    by_value = np.argsort(token)
    return Order(token[by_value], rank[by_value], repeated)


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens a set must share with any partner."""
    return -(-percent * n // 100)


def prefixes(sets: Sets, order: Order, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each prefix token among the tokens of the slice, and its position in its set."""
    if not len(sets.token):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.zeros(len(sets.token), np.int64)
    if order.repeated is not None:
        rank += bitmap.contains(order.repeated, sets.token)
    if len(order.token):
        at = np.minimum(np.searchsorted(order.token, sets.token), len(order.token) - 1)
        rank = np.where(order.token[at] == sets.token, order.rank[at], rank)
    by = np.argsort(sets.row.astype(np.int64) * (FREQUENT + 2) + rank, kind="stable")
    size = np.diff(sets.first)
    place = np.arange(len(by)) - np.repeat(sets.first[:-1], size)
    inside = place < np.repeat(size - need(size, percent) + 1, size)
    return by[inside], place[inside]


def _of_classes(batch: pa.RecordBatch, nodes: np.ndarray) -> pa.RecordBatch:
    """The rows of a slice that may stand for a class of equal sets."""
    return batch.filter(pa.array(bitmap.contains(nodes, hashed_id(batch.column("doc_id").to_numpy()))))


def prefix_tokens(docs: DataFrame, nodes: Broadcast, order: Broadcast, width: int, percent: int) -> DataFrame:
    """``token`` of all prefixes of the documents that stand for their class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                part = _of_classes(part, nodes.value)
                if not part.num_rows:
                    continue
                sets = shingle_sets(part.column("text"), width)
                at, _ = prefixes(sets, order.value, percent)
                yield pa.RecordBatch.from_arrays([pa.array(signed(sets.token[at]))], ["token"])

    return docs.mapInArrow(released(run), "token bigint")


def postings_of(docs: DataFrame, nodes: Broadcast, order: Broadcast, repeated: Broadcast, width: int, percent: int) -> DataFrame:
    """``doc_id, n, token, place`` of the prefix tokens that may be repeated; ``weight`` counts those of the document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                part = _of_classes(part, nodes.value)
                if not part.num_rows:
                    continue
                sets = shingle_sets(part.column("text"), width)
                at, place = prefixes(sets, order.value, percent)
                hit = bitmap.contains(repeated.value, sets.token[at])
                at, place = at[hit], place[hit]
                row = sets.row[at]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(np.diff(sets.first)[row]), pa.array(signed(sets.token[at])),
                     pa.array(place), pa.array(np.bincount(row, minlength=part.num_rows)[row])],
                    ["doc_id", "n", "token", "place", "weight"])

    return docs.mapInArrow(released(run), "doc_id bigint, n bigint, token bigint, place bigint, weight bigint")


def _repeated(tokens: DataFrame) -> DataFrame:
    """``token, n``: prefix tokens of two sets or more, and how often they occur. A set has a token once, and few sets are there twice."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def hashed_id(doc_id: np.ndarray) -> np.ndarray:
    return mix(doc_id.astype(np.int64).view(np.uint64))


def with_hash(ids: DataFrame) -> DataFrame:
    """Add the hash of ``doc_id`` that ``items_of`` looks up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(hashed_id(batch.column("doc_id").to_numpy())))], ["id_hash"])

    return ids.mapInArrow(run, "id_hash bigint")


def items_of(docs: DataFrame, wanted: Broadcast, width: int) -> DataFrame:
    """``doc_id, n, items``: the whole sets of the documents whose hashed id may be among the wanted ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bitmap.contains(wanted.value, hashed_id(batch.column("doc_id").to_numpy()))
            for part in slices(batch.filter(pa.array(hit)), "text"):
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(sets.first)),
                     pa.ListArray.from_arrays(pa.array(sets.first.astype(np.int32)), pa.array(signed(sets.token)))],
                    ["doc_id", "n", "items"])

    return docs.mapInArrow(released(run), "doc_id bigint, n bigint, items array<bigint>")


def _reaches(overlap: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether an overlap suffices for sets of these sizes."""
    return overlap * (100 + percent) >= (n_a + n_b) * percent


def bounded(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``most`` in place of the two profiles: no fewer than the tokens shared."""
    held = [c for c in pairs.columns if not c.startswith("profile_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = most_shared(*(batch.column(f"profile_{s}") for s in "ab"), *(batch.column(f"n_{s}").to_numpy() for s in "ab"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(most)], [*held, "most"])

    return pairs.mapInArrow(released(run), ", ".join([*(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in held), "most bigint"]))


def may_count(pairs: DataFrame, profiled: DataFrame, percent: int) -> DataFrame:
    """``a, b, n`` (the size of a) of the pairs whose profiles allow for a link, or for what their columns ``least_a, least_b, room`` ask, if they have them.

    An id with several sets may come several times.
    """
    both = pairs
    for s in "ab":
        both = both.join(profiled.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("profile").alias(f"profile_{s}")), s)
    fit = _reaches(F.col("most"), F.col("n_a"), F.col("n_b"), percent)
    if "room" in pairs.columns:
        fit |= F.col("room").isNotNull() & _reaches(F.col("most") + F.col("room"), F.col("least_a"), F.col("least_b"), percent)
    return bounded(both).where(fit).groupBy("a", "b").agg(F.max("n_a").alias("n"))


def compared(scratch: Scratch, pairs: DataFrame, profiled: DataFrame, docs: DataFrame, width: int, percent: int, label: str) -> DataFrame:
    """``a, b, n_a, n_b, overlap`` of the pairs of documents that may count, from the whole sets of just these documents.

    Pairs are dealt over parts, so that no more tokens are moved to meet others than the sets themselves have, or ``MOVED``.
    """
    pairs = scratch.stored(may_count(pairs, profiled, percent), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct())
    wanted = bitmap.gather(with_hash(ids), "id_hash")
    sets = scratch.stored(items_of(docs, docs.sparkSession.sparkContext.broadcast(wanted), width), "sets")

    def side(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("n").alias(f"n_{name}"), F.col("items").alias(f"items_{name}"))

    moved = pairs.agg(F.sum("n")).first()[0] or 0
    parts = 1 if moved <= MOVED else -(-moved // max(MOVED, sets.agg(F.sum("n")).first()[0]))
    overlap = F.size(F.array_intersect("items_a", "items_b")).cast("bigint").alias("overlap")
    found = []
    for k in range(parts):
        some = pairs.select("a", "b").where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k) if parts > 1 else pairs.select("a", "b")
        both = some.join(side("a"), "a").join(side("b"), "b")
        found.append(scratch.stored(both.select("a", "b", "n_a", "n_b", overlap), label))
        if k + 1 < parts:
            scratch.drop()
    scratch.drop(pairs, sets)
    return reduce(DataFrame.unionByName, found)


def links(scratch: Scratch, postings: DataFrame, profiled: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that give the same components as all links between the sets."""
    # Round one: every set against the leaders of its lists.
    top = F.max(F.struct("weight", (-F.col("doc_id")).alias("id"), "n", "place"))
    leaders = postings.groupBy("token").agg(top.alias("top"))
    fit = _reaches(F.least(F.col("n") - F.col("place"), F.col("top.n") - F.col("top.place")), F.col("n"), F.col("top.n"), percent)
    pairs = postings.join(leaders, "token").where(fit & (F.col("doc_id") != -F.col("top.id"))).select(
        F.col("doc_id").alias("a"), (-F.col("top.id")).alias("b")).distinct()
    first = compared(scratch, pairs, profiled, docs, width, percent, "leader-pairs")
    linked = first.where(_reaches(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent))
    label = components(linked.select("a", "b"))
    # Round two: lists that hold several components, in blocks of one leader each.
    best = linked.groupBy("a").agg(F.max(F.struct("overlap", (-F.col("b")).alias("id"))).alias("best"))
    known = postings.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").join(
        best.withColumnRenamed("a", "doc_id"), "doc_id", "left").select(
        "token", "doc_id", "n", "place", F.coalesce("component", "doc_id").alias("component"),
        F.coalesce(-F.col("best.id"), F.col("doc_id")).alias("leader"),
        F.coalesce(F.col("n") - F.col("best.overlap"), F.lit(0)).alias("beyond"))
    mixed = known.groupBy("token").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d")
    open_lists = scratch.stored(known.join(mixed.select("token"), "token", "left_semi"), "open-lists")
    blocks = open_lists.groupBy("token", "leader").agg(
        F.min("component").alias("component"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.max(F.col("n") - F.col("place")).alias("left"), F.max("beyond").alias("beyond"),
        F.max(F.col("doc_id") != F.col("leader")).alias("more"), F.count(F.lit(1)).alias("m"))
    x, y = (blocks.select("token", *[F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c != "token"]) for s in "xy")
    may = (F.col("least_x") * percent <= F.col("most_y") * 100) & (F.col("least_y") * percent <= F.col("most_x") * 100)
    may &= _reaches(F.least("left_x", "left_y"), F.col("least_x"), F.col("least_y"), percent)
    scratch.drop(postings)
    block_rows = scratch.stored(x.join(y, "token").where(
        (F.col("leader_x") < F.col("leader_y")) & (F.col("component_x") != F.col("component_y")) & may), "block-rows")
    block_pairs = block_rows.groupBy("leader_x", "leader_y").agg(
        F.min("least_x").alias("least_x"), F.min("least_y").alias("least_y"), F.max("beyond_x").alias("beyond_x"), F.max("beyond_y").alias("beyond_y"),
        F.max(F.col("more_x") | F.col("more_y")).alias("more"), F.sum(F.col("m_x") * F.col("m_y")).alias("in_lists"))
    block_pairs = scratch.stored(block_pairs.withColumnsRenamed({"leader_x": "a", "leader_y": "b"}), "block-pairs")
    # The answer of two leaders counts if it is a link, or if it leaves room for one between others of their blocks.
    room = F.when(F.col("more"), F.col("beyond_x") + F.col("beyond_y")).alias("room")
    asked = block_pairs.select("a", "b", F.col("least_x").alias("least_a"), F.col("least_y").alias("least_b"), room)
    heads = compared(scratch, asked, profiled, docs, width, percent, "block-heads")
    heads = scratch.stored(heads.join(block_pairs, ["a", "b"]), "answered-pairs")
    scratch.drop(block_pairs)
    second = heads.where(_reaches(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    # Members without anything beyond their leader were not compared either; only leaders alone are done.
    merged = components(linked.select("a", "b").unionByName(second))
    for s in "ab":
        heads = heads.join(merged.select(F.col("node").alias(s), F.col("component").alias(f"merged_{s}")), s, "left").withColumn(
            f"merged_{s}", F.coalesce(f"merged_{s}", s))
    bound = F.col("overlap") + F.col("beyond_x") + F.col("beyond_y")
    left = heads.where(_reaches(bound, F.col("least_x"), F.col("least_y"), percent) & F.col("more") & (F.col("merged_a") != F.col("merged_b"))).select(
        F.col("a").alias("leader_x"), F.col("b").alias("leader_y"), "overlap", "in_lists")
    # Blocks that meet in many lists are expanded once, by their leaders; others in the lists they meet in.
    held = open_lists.groupBy("leader", "doc_id").agg(F.min("n").alias("n"), F.min("beyond").alias("beyond"))
    sizes = held.groupBy("leader").agg(F.count(F.lit(1)).alias("m"))
    for s in "xy":
        left = left.join(sizes.withColumnsRenamed({"leader": f"leader_{s}", "m": f"m_{s}"}), f"leader_{s}")
    left = scratch.stored(left.withColumn("once", F.col("m_x") * F.col("m_y") < F.col("in_lists")), "blocks-left")
    bound = F.col("overlap") + F.col("beyond_x") + F.col("beyond_y")
    fit = ((F.col("doc_id_x") != F.col("leader_x")) | (F.col("doc_id_y") != F.col("leader_y"))) & _reaches(bound, F.col("n_x"), F.col("n_y"), percent)
    x, y = (held.withColumnsRenamed({c: f"{c}_{s}" for c in held.columns}) for s in "xy")
    whole_blocks = x.join(left.where("once").select("leader_x", "leader_y", "overlap"), "leader_x").join(y, "leader_y").where(fit)
    in_lists = block_rows.select("token", "leader_x", "leader_y").join(
        left.where("not once").select("leader_x", "leader_y", "overlap"), ["leader_x", "leader_y"])
    x, y = (open_lists.select("token", *[F.col(c).alias(f"{c}_{s}") for c in open_lists.columns if c != "token"]) for s in "xy")
    rest = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    listed = x.join(in_lists, ["token", "leader_x"]).join(y, ["token", "leader_y"]).where(fit & _reaches(rest, F.col("n_x"), F.col("n_y"), percent))
    expanded = whole_blocks.unionByName(listed, allowMissingColumns=True).select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).distinct()
    third = compared(scratch, expanded, profiled, docs, width, percent, "member-pairs")
    scratch.drop(open_lists, block_rows, left)
    third = third.where(_reaches(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    return linked.select("a", "b").unionByName(second).unionByName(third)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id`` (the smallest id reachable by links, itself included).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a set holds the different shingles
    of ``width`` words, or all words as one where there are fewer. Two documents are linked where the Jaccard
    similarity is at least ``percent`` hundredths. Texts without words, or null, have no set and no links.
    Rows of one id count as one document in the links and give a row each; so do rows without an id, which come
    after all others (null component, unless linked to others). Only ``doc_id`` and the text are read. Tokens are 64-bit hashes.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(spark)
    surveyed = scratch.stored(survey(slim, width), "shingle-survey")
    frequent = surveyed.where("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    members = surveyed.where("token is null").drop("token", "profile")
    profiled = surveyed.where("token is null and n > 0").select("doc_id", "n", "profile")
    classes = scratch.stored(members.where("n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("node")), "set-classes")
    nodes = classes.select(F.col("node").alias("doc_id"))
    standing = spark.sparkContext.broadcast(bitmap.gather(with_hash(nodes), "id_hash"))
    # The first prefixes only serve to count: what is frequent in them, too, goes to the end for the second ones, and what is in two of
    # them goes behind what is not.
    order = spark.sparkContext.broadcast(order_of(frequent))
    counted = scratch.stored(_repeated(prefix_tokens(slim, standing, order, width, percent)), "prefix-counts")
    order = spark.sparkContext.broadcast(order_of(frequent.unionByName(counted), bitmap.gather(counted, "token")))
    scratch.drop(counted)
    bits = spark.sparkContext.broadcast(bitmap.gather(_repeated(prefix_tokens(slim, standing, order, width, percent)), "token"))
    every = scratch.stored(postings_of(slim, standing, order, bits, width, percent), "postings")
    lists = every.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("token")
    postings = scratch.stored(every.join(lists, "token", "left_semi").join(nodes, "doc_id", "left_semi"), "lists")
    scratch.drop(every)
    label = components(links(scratch, postings, profiled, slim, width, percent))
    joined = members.join(classes, ["high", "low"], "left").join(label, "node", "left")
    found = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return joined.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
                         F.nullif(found, F.lit(_NO_ID)).alias("component_id"))
