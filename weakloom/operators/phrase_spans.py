"""Entities in texts: all places of the phrases of a list, the leftmost and longest first, without overlaps.

The list becomes an automaton over tokens: a tree of the phrases whose nodes also point to the longest end of their path that begins another
phrase. One walk over a text's tokens finds every phrase. A list that is small enough is sent to all tasks. A larger one is dealt into parts by
the first token of the phrases; every text then meets every part, and the finds of all parts are put together before the longest are chosen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.functions import tokens as tk
from weakloom.session import durable

#: Bytes of phrases that a task may hold as an automaton, and texts that meet one part of a larger list in one task.
LIST_BYTES, TEXTS_PER_TASK = 8 << 20, 20_000


class Automaton:
    """Finds the phrases, given as token sequences with a label, in token sequences."""

    def __init__(self, phrases: Iterable[tuple[Sequence[str], str | None]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, str | None] | None] = [None]
        for tokens, label in phrases:
            if not tokens:
                continue
            node = 0
            for token in tokens:
                if token not in self.next[node]:
                    self.next[node][token] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                node = self.next[node][token]
            held = self.ends[node]
            if held is None or held[1] is None or (label is not None and label < held[1]):
                self.ends[node] = (len(tokens), label)
        # Breadth first: the longest end of a path that is a path itself, and the nearest such end that is a whole phrase.
        self.back, self.shorter = [0] * len(self.next), [0] * len(self.next)
        queue = list(self.next[0].values())
        for node in queue:
            for token, child in self.next[node].items():
                queue.append(child)
                at = self.back[node]
                while at and token not in self.next[at]:
                    at = self.back[at]
                back = self.next[at].get(token, 0)
                self.back[child] = back
                self.shorter[child] = back if self.ends[back] else self.shorter[back]

    def longest(self, tokens: Sequence[str]) -> dict[int, tuple[int, str | None]]:
        """For each place where a phrase begins, the length and label of the longest."""
        best: dict[int, tuple[int, str | None]] = {}
        node, steps, back, ends, shorter = 0, self.next, self.back, self.ends, self.shorter
        for i, token in enumerate(tokens):
            while node and token not in steps[node]:
                node = back[node]
            node = steps[node].get(token, 0)
            found = node if ends[node] else shorter[node]
            while found:
                size, label = ends[found]
                begin = i - size + 1
                if begin not in best or best[begin][0] < size:
                    best[begin] = (size, label)
                found = shorter[found]
        return best


def without_overlaps(found: Iterable[tuple[int, int, str | None]]) -> list[tuple[int, int, str | None]]:
    """From ``(begin, size, label)`` the leftmost, the longest of those, then the next that begins behind it, and so on."""
    out, free = [], 0
    for begin, size, label in sorted(found, key=lambda x: (x[0], -x[1])):
        if begin >= free:
            out.append((begin, size, label))
            free = begin + size
    return out


_FOUND = "row bigint, key {kind}, begin int, size int, phrase string, label string"


class Runs:
    """Where a phrase may stand: runs of tokens whose neighbours also stand side by side in a phrase, and single tokens that are phrases."""

    def __init__(self, phrases: Sequence[Sequence[str]]) -> None:
        self.words = pa.array(sorted({t for tokens in phrases for t in tokens}), pa.string())
        number = {t: i for i, t in enumerate(self.words.to_pylist())}
        self.single = np.zeros(len(number) + 1, bool)
        self.single[[number[tokens[0]] for tokens in phrases if len(tokens) == 1]] = True
        self.pairs = np.array(sorted({number[a] * len(number) + number[b] for tokens in phrases for a, b in zip(tokens, tokens[1:])}), np.int64)

    def of(self, lists: pa.ListArray) -> Iterator[tuple[int, int, list[str]]]:
        """``(text, place in it, tokens)``."""
        words, lengths = lists.flatten().cast(pa.string()), lists.value_lengths().to_numpy()
        if not len(words) or not len(self.words):
            return
        known = pc.fill_null(pc.index_in(words, self.words), -1).to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(lengths)), lengths)
        begins = np.concatenate([[0], np.cumsum(lengths)])
        # Whether a token goes on with the one before it.
        goes_on = np.zeros(len(known) + 1, bool)
        at = np.flatnonzero((known[1:] >= 0) & (known[:-1] >= 0) & (text[1:] == text[:-1])) + 1
        if len(self.pairs):
            pair = known[at - 1] * len(self.words) + known[at]
            goes_on[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        first = np.flatnonzero(~goes_on[:-1] & (goes_on[1:] | self.single[known]))
        breaks = np.flatnonzero(~goes_on[1:]) + 1
        for begin, end in zip(first.tolist(), breaks[np.searchsorted(breaks, first, side="right")].tolist()):
            yield int(text[begin]), begin - int(begins[text[begin]]), words.slice(begin, end - begin).to_pylist()


def _batch(texts: pa.Table | pa.RecordBatch, automaton: Automaton, runs: Runs, choose: bool) -> pa.RecordBatch:
    place, begins, sizes, phrases, labels = [], [], [], [], []
    words = texts.column("words")
    for i, offset, tokens in runs.of(words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words):
        found = [(begin, size, label) for begin, (size, label) in automaton.longest(tokens).items()]
        # No phrase goes beyond its run.
        for begin, size, label in without_overlaps(found) if choose else found:
            place.append(i)
            begins.append(offset + begin)
            sizes.append(size)
            phrases.append(" ".join(tokens[begin:begin + size]))
            labels.append(label)
    take = pa.array(place, pa.int64())
    keys, rows = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (texts.column("key"), texts.column("row")))
    return pa.record_batch([rows.take(take), keys.take(take), pa.array(begins, pa.int32()), pa.array(sizes, pa.int32()),
                            pa.array(phrases, pa.string()), pa.array(labels, pa.string())],
                           ["row", "key", "begin", "size", "phrase", "label"])


def _sent(texts: DataFrame, phrases: DataFrame, kind: str) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast([(r.tokens, r.label) for r in phrases.collect()])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, runs = Automaton(held.value), Runs([tokens for tokens, _ in held.value])
        for batch in batches:
            yield _batch(batch, automaton, runs, True)

    return texts.mapInArrow(find, _FOUND.format(kind=kind))


def _dealt(texts: DataFrame, phrases: DataFrame, kind: str, parts: int, per_task: int) -> DataFrame:
    texts = durable(texts)
    tasks = max(1, -(-texts.count() // per_task))
    by_first = F.pmod(F.xxhash64(F.get("tokens", F.lit(0))), F.lit(parts)).cast("int").alias("part")
    lists = phrases.select(by_first, "tokens", "label", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    asked = texts.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("t_part"),
                         F.pmod(F.xxhash64("row"), F.lit(tasks)).cast("int").alias("t_task"), "row", "key", "words")

    def find(own: pa.Table, words: pa.Table) -> pa.Table:
        tokens = own["tokens"].to_pylist()
        return pa.Table.from_batches([_batch(words, Automaton(zip(tokens, own["label"].to_pylist())), Runs(tokens), False)])

    found = lists.groupBy("part", "task").cogroup(asked.groupBy("t_part", "t_task")).applyInArrow(find, _FOUND.format(kind=kind))
    # What is found in one text is no more than its tokens.
    gathered = found.groupBy("row").agg(F.first("key").alias("key"), F.collect_list(F.struct("begin", "size", "phrase", "label")).alias("found"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, spans = [], []
            for i, found in enumerate(batch.column("found").to_pylist()):
                own = without_overlaps((x["begin"], x["size"], (x["phrase"], x["label"])) for x in found)
                place += [i] * len(own)
                spans += own
            take = pa.array(place, pa.int64())
            yield pa.record_batch([batch.column("row").take(take), batch.column("key").take(take), pa.array([x[0] for x in spans], pa.int32()),
                                   pa.array([x[1] for x in spans], pa.int32()), pa.array([x[2][0] for x in spans], pa.string()),
                                   pa.array([x[2][1] for x in spans], pa.string())], ["row", "key", "begin", "size", "phrase", "label"])

    return gathered.mapInArrow(choose, _FOUND.format(kind=kind))


def find_phrases(df: DataFrame, key: str, text: str, phrases: DataFrame, list_bytes: int = LIST_BYTES,
                 per_task: int = TEXTS_PER_TASK) -> DataFrame:
    """``(key, begin, size, phrase, label)``: the places of the phrases in each text, counted in tokens.

    ``phrases (phrase, label)``: a phrase is taken as its tokens, so case and punctuation do not matter; of several labels the first in
    order counts, and a phrase without tokens is never found. Each row of ``df`` is a text of its own, repeated ones included; a null text
    has no phrases.
    """
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), tk.tokens(F.col(text)).alias("words"))
    listed = phrases.select(tk.tokens(F.col("phrase")).alias("tokens"), "label").where(F.size("tokens") > 0)
    listed = durable(listed.groupBy("tokens").agg(F.min("label").alias("label")))
    length = F.octet_length(F.array_join("tokens", " ")) + F.coalesce(F.octet_length("label"), F.lit(0))
    parts = -(-(listed.agg(F.sum(length).alias("bytes")).first().bytes or 0) // list_bytes)
    found = _sent(texts, listed, kind) if parts <= 1 else _dealt(texts, listed, kind, int(parts), per_task)
    return found.select(F.col("key").alias(key), "begin", "size", "phrase", "label")


def windows_of(df: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    """``(phrase)``: all distinct runs of so many tokens in the texts."""
    words = df.select(tk.tokens(F.col(text)).alias("w"))

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return F.when(F.size("w") >= n, found).otherwise(F.array().cast("array<string>"))

    return words.select(F.explode(F.concat(*[runs(n) for n in sizes])).alias("phrase")).distinct()
