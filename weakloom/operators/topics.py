"""Topics of documents: term shares per topic that explain the counts best, fitted by rounds of expectation and maximisation.

Documents are turned into sparse counts once and written. A round reads them; each document finds its own mixture of topics from the shares
alone, starting evenly, so nothing per document is kept between rounds. What a round sums up is the topic-term table, whose size is the number
of topics times the number of terms, both parameters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weakloom.functions import tokens as tk
from weakloom.session import durable

#: Terms of the vocabulary, steps in which a document finds its mixture, and what is added to each count of the table.
TERMS, STEPS, SMOOTHING = 20_000, 10, 0.01
#: Numbers (counts times topics) worked on at once.
NUMBERS_AT_ONCE = 1 << 21


def _start_values(terms: Sequence[str], n_topics: int, spark: SparkSession) -> np.ndarray:
    """Shares to start from, one row per term: 1 to 2 by a digest of term and topic, so they are the same wherever they are made."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, term string")
    digits = [start_weight(F.col("term"), k).alias(f"w{k}") for k in range(n_topics)]
    table = rows.orderBy("i").select(*digits).toArrow()
    values = np.array([c.to_pylist() for c in table.columns], float).T if len(table) else np.zeros((0, n_topics))
    return values / values.sum(axis=0) if len(values) else values


def start_weight(term: Column, topic: int) -> Column:
    """A number from 1 to 2 that depends on the term and the topic only."""
    return F.lit(1.0) + F.conv(F.substring(F.md5(F.concat(term, F.lit(f" {topic}"))), 1, 4), 16, 10).cast("double") / 65536


def vocabulary(df: DataFrame, text: str, size: int = TERMS, least: int = 2) -> list[str]:
    """The ``size`` terms in most documents, at least ``least`` of them; equal ones in order of the term."""
    counts = df.select(F.explode(F.array_distinct(tk.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return [r.term for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(size).collect()]


@dataclass(frozen=True)
class Topics:
    """The vocabulary, and for each of its terms the share it has of every topic."""

    terms: tuple
    shares: np.ndarray
    steps: int = STEPS

    @property
    def n_topics(self) -> int:
        return self.shares.shape[1]

    def table(self, spark: SparkSession) -> DataFrame:
        """``(topic, term, share)``."""
        rows = [(k, t, float(self.shares[i, k])) for i, t in enumerate(self.terms) for k in range(self.n_topics)]
        return spark.createDataFrame(rows, "topic int, term string, share double")


def counted(df: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """``(key, terms, counts)``: places in the vocabulary and counts per row, written once. A row without known terms has empty arrays."""
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(list(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(sent.value, pa.string())
        for batch in batches:
            words = batch.column(1)
            row = np.repeat(np.arange(len(words), dtype=np.int64), words.value_lengths().to_numpy())
            place = pc.fill_null(pc.index_in(words.flatten().cast(pa.string()), listed), -1).to_numpy()
            both, n = np.unique(row[place >= 0] * max(1, len(listed)) + place[place >= 0], return_counts=True)
            row, place = np.divmod(both, max(1, len(listed)))
            upto = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(upto, pa.array(place.astype(np.int32))),
                                   pa.ListArray.from_arrays(upto, pa.array(n.astype(np.int32)))], ["key", "terms", "counts"])

    slim = df.select(F.col(key).alias("key"), tk.tokens(F.col(text)).alias("words"))
    return durable(slim.mapInArrow(count, f"key {kind}, terms array<int>, counts array<int>"))


def _blocks(batch: pa.RecordBatch, n_topics: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, end, row of each entry, terms, counts)`` of runs of rows with a bounded number of entries."""
    lengths = batch.column("terms").value_lengths().to_numpy()
    upto = np.concatenate([[0], np.cumsum(lengths)])
    terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
    at, most = 0, max(1, NUMBERS_AT_ONCE // n_topics)
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, side="right")) - 1)
        row = np.repeat(np.arange(end - at), lengths[at:end])
        yield at, end, row, terms[upto[at]:upto[end]], counts[upto[at]:upto[end]]
        at = end


def _mixtures(n: int, row: np.ndarray, counts: np.ndarray, own: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """``(mixture of each row, its product with the shares of each entry)``; ``own`` are the shares of the entries' terms."""
    k = own.shape[1]
    mix = np.full((n, k), 1.0 / k)
    total = np.maximum(np.bincount(row, counts, n), 1e-300)
    for _ in range(steps):
        both = mix[row] * own
        both *= (counts / both.sum(axis=1))[:, None]
        new = np.stack([np.bincount(row, both[:, j], n) for j in range(k)], axis=1) if len(row) else mix
        mix = np.where((np.bincount(row, minlength=n) > 0)[:, None], new / total[:, None], mix)
    return mix, mix[row] * own


def term_sums(counts: DataFrame, model: Topics) -> tuple[np.ndarray, float]:
    """The expected count of each term in each topic, and the log-likelihood of all counts. One table reaches the driver."""
    size, k = model.shares.shape
    shares, steps = model.shares, model.steps
    sent = counts.sparkSession.sparkContext.broadcast(shares)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs = np.zeros((size + 1, k)), 0.0
        for batch in batches:
            for at, end, row, terms, n in _blocks(batch, k):
                _, both = _mixtures(end - at, row, n, sent.value[terms], steps)
                seen = both.sum(axis=1)
                logs += float((n * np.log(seen)).sum())
                both *= (n / seen)[:, None]
                for j in range(k):
                    table[:size, j] += np.bincount(terms, both[:, j], size)
        table[size, 0] = logs
        used = np.flatnonzero(table.any(axis=1))
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(list(table[used]), pa.list_(pa.float64()))], ["term", "sums"])

    parts = counts.select("terms", "counts").mapInArrow(add_up, "term int, sums array<double>")
    summed = parts.groupBy("term").agg(*[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(k)])
    out = np.zeros((size + 1, k))
    for r in summed.collect():
        out[r.term] = r[1:]
    return out[:size], float(out[size, 0])


def next_topics(model: Topics, sums: np.ndarray, smoothing: float = SMOOTHING) -> Topics:
    raised = sums + smoothing
    return Topics(model.terms, raised / raised.sum(axis=0), model.steps)


def start_topics(spark: SparkSession, terms: Sequence[str], n_topics: int, steps: int = STEPS) -> Topics:
    return Topics(tuple(terms), _start_values(terms, n_topics, spark), steps)


def fit_topics(df: DataFrame, key: str, text: str, n_topics: int, rounds: int = 20, terms: int = TERMS, least: int = 2, steps: int = STEPS,
               smoothing: float = SMOOTHING) -> tuple[Topics, DataFrame, list[float]]:
    """``(topics, counts, log-likelihood before each round)``.

    Only the table of topics goes from round to round, as plain numbers, so a lost executor costs a part of one round. An empty table gives a
    model without terms.
    """
    words = vocabulary(df, text, terms, least)
    counts = counted(df, key, text, words)
    model, likelihoods = start_topics(df.sparkSession, words, n_topics, steps), []
    for _ in range(rounds if words else 0):
        sums, likelihood = term_sums(counts, model)
        likelihoods.append(likelihood)
        model = next_topics(model, sums, smoothing)
    return model, counts, likelihoods


def mixtures(counts: DataFrame, model: Topics) -> DataFrame:
    """``(key, mixture)``: the share of each topic in each row; even where a row has no known term."""
    kind = counts.schema["key"].dataType.simpleString()
    k, steps = model.n_topics, model.steps
    sent = counts.sparkSession.sparkContext.broadcast(model.shares)

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, row, terms, n in _blocks(batch, k):
                found, _ = _mixtures(end - at, row, n, sent.value[terms], steps)
                yield pa.record_batch([batch.column("key").slice(at, end - at), pa.array(list(found), pa.list_(pa.float64()))], ["key", "mixture"])

    return counts.mapInArrow(mix, f"key {kind}, mixture array<double>")


def leading_terms(model: Topics, n: int = 10) -> list[list[str]]:
    """The ``n`` terms with the largest share of each topic."""
    return [[model.terms[i] for i in np.lexsort((np.arange(len(model.terms)), -model.shares[:, k]))[:n]] for k in range(model.n_topics)]
