"""A vector per text: the mean of its tokens' vectors, frequent tokens weighing less, without the direction all texts share.

The shared direction is the first principal one of the table of means (not centred). It is found by multiplying a vector with all rows again and
again; a round sums one vector over all tasks, so nothing but that vector leaves them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.functions import tokens as tk
from weakloom.operators.skew import salted_join
from weakloom.session import durable

#: A token that makes up this share of all tokens weighs half of a very rare one.
HALF = 1e-3
#: Rounds at most, and the change of the direction at which they end.
ROUNDS, STILL = 50, 1e-10
#: Bytes of a vector table that every task may hold.
TABLE_BYTES = 64 << 20


def token_weights(df: DataFrame, text: str, half: float = HALF) -> DataFrame:
    """``(token, share, weight)`` of all tokens of the texts: ``half / (half + share)``."""
    counts = df.select(F.explode(tk.tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    share = F.col("n") / total
    return counts.select("token", share.alias("share"), (F.lit(half) / (F.lit(half) + share)).alias("weight"))


def _sums_by_lookup(rows: DataFrame, table: DataFrame, width: int) -> DataFrame:
    held = table.toArrow()
    names = {t: i for i, t in enumerate(held["token"].to_pylist())}
    matrix = np.zeros((len(names), width))
    if names:
        matrix[:] = np.array(held["vector"].to_pylist())
    sent = rows.sparkSession.sparkContext.broadcast((names, matrix))
    kind = rows.schema["key"].dataType.simpleString()

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vectors = sent.value
        for batch in batches:
            out = np.zeros((batch.num_rows, width))
            for i, words in enumerate(batch.column("words")):
                own = [known[t] for t in words.as_py() if t in known]
                if own:
                    out[i] = vectors[own].mean(axis=0)
            yield pa.record_batch([batch.column("key"), pa.array(list(out), pa.list_(pa.float64()))], ["key", "vector"])

    return rows.select("key", "words").mapInArrow(mean, f"key {kind}, vector array<double>")


def _sums_by_join(rows: DataFrame, table: DataFrame, width: int) -> DataFrame:
    placed = rows.select("row", F.posexplode("words").alias("at", "token"))
    found = salted_join(placed, table, "token", ["row", "at"]).select("row", F.posexplode("vector").alias("i", "x"))
    cells = found.groupBy("row", "i").agg(F.avg("x").alias("x"))
    means = cells.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("cells"))
    zero = F.array_repeat(F.lit(0.0), width)
    return rows.select("row", "key").join(means.select("row", F.transform("cells", lambda c: c["x"]).alias("vector")), "row", "left").select(
        "key", F.coalesce("vector", zero).alias("vector"))


def weighted_means(df: DataFrame, key: str, text: str, vectors: DataFrame, width: int, half: float = HALF,
                   table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``(key, vector)``: per row the mean of the weighted vectors of its tokens that have one; zeros if none has.

    ``vectors (token, vector)`` holds each token once. A table of at most ``table_bytes`` is sent to the tasks; a larger one meets
    the tokens in a salted join. Each row is a text of its own.
    """
    weights = token_weights(df, text, half)
    table = durable(weights.join(vectors.select("token", "vector"), "token").select(
        "token", F.expr("transform(vector, x -> cast(x AS double) * weight)").alias("vector")))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), tk.tokens(F.col(text)).alias("words"))
    held = table.agg(F.sum(F.octet_length("token") + F.lit(8 * width)).alias("bytes")).first().bytes or 0
    return _sums_by_lookup(rows, table, width) if held <= table_bytes else _sums_by_join(durable(rows), table, width)


class Direction(NamedTuple):
    vector: np.ndarray
    rounds: int


def _times(means: DataFrame, direction: np.ndarray) -> np.ndarray:
    """The sum over all rows of the row times its product with the direction."""
    width = len(direction)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                x = pc.list_flatten(batch.column(0)).to_numpy().reshape(-1, width)
                total += x.T @ (x @ direction)
        yield pa.record_batch([pa.array(np.arange(width), pa.int32()), pa.array(total)], ["i", "x"])

    parts = means.select("vector").mapInArrow(multiply, "i int, x double").groupBy("i").agg(F.sum("x").alias("x"))
    out = np.zeros(width)
    for r in parts.collect():
        out[r.i] = r.x
    return out


def shared_direction(means: DataFrame, width: int, rounds: int = ROUNDS, still: float = STILL) -> Direction:
    """The unit vector most of ``means (key, vector)`` point along, with its largest entry positive; zeros if all rows are zero.

    ``means`` should be a written table, since every round reads it.
    """
    now = np.ones(width) / np.sqrt(width)
    for done in range(1, rounds + 1):
        new = _times(means, now)
        length = np.linalg.norm(new)
        if length == 0:
            return Direction(np.zeros(width), done)
        new /= length
        moved = np.abs(new - now).max()
        now = new
        if moved < still:
            break
    return Direction(now * np.sign(now[np.abs(now).argmax()]), done)


def without_direction(means: DataFrame, direction: np.ndarray) -> DataFrame:
    """``(key, vector)`` without the part along the direction; one projection."""
    d = F.array(*[F.lit(float(x)) for x in direction])
    along = means.select("key", "vector", F.aggregate(F.zip_with("vector", d, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("_along"))
    return along.select("key", F.zip_with("vector", d, lambda x, y: x - y * F.col("_along")).alias("vector"))


def sentence_vectors(df: DataFrame, key: str, text: str, vectors: DataFrame, width: int, half: float = HALF,
                     rounds: int = ROUNDS) -> DataFrame:
    """``(key, vector)`` of every row: its weighted mean without the shared direction."""
    means = durable(weighted_means(df, key, text, vectors, width, half))
    return without_direction(means, shared_direction(means, width, rounds).vector)
