"""Fixed-length token features per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weakloom.functions import tokens as tk
from weakloom.functions import vectors
from weakloom.functions.text import first_words
from weakloom.operators.skew import salted_join

#: Bytes of a vector table that every task may hold, and of features made at once.
TABLE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20


def truncated_tokens(text: Column, max_len: int = vectors.MAX_TOKENS) -> Column:
    """Tokens of the first ``max_len`` words, at most ``max_len`` of them."""
    return F.slice(tk.tokens(first_words(text, max_len)), 1, max_len)


def encode_by_lookup(df: DataFrame, key: str, text: str, table: DataFrame, width: int,
                     max_len: int = vectors.MAX_TOKENS) -> DataFrame:
    """``(key, features)``: a vector per token from ``table (token, vector)``, zero rows at the end.

    Unknown tokens get a zero row; each token stands in the table once. A table of at most ``TABLE_BYTES`` is sent to the tasks and
    looked up in batches, so nothing is shuffled; otherwise tokens meet it through a salted join, so a token that makes up much of the
    text is spread over tasks.
    """
    side = table.select("token", F.col("vector").cast("array<float>").alias("vector"))
    tokenised = df.select(key, truncated_tokens(F.coalesce(F.col(text), F.lit("")), max_len).alias("_tokens"))
    bytes_ = side.agg(F.sum(F.octet_length("token") + F.lit(4 * width)).alias("bytes")).first().bytes or 0
    if bytes_ <= TABLE_BYTES:
        return _looked_up(tokenised, side, key, width, max_len)
    placed = tokenised.select(key, F.posexplode_outer("_tokens").alias("at", "token"))
    found = salted_join(placed, side, "token", [key, "at"], "left")
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    filled = found.select(key, "at", F.coalesce("vector", zero).alias("vector"))
    # At most ``max_len`` vectors per key.
    rows = filled.groupBy(key).agg(F.array_sort(F.collect_list(
        F.when(F.col("at").isNotNull(), F.struct("at", "vector")))).alias("_rows"))
    return rows.select(key, vectors.pad_rows(F.transform("_rows", lambda x: x["vector"]), max_len, width).alias("features"))


def _looked_up(tokenised: DataFrame, side: DataFrame, key: str, width: int, max_len: int) -> DataFrame:
    """Features of ``(key, _tokens)`` from a table that was checked to be small."""
    held = side.toArrow()
    names = {token: i for i, token in enumerate(held["token"].to_pylist())}
    matrix = np.zeros((len(names) + 1, width), np.float32)  # the last row stands for unknown tokens and for padding
    if names:
        matrix[:-1] = np.array(held["vector"].to_pylist(), np.float32)
    sent = tokenised.sparkSession.sparkContext.broadcast((names, matrix))
    step = max(1, BATCH_BYTES // (4 * width * max_len))
    schema = T.StructType([tokenised.schema[key], T.StructField("features", T.ArrayType(T.ArrayType(T.FloatType())))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                at = np.full((part.num_rows, max_len), len(known), np.int32)
                for i, tokens in enumerate(part.column(1).to_pylist()):
                    at[i, :len(tokens)] = [known.get(t, len(known)) for t in tokens]
                flat = pa.array(rows[at].ravel())
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), flat)
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, max_len), pa.int32()), inner)
                yield pa.record_batch([part.column(0), outer], [key, "features"])

    return tokenised.mapInArrow(look_up, schema)


def encode_by_model(df: DataFrame, key: str, text: str, encoder: Callable[[list[str]], list],
                    width: int = vectors.WIDTH, max_len: int = vectors.MAX_TOKENS) -> DataFrame:
    """``(key, features)`` from a user-supplied encoder, in Arrow batches.

    ``encoder`` maps a list of texts to one ``tokens x width`` matrix each. Texts are cut to
    ``max_len`` words before it and matrices to ``max_len`` rows after it.
    """
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type),
                           T.StructField("features", T.ArrayType(T.ArrayType(T.FloatType())))])

    def encode(batches):
        for batch in batches:
            matrices = encoder(list(batch["_text"]))
            yield pd.DataFrame({key: batch[key], "features": [[list(map(float, r)) for r in m[:max_len]] for m in matrices]})

    cut = df.select(key, first_words(F.coalesce(text, F.lit("")), max_len).alias("_text"))
    return cut.mapInPandas(encode, schema).select(key, vectors.pad_rows(F.col("features"), max_len, width).alias("features"))


def stacked(features: DataFrame, key: str) -> DataFrame:
    """All feature records as one table in key order."""
    return features.orderBy(key)
