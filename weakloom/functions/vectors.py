"""Array arithmetic for embeddings and fixed-length feature matrices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of one feature record.
MAX_TOKENS = 50
WIDTH = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null where one side has length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def pad_rows(rows: Column, length: int = MAX_TOKENS, width: int = WIDTH) -> Column:
    """Append zero rows up to ``length`` rows."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return F.concat(rows, F.array_repeat(zero, F.greatest(F.lit(length) - F.size(rows), F.lit(0))))


def to_rows(flat: Column, length: int = MAX_TOKENS, width: int = WIDTH) -> Column:
    """Cut a flat vector into ``length`` rows of ``width`` values."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                       lambda i: F.slice(flat, i * width + 1, width))


def mean_row(rows: Column, width: int) -> Column:
    """The mean of the rows of a matrix."""
    total = F.aggregate(rows, F.array_repeat(F.lit(0.0), width), lambda s, row: F.zip_with(s, row, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: (x / F.greatest(F.size(rows), F.lit(1))).cast("float"))
