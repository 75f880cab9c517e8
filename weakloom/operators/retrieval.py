"""Similarity retrieval, manual labels and table assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.functions import vectors
from weakloom.functions.fence import fenced
from weakloom.operators import scan
from weakloom.operators.labeling import LETTERS, NEUTRAL

# Fixed value: default similarity threshold.
THRESHOLD = 0.40


def score(df: DataFrame, vector: str, query: Column, out: str = "results") -> DataFrame:
    """Add the cosine similarity to one query vector.

    ``query`` is a literal array or a scalar subquery, so nothing is joined.
    """
    kept = df.columns
    return fenced(df.select(*kept, query.alias("_query")), kept,
                  {out: vectors.cosine(F.col(vector), F.col("_query"))})


def above(df: DataFrame, threshold: float = THRESHOLD, below: float | None = None, results: str = "results") -> DataFrame:
    """Rows scored at least ``threshold`` and, if given, less than ``below``."""
    kept = df.where(F.col(results) >= threshold)
    return kept if below is None else kept.where(F.col(results) < below)


def ranked(df: DataFrame, name: str, results: str = "results", tie: str | None = None) -> DataFrame:
    """Global order: name ascending, score descending. The range sort also splits a hot name."""
    order = [F.asc(name), F.desc(results)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order)


def best_per_name(df: DataFrame, name: str, k: int, results: str = "results", tie: str | None = None) -> DataFrame:
    """The ``k`` best rows per name with their rank.

    Spark limits each group before the shuffle, so a hot name sends ``k`` rows per task.
    """
    order = [F.desc(results)] + ([F.asc(tie)] if tie else [])
    return df.withColumn("rank", F.row_number().over(W.partitionBy(name).orderBy(*order))).where(F.col("rank") <= k)


def attach_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Left join of manual labels; ``labels`` holds at most one row per key."""
    return df.join(labels, key, "left")


def default_class(column: Column, default: int = NEUTRAL) -> Column:
    return F.coalesce(column, F.lit(default))


def class_of_letter(letter: Column) -> Column:
    """Letter code to class number, null for other letters."""
    return _choose(letter, LETTERS)


def letter_of_class(number: Column) -> Column:
    return _choose(number, {v: k for k, v in LETTERS.items()})


def _choose(column: Column, table: Mapping) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def correct_labels(df: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where ``corrections (key, column)`` has a row for the key."""
    new = corrections.select(key, F.col(column).alias("_new"))
    return df.join(new, key, "left").select(*[
        F.coalesce("_new", column).alias(column) if c == column else F.col(c) for c in df.columns])


def tag_countries(df: DataFrame, column: str, names: Mapping[str, str], unknown: str = "unknown") -> DataFrame:
    """Replace ``column`` by ``country``: its name, or the value itself if it has none; no row is lost."""
    country = F.coalesce(_choose(F.col(column), names), F.col(column), F.lit(unknown))
    return df.withColumn("country", country).drop(column)


def union_countries(tables: Mapping[str, DataFrame], key: str = "id", rest: DataFrame | None = None) -> DataFrame:
    """UNION ALL of per-country tables with the country as a constant column, and of ``rest``, which has one.

    Rows are identified by ``(country, key)``; nothing is re-numbered or overwritten.
    """
    tagged = [df.withColumn("country", F.lit(name)) for name, df in tables.items()] + ([] if rest is None else [rest])
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str,
                    position: str = "position") -> DataFrame:
    """Pair the n-th row of one table with the n-th row of the other, in key order.

    The longer table is cut to the length of the shorter one.
    """
    a = scan.row_numbers(left, left_order, position)
    b = scan.row_numbers(right, right_order, position)
    return a.join(b, position)


def keys_at(df: DataFrame, order: str, first: int, last: int | None = None, major: Sequence[str] = (),
            position: str = "position") -> DataFrame:
    """``(major…, order, position)`` at the 0-based positions ``first`` … ``last`` of the order; reads only these columns."""
    return scan.row_keys(df, order, position, major).where(F.col(position).between(first, first if last is None else last))


def rows_at(df: DataFrame, order: str, first: int, last: int | None = None, major: Sequence[str] = (),
            position: str = "position") -> DataFrame:
    """Rows at the 0-based positions ``first`` … ``last`` of the order."""
    # As many keys as rows asked for; the table itself is not moved.
    keys = keys_at(df, order, first, last, major, position)
    return df.join(F.broadcast(keys), [*major, order]).select(*df.columns, position)


def shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order).limit(n)
