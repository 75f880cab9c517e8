"""Ordered scans that stay parallel inside one huge group.

A window over ``partitionBy(doc)`` puts a whole document into one task. Here the integer
order key cuts each group into chunks of bounded length: windows run per chunk, and only one
summary row per chunk goes through a window over the group. Chunk borders depend on the key
alone, so a recomputed task sees the same chunks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.session import durable

CHUNK = 4096


def _chunk_of(order: str, chunk: int) -> Column:
    return F.expr(f"`{order}` div {int(chunk)}")


def with_chunks(df: DataFrame, order: str, chunk: int = CHUNK) -> DataFrame:
    """Add the ``_chunk`` column the scans below work on.

    Several scans over the same frame share it and thereby one shuffle.
    """
    return df.withColumn("_chunk", _chunk_of(order, chunk))


def previous_value(df: DataFrame, group: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Add the value of the row before, null for the first row of a group.

    ``(group, order)`` must be unique.
    """
    keys = [*group, "_chunk"]
    last = df.groupBy(*keys).agg(F.max_by(value, order).alias("_last"))
    carried = last.select(*keys, F.lag("_last").over(W.partitionBy(*group).orderBy("_chunk")).alias("_carried"))
    inside = df.withColumn("_inside", F.lag(F.struct(value)).over(W.partitionBy(*keys).orderBy(order)))
    return inside.join(carried, keys).select(
        *df.columns, F.when(F.col("_inside").isNotNull(), F.col(f"_inside.{value}"))
        .otherwise(F.col("_carried")).alias(out))


def running_totals(df: DataFrame, group: Sequence[str], order: str, sums: Mapping[str, str],
                   totals: Mapping[str, str] | None = None) -> DataFrame:
    """Add, for each ``sums[column] = name``, the sum over all earlier rows of the group.

    ``totals[column] = name`` adds the sum over the whole group.
    """
    totals = totals or {}
    keys = [*group, "_chunk"]
    columns = list(dict.fromkeys([*sums, *totals]))
    per_chunk = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    earlier_chunks = W.partitionBy(*group).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    offsets = per_chunk.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier_chunks), F.lit(0)).alias(f"_off_{c}") for c in sums],
        *[F.sum(f"_sum_{c}").over(whole).alias(n) for c, n in totals.items()])
    earlier = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    inside = df.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_in_{c}") for c in sums])
    return inside.join(offsets, keys).select(
        *df.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(n) for c, n in sums.items()],
        *totals.values())


def row_keys(df: DataFrame, order: str, out: str, major: Sequence[str] = ()) -> DataFrame:
    """``(major…, order, out)``: the 0-based position of each key in the order ``(major…, order)``.

    The keys are cut into ranges of about equal size, whatever their values, and written to the shared folder. Rows are numbered
    inside a range; the ranges before it count one row each in the one small sum over all ranges.
    """
    by = [*major, order]
    ranged = df.select(*by).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = durable(ranged.withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = ranged.withColumn("_in", F.row_number().over(W.partitionBy("_range").orderBy(*by)))
    return inside.join(F.broadcast(offsets), "_range").select(*by, (F.col("_in") - 1 + F.col("_offset")).alias(out))


def row_numbers(df: DataFrame, order: str, out: str, major: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position of each row in the order ``(major…, order)``.

    The two together must be unique and not null.
    """
    keys = row_keys(df, order, out, major)
    if set(df.columns) == {*major, order}:
        return keys.select(*df.columns, out)
    return df.join(keys, [*major, order]).select(*df.columns, out)
