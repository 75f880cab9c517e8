"""Joins whose left side may be dominated by one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, on: str, spread_by: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Equi-join with every key of ``left`` dealt out over ``salts`` tasks.

    ``right`` is repeated ``salts`` times, so it should be the much smaller side.
    ``spread_by`` are columns of ``left`` that differ between rows of one key.
    """
    copies = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")
