"""Computing a derived column once per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fenced(df: DataFrame, kept: Sequence[str], computed: Mapping[str, Column]) -> DataFrame:
    """``kept`` columns plus the ``computed`` ones, each evaluated once per row.

    A filter over a derived column is pushed below the projection by copying the column's
    definition into it. Over a chain of projections the copies multiply. Filters stay above a
    generator, so the columns pass through one that yields exactly one row. Filters over
    ``kept`` columns still reach the scan. The work itself stays in a projection, where it is
    compiled; the generator only passes finished values on.
    """
    done = df.select(*kept, *[c.alias(n) for n, c in computed.items()])
    return done.select(*kept, F.inline(F.array(F.struct(*computed))))
