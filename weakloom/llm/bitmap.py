"""A bit set of fixed size over 64-bit hashes, gathered from a DataFrame and sent to tasks.

It only saves work: a hash in the set always passes, others pass by chance. Its largest size does not
depend on the data. Over very many hashes it fills up, and then every row takes the longer way.
Over few hashes it is smaller, as every executor keeps a copy on its disk.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits in the set at most, as a power of two: 2**27 bits are 16 MB.
BITS = 27
#: Bits for each hash in a smaller set, as a power of two: one in 128 others passes by chance.
SPARE = 7


def gather(hashes: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The set of all values of a BIGINT column, in ``2**bits`` bits or fewer. At most ``2**(bits - 6)`` rows reach the driver."""
    place = F.shiftrightunsigned(column, 64 - bits)
    words = (hashes.select(place.alias("place"))
             .groupBy(F.shiftright("place", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS INT))")).alias("bits")))
    table = words.toArrow()
    word, held = table["word"].to_numpy(), table["bits"].to_numpy().view(np.uint64)
    # A set of few hashes has fewer bits: the place of a hash is given by its first bits, so neighbours fall together.
    fewer = max(12, int(np.bitwise_count(held).sum()).bit_length() + SPARE)
    if fewer >= bits:
        out = np.zeros(1 << (bits - 6), np.uint64)
        out[word] = held
        return out
    row, bit = np.nonzero(np.unpackbits(held.view(np.uint8), bitorder="little").reshape(-1, 64))
    place = (word[row].astype(np.int64) * 64 + bit) >> (bits - fewer)
    out = np.zeros(1 << (fewer - 6), np.uint64)
    np.bitwise_or.at(out, place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    return out


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set."""
    bits = int(len(words) * 64).bit_length() - 1
    place = hashes >> np.uint64(64 - bits)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def send(df: DataFrame, words: np.ndarray) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(words)
