"""Words used alike, and texts augmented with them.

1. Words of a vocabulary that stand near each other are counted in the task that reads the text, and summed.
2. How much more often than by chance two words meet (positive mutual information) makes a sparse vector per word.
3. Words whose vectors fall on the same side of several random planes in one of a few tables are compared exactly. The planes are digests
   of word and number, so they are the same everywhere.
4. A copy of a text has some words replaced by one of their neighbours. Which, depends on a seed, the row's key, the copy and the place alone.

Tables have the size of the vocabulary, a parameter, times the words each meets.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.functions import tokens as tk
from weakloom.session import durable

#: Words to each side that count as near; tables of planes and planes per table; neighbours kept per word.
WINDOW, TABLES, PLANES, NEIGHBOURS = 2, 8, 6, 5
#: Words below this cosine are no neighbours.
SIMILAR = 0.2
_TOKEN = re.compile(r"[^\W]+")


def meeting_words(df: DataFrame, text: str, terms: Sequence[str], window: int = WINDOW) -> DataFrame:
    """``(a, b, n)``: how often two different words of the vocabulary stand at most ``window`` words apart, in both orders."""
    sent = df.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    size = len(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = sent.value
        for batch in batches:
            found = []
            for words in batch.column(0):
                ids = np.array([places.get(w, -1) for w in words.as_py()], np.int64)
                for apart in range(1, min(window, len(ids) - 1) + 1):
                    left, right = ids[:-apart], ids[apart:]
                    both = (left >= 0) & (right >= 0) & (left != right)
                    found += [left[both] * size + right[both], right[both] * size + left[both]]
            pair, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.record_batch([pa.array((pair // max(size, 1)).astype(np.int32)), pa.array((pair % max(size, 1)).astype(np.int32)),
                                   pa.array(n.astype(np.int64))], ["i", "j", "n"])

    counted = df.select(tk.tokens(F.col(text)).alias("words")).mapInArrow(count, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    # As long as the vocabulary.
    names = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(terms)), "at int, term string"))
    return counted.join(names.withColumnsRenamed({"at": "i", "term": "a"}), "i").join(names.withColumnsRenamed({"at": "j", "term": "b"}), "j").select(
        "a", "b", "n")


def mutual_information(meetings: DataFrame) -> DataFrame:
    """``(a, b, weight)``: the logarithm of how much more often the words meet than by chance, where that is above 0."""
    total = meetings.agg(F.sum("n").alias("n")).scalar()
    alone = meetings.groupBy(F.col("a").alias("_word")).agg(F.sum("n").alias("_n"))
    first = meetings.join(alone.withColumnsRenamed({"_word": "a", "_n": "n_a"}), "a")
    both = first.join(alone.withColumnsRenamed({"_word": "b", "_n": "n_b"}), "b")
    weight = F.log(F.col("n").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b")))
    return both.select("a", "b", weight.alias("weight")).where(F.col("weight") > 0)


def side(word: Column, plane: Column) -> Column:
    """1 or -1: the side of a plane a word of the vocabulary stands for."""
    digit = F.conv(F.substring(F.md5(F.concat(word, F.lit(" "), plane.cast("string"))), 1, 1), 16, 10).cast("int")
    return F.when(digit < 8, F.lit(1.0)).otherwise(F.lit(-1.0))


def buckets(vectors: DataFrame, tables: int = TABLES, planes: int = PLANES) -> DataFrame:
    """``(word, table, bucket)``: the sides of a word's vector ``(a, b, weight)``, per table."""
    numbers = F.sequence(F.lit(0), F.lit(tables * planes - 1))
    # A vector meets the digests of its few words; the sums are made in the map tasks first.
    spread = vectors.select("a", "b", "weight", F.explode(numbers).alias("plane"))
    sums = spread.groupBy("a", "plane").agg(F.sum(F.col("weight") * side(F.col("b"), F.col("plane"))).alias("sum"))
    bit = F.when(F.col("sum") > 0, F.call_function("shiftleft", F.lit(1), F.col("plane") % planes)).otherwise(0)
    return sums.groupBy(F.col("a").alias("word"), F.floor(F.col("plane") / planes).cast("int").alias("table")).agg(F.sum(bit).alias("bucket"))


def neighbours(vectors: DataFrame, tables: int = TABLES, planes: int = PLANES, most: int = NEIGHBOURS, similar: float = SIMILAR) -> DataFrame:
    """``(word, neighbour, cosine, rank)``: of the words that share a bucket, the ``most`` with the highest cosine, ``similar`` at least.

    Cosines that agree to 9 digits are ties; the first word in order wins. ``vectors (a, b, weight)`` should be a written table.
    """
    dealt = durable(buckets(vectors, tables, planes))
    met = dealt.join(dealt.select("table", "bucket", F.col("word").alias("neighbour")), ["table", "bucket"])
    pairs = met.where("word <> neighbour").select("word", "neighbour").distinct()
    norms = vectors.groupBy(F.col("a").alias("_word")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    x = pairs.join(vectors.select(F.col("a").alias("word"), "b", F.col("weight").alias("x")), "word")
    both = x.join(vectors.select(F.col("a").alias("neighbour"), "b", F.col("weight").alias("y")), ["neighbour", "b"])
    dots = both.groupBy("word", "neighbour").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scaled = dots.join(norms.withColumnsRenamed({"_word": "word", "_norm": "n_x"}), "word").join(
        norms.withColumnsRenamed({"_word": "neighbour", "_norm": "n_y"}), "neighbour")
    cosine = F.round(F.col("dot") / (F.col("n_x") * F.col("n_y")), 9)
    order = W.partitionBy("word").orderBy(F.desc("cosine"), "neighbour")
    ranked = scaled.select("word", "neighbour", cosine.alias("cosine")).where(F.col("cosine") >= similar)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _draw(*parts: object) -> int:
    """A number of 32 bits that depends on the parts alone."""
    h = zlib.crc32("\x1f".join(map(str, parts)).encode())
    return (h * 2654435761 ^ h >> 15) & 0xFFFFFFFF


def replaced(text: str, near: dict[str, list[str]], share: float, *seed: object) -> str:
    """``text`` with about ``share`` of the words that have neighbours replaced by one of them; capitals at the beginning of a word stay."""
    def swap(match: re.Match) -> str:
        word = match.group()
        known = near.get(word.lower())
        if not known or _draw(*seed, match.start(), "take") >= share * 2 ** 32:
            return word
        new = known[_draw(*seed, match.start(), "which") % len(known)]
        return new.capitalize() if word[:1].isupper() else new

    return _TOKEN.sub(swap, text)


def augmented(df: DataFrame, key: str, text: str, found: DataFrame, copies: int = 1, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``df`` with ``copies`` rows for each row, numbered from 1 in ``copy``, their ``text`` with words replaced; other columns stay.

    ``found`` is a table of ``neighbours``, as long as the vocabulary times the neighbours per word. A null text stays null. The same row
    gives the same copies on any number of tasks.
    """
    listed = found.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("near"))
    sent = df.sparkSession.sparkContext.broadcast({r.word: list(r.near) for r in listed.collect()})
    repeated = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = [None if t is None else replaced(t, near, share, seed, k, c) for t, k, c in zip(
                *(batch.column(name).to_pylist() for name in (text, key, "copy")))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return repeated.mapInArrow(rewrite, repeated.schema)
