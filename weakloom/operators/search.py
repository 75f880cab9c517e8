"""The nearest rows for many query vectors at once, exactly or through an index of cells.

Rows and queries are packed into blocks of about ``BLOCK_BYTES``. A task multiplies one block of queries with one block of rows and keeps the
best ``k`` per query; these short lists are merged by query. A query is sent once per block of rows it has to meet, a row once per block of
queries, and nothing grows with the number of pairs but the multiplications themselves.

The exact search has one cell that holds all rows. The index deals rows to the nearest of a fixed number of centres; a query meets only
the cells nearest to it, whose rows are compared exactly. How many cells that takes is measured against the exact search.

Scores are cosines in double precision. Scores that agree to ``DIGITS`` digits are ties, and the smaller key comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.session import durable

#: Bytes of vectors per block of rows or queries, and cells of a product at once.
BLOCK_BYTES, CELLS_AT_ONCE = 16 << 20, 1 << 22
DIGITS = 9
#: Centres of the index, rows per centre they are fitted on at most, and rounds of fitting.
CELLS, SAMPLE_PER_CELL, ROUNDS = 64, 128, 12
#: Queries whose neighbours are searched exactly to see how many cells are needed.
AUDITED = 64


# --- vectors --------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Vectors with a direction: not null, not empty, not zero, all entries finite."""
    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    return (vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))
            & F.coalesce(F.exists(vector, lambda c: c != 0), F.lit(False)))


def common_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the usable vectors, the longest on ties; 0 if there are none."""
    sizes = df.where(usable(F.col(vector))).groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max(F.struct("n", "size")).alias("best")).first().best
    return best["size"] if best else 0


def _named(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    rows = df.where(usable(F.col(vector)) & (F.size(vector) == width) & F.col(key).isNotNull())
    return rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


# --- blocks and products --------------------------------------------------------------------------

def _blocked(df: DataFrame, width: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """``(blocks, parts)`` of ``df (cell, key, vector)``: unit vectors packed per ``(cell, part)``, and the number of parts of each cell.

    A cell with many rows has many parts. Rows are dealt by a number written with them, so equal rows do not meet in one part.
    """
    numbered = durable(df.withColumn("n", F.monotonically_increasing_id()))
    # One row per cell, and the number of cells is a parameter.
    parts = durable(numbered.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("parts")))
    dealt = numbered.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("n"), "parts").cast("int"))
    kind = df.schema["key"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("n").combine_chunks()
        units = _units(_matrix(table["vector"], width))
        keys = pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.concat_arrays(table["key"].chunks))
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1], "keys": keys, "units": pa.array([units.tobytes()], pa.binary())})

    blocks = dealt.groupBy("cell", "part").applyInArrow(pack, f"cell int, part int, keys array<{kind}>, units binary")
    return durable(blocks), parts


def best_rows(scores: np.ndarray, keys: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row of ``scores`` the places of its ``k`` largest, equal ones by key. ``keys`` hold the order of the columns' keys."""
    out = []
    for row in scores:
        places = np.arange(len(row))
        if len(row) > k:
            places = places[row >= np.partition(row, len(row) - k)[len(row) - k]]
        out.append(places[np.lexsort((keys[places], -row[places]))][:k])
    return out


def _products(width: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def product(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return pa.table({"query": queries["q_keys"][:0].combine_chunks().flatten(), "key": rows["keys"][:0].combine_chunks().flatten(),
                             "score": pa.array([], pa.float64())})
        keys, asked = rows["keys"][0].values, queries["q_keys"][0].values
        units = np.frombuffer(rows["units"][0].as_buffer()).reshape(-1, width)
        asking = np.frombuffer(queries["q_units"][0].as_buffer()).reshape(-1, width)
        order = np.empty(len(keys), np.int64)
        order[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        step = max(1, CELLS_AT_ONCE // len(units))
        query, row, score = [], [], []
        for at in range(0, len(asking), step):
            scores = np.round(asking[at:at + step] @ units.T, DIGITS)
            for i, places in enumerate(best_rows(scores, order, k)):
                query.append(np.full(len(places), at + i))
                row.append(places)
                score.append(scores[i, places])
        return pa.table({"query": asked.take(pa.array(np.concatenate(query))), "key": keys.take(pa.array(np.concatenate(row))),
                         "score": pa.array(np.concatenate(score))})

    return product


def _matched(rows: DataFrame, queries: DataFrame, width: int, k: int, block_bytes: int) -> DataFrame:
    """``(query, key, score, rank)`` of ``rows (cell, key, vector)`` and ``queries (cell, key, vector)`` that share a cell."""
    size = max(1, block_bytes // (8 * max(width, 1)))
    held, held_parts = _blocked(rows, width, size)
    asking, asking_parts = _blocked(queries, width, size)

    def times(parts: DataFrame) -> DataFrame:
        return F.broadcast(parts.select("cell", F.col("parts").alias("others")))

    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    left = held.join(times(asking_parts), "cell").select("cell", "part", every.alias("asker"), "keys", "units")
    right = asking.join(times(held_parts), "cell").select(
        F.col("cell").alias("q_cell"), every.alias("q_part"), F.col("part").alias("q_asker"), F.col("keys").alias("q_keys"),
        F.col("units").alias("q_units"))
    kinds = [df.schema["key"].dataType.simpleString() for df in (queries, rows)]
    best = left.groupBy("cell", "part", "asker").cogroup(right.groupBy("q_cell", "q_part", "q_asker")).applyInArrow(
        _products(width, k), f"query {kinds[0]}, key {kinds[1]}, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))
    # Spark keeps ``k`` rows per query and task before it merges them.
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query_key: str | None = None,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(query, key, score, rank)``: for each query the ``k`` rows of highest cosine among all rows.

    Keys should be unique in each table. Rows and queries without a key or a direction, or of another length than most rows, are left out.
    A query that stands among the rows finds itself.
    """
    width = common_length(rows, vector)
    one = F.lit(0).alias("cell")
    held = _named(rows, key, vector, width).select(one, "key", "vector")
    asking = _named(queries, query_key or key, vector, width).select(one, "key", "vector")
    return _matched(held, asking, width, k, block_bytes)


# --- the index ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class CellIndex:
    """Centres of unit length, and all rows with the cell of their nearest centre."""

    centres: np.ndarray
    rows: DataFrame
    width: int


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first."""
    return np.argsort(-np.round(_units(vectors) @ centres.T, DIGITS), axis=1, kind="stable")[:, :n]


def fit_centres(vectors: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centres of the unit vectors, by rounds of dealing and averaging; a centre that loses all its vectors stays where it was."""
    units = _units(vectors)
    pick = np.random.default_rng(seed)
    centres = units[pick.choice(len(units), min(cells, len(units)), replace=False)]
    for _ in range(rounds):
        nearest_centre = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest_centre, units)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(lengths > 1e-9, sums / np.maximum(lengths, 1e-9), centres)
    return centres


def _with_cells(df: DataFrame, width: int, centres: np.ndarray, n: int) -> DataFrame:
    """``(cell, key, vector)``, one row per vector and each of its ``n`` nearest cells. Without centres all are in one cell."""
    if not len(centres):
        return df.select(F.lit(0).alias("cell"), "key", "vector")
    kind = df.schema["key"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = nearest_cells(_matrix(batch.column("vector"), width), centres, n)
                take = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.record_batch([pa.array(cells.ravel().astype(np.int32)), batch.column("key").take(take),
                                       batch.column("vector").take(take)], ["cell", "key", "vector"])

    return df.select("key", "vector").mapInArrow(deal, f"cell int, key {kind}, vector array<double>")


def build_index(rows: DataFrame, key: str, vector: str, cells: int = CELLS, seed: int = 0) -> CellIndex:
    """An index of all usable rows. Its centres are fitted on at most ``cells * SAMPLE_PER_CELL`` rows, those with the smallest hash of their
    key; every row is indexed."""
    width = common_length(rows, vector)
    named = _named(rows, key, vector, width)
    sample = named.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(cells * SAMPLE_PER_CELL).select("vector").toArrow()
    vectors = _matrix(sample["vector"], width) if len(sample) else np.zeros((0, max(width, 1)))
    centres = fit_centres(vectors, cells, seed=seed) if len(vectors) else vectors
    return CellIndex(centres, durable(_with_cells(named, width, centres, 1)), width)


def search_index(index: CellIndex, queries: DataFrame, k: int, key: str, vector: str, probes: int,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As ``nearest``, over the rows of the ``probes`` cells nearest to each query. With as many probes as cells it is exact."""
    asking = _with_cells(_named(queries, key, vector, index.width), index.width, index.centres, probes)
    return _matched(index.rows, asking, index.width, k, block_bytes)


def probes_needed(index: CellIndex, queries: DataFrame, k: int, key: str, vector: str, recall: float = 0.95, audited: int = AUDITED) -> int:
    """The fewest probes that find the share ``recall`` of the true neighbours of ``audited`` queries, those with the smallest hash of their key.

    The neighbours are searched exactly once; the place of their cells among the cells of the query says which number of probes finds them.
    """
    if not len(index.centres):
        return 1
    some = durable(_named(queries, key, vector, index.width).orderBy(F.xxhash64("key"), "key").limit(audited))
    true = nearest(index.rows, some, k, "key", "vector").join(index.rows.select("key", "cell"), "key")
    ranks = {r.key: {int(c): i for i, c in enumerate(nearest_cells(np.array([r.vector]), index.centres, len(index.centres))[0])} for r in some.collect()}
    places = sorted(ranks[r["query"]][r.cell] for r in true.select("query", "cell").collect())
    return places[max(0, int(np.ceil(recall * len(places))) - 1)] + 1 if places else 1


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the pairs of ``exact`` that are in ``found``; 1 if there are none."""
    hit = exact.select("query", "key").join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left")
    row = hit.agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("n")).first()
    return row.hit / row.n if row.n else 1.0
