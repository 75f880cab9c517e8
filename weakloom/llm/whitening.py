"""Whitening of embeddings by the leading components of their covariance, found by contour integration.

Spark sums up the covariance and projects the rows; what reaches the driver is one matrix of the embeddings' width. There

1. the matrix is brought to tridiagonal form once, from which the number of eigenvalues below any value (its inertia) is counted;
2. these counts cut the upper end of the spectrum into intervals with few eigenvalues each, with borders in gaps;
3. per interval, a subspace is filtered by quadrature of complex shifted solves on a circle around the interval, and
   Rayleigh-Ritz in the subspace gives the eigenpairs; this is repeated until they stand still;
4. the pairs inside must be as many as the inertia counts say, or the subspace is widened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.llm.store import stored

#: Entries are cut to steps of ``1 / STEPS`` and moved by ``OFFSET``.
STEPS, OFFSET = 64, 1_000_000
#: Entries beyond so many steps do not fit the whole numbers used here.
LARGEST = 1 << 60
#: Nodes of the quadrature on the upper half of the circle; eigenvalues per interval at most, where gaps allow it.
NODES, PER_INTERVAL = 12, 6
#: Filter rounds before the subspace is widened, and the residual, in units of the matrix norm, at which pairs stand still.
ROUNDS, RESIDUAL = 12, 2e-14
#: Eigenvalues below this share of the trace are no components.
SMALLEST = 1e-12


# --- eigenpairs of one matrix -----------------------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of the tridiagonal form, by reflections."""
    a = np.array(matrix, dtype=float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1:, :] -= 2.0 * np.outer(x, x @ a[k + 1:, :])
        a[:, k + 1:] -= 2.0 * np.outer(a[:, k + 1:] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def below(diagonal: np.ndarray, beside: np.ndarray, value: float) -> int:
    """Eigenvalues under ``value``: the negative pivots of the shifted form."""
    count, pivot = 0, 1.0
    tiny = np.finfo(float).tiny * 1e20
    for i, d in enumerate(diagonal):
        pivot = d - value - (beside[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


class Interval(NamedTuple):
    low: float
    high: float
    count: int


def intervals(matrix: np.ndarray, wanted: int, per_interval: int = PER_INTERVAL) -> list[Interval]:
    """Intervals from the top of the spectrum down that hold at least the ``wanted`` largest eigenvalues.

    Borders are sought between two eigenvalues by halving until they part them, the wider the gap the sooner. Eigenvalues too close to be
    parted stay in one interval.
    """
    diagonal, beside = tridiagonal(matrix)
    n = len(diagonal)
    reach = np.abs(diagonal) + np.append(np.abs(beside), 0) + np.insert(np.abs(beside), 0, 0)
    span = max(float(reach.max()), np.finfo(float).tiny)
    top, bottom = span * 1.01, -span * 1.01

    def above(value: float) -> int:
        return n - below(diagonal, beside, value)

    out: list[Interval] = []
    high, done = top, 0
    while done < wanted:
        most = min(per_interval, wanted - done)
        # ``low`` has too many above, ``border`` few enough. The last border may part more than wanted, never fewer.
        low, border, found = bottom, high, 0
        while border - low > 1e-13 * span:
            middle = (low + border) / 2
            inside = above(middle) - done
            if inside > most:
                low = middle
            else:
                border, found = middle, inside
                if inside == most:
                    break
        if not found:
            # A cluster of more than ``most`` that cannot be parted: take it whole.
            border, found = low - 1e-12 * span, above(low - 1e-12 * span) - done
        else:
            # Move the border to the middle of its gap.
            lower, upper = low, border
            while upper - lower > 1e-3 * (high - border + 1e-12 * span):
                middle = (lower + upper) / 2
                if above(middle) - done == found:
                    upper = middle
                else:
                    lower = middle
            edge, step = border, 1e-12 * span
            while edge + step < high and above(edge + step) - done == found:
                edge, step = edge + step, step * 2
            border = (upper + edge) / 2
        out.append(Interval(border, high, found))
        done += found
        high = border
    return out


def filtered(matrix: np.ndarray, low: float, high: float, vectors: np.ndarray, nodes: int = NODES) -> np.ndarray:
    """The vectors under the contour integral of the resolvent around ``[low, high]``, near the projection on its eigenvectors."""
    places, weights = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(vectors)
    one = np.eye(len(matrix))
    for place, weight in zip(places, weights):
        turn = np.exp(-0.5j * np.pi * (place - 1))
        out += weight / 2 * np.real(radius * turn * np.linalg.solve((centre + radius * turn) * one - matrix, vectors.astype(complex)))
    return out


def _vectors_within(matrix: np.ndarray, part: Interval, larger: int, seed: int) -> np.ndarray:
    """Eigenvectors of one interval that has ``larger`` eigenvalues above it."""
    n = len(matrix)
    scale = np.linalg.norm(matrix)
    rng = np.random.default_rng(seed)
    width = min(n, 2 * part.count + 4)
    while True:
        vectors = rng.standard_normal((n, width))
        for _ in range(ROUNDS):
            basis, _ = np.linalg.qr(filtered(matrix, part.low, part.high, vectors))
            values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
            vectors = basis @ turn
            inside = (values > part.low) & (values < part.high)
            rest = np.linalg.norm(matrix @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == part.count and rest.max(initial=0.0) <= RESIDUAL * scale:
                return vectors[:, inside]
        if width == n:
            # The subspace is the whole space; only rounding on a border can hide a pair, so they are taken by rank.
            return vectors[:, ::-1][:, larger:larger + part.count]
        width = min(n, 2 * width)


def leading(matrix: np.ndarray, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns. The largest entry of each is positive."""
    wanted = min(wanted, len(matrix))
    if not wanted:
        return np.zeros(0), np.zeros((len(matrix), 0))
    found, larger = [], 0
    for part in intervals(matrix, wanted):
        found.append(_vectors_within(matrix, part, larger, seed + larger))
        larger += part.count
    # Intervals were solved one by one; Rayleigh-Ritz over all of them makes their vectors orthogonal to the last digit.
    basis, _ = np.linalg.qr(np.concatenate(found, axis=1))
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    values, vectors = values[::-1][:wanted], (basis @ turn)[:, ::-1][:, :wanted]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(wanted)]
    return values, vectors * np.sign(largest)


# --- the rows -----------------------------------------------------------------------------------

def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not empty, not null and holds neither null nor non-finite entries, with ``x``, its entries as whole numbers.

    Entries of more than ``LARGEST`` steps count as so many. Where vectors differ in length, only those of the most frequent length (the longest on ties) are one space; the others are left out.
    """
    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    def whole(c: Column) -> Column:
        steps = F.floor(c.cast("double") * STEPS)
        return F.greatest(F.least(steps, F.lit(LARGEST)), F.lit(-LARGEST)) + F.lit(OFFSET).cast("long")

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine))
    return rows.withColumn("x", F.transform(vector, whole))


def _width(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    best = sizes.agg(F.max(F.struct("n", "size")).alias("best")).first().best
    return best["size"] if best else 0


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(df: DataFrame, width: int, of_batch, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of ``of_batch``, a matrix per batch. A task sends one row per matrix row."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += of_batch(_matrix(batch.column(0), width))
        yield pa.record_batch([pa.array(np.arange(shape[0]), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    rows = df.select("x").mapInArrow(partial, "i int, row array<double>")
    cells = rows.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros(shape)
    for r in cells.collect():
        out[r.i, r.j] = r.value
    return out


def _whole_sums(df: DataFrame, width: int) -> list[int]:
    """The exact sum of ``x`` per dimension: upper and lower halves are added up apart."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                yield pa.record_batch([pa.array(np.arange(width), pa.int32()), pa.array((x >> 32).sum(axis=0)),
                                       pa.array((x & 0xFFFFFFFF).sum(axis=0))], ["i", "upper", "lower"])

    halves = df.select("x").mapInArrow(partial, "i int, upper bigint, lower bigint").groupBy("i").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower")])
    found = {r.i: (int(r.upper) << 32) + int(r.lower) for r in halves.collect()}
    return [found[i] for i in range(width)]


class Whitening(NamedTuple):
    """Sums and number of the fit list, its eigenvalues and components (as columns), its trace, and how far the result is from white."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean, from whole numbers."""
        return (x - self.whole_mean()) - self.rest() / self.n

    def whole_mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], float)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = 16) -> Whitening | None:
    """Fitted on each distinct ``x`` once; None without rows.

    Equal rows are folded in the map tasks before they are shuffled. Components without variance (under ``SMALLEST`` of the trace) are
    left out, so equal rows alone have none.
    """
    width = _width(rows)
    if not width:
        return None
    distinct = stored(rows.where(F.size("x") == width).select("x").distinct(), "fit-list")
    n, sums = distinct.count(), _whole_sums(distinct, width)
    plain = Whitening(n, sums, np.ones(width), np.eye(width), 0.0, 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        d = plain.centred(x)
        return d.T @ d

    covariance = _summed(distinct, width, products, (width, width)) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components) if trace > 0 else (np.zeros(0), np.zeros((width, 0)))
    kept = values > SMALLEST * trace
    model = plain._replace(values=values[kept], vectors=vectors[:, kept], trace=trace)
    k = int(kept.sum())
    if not k:
        return model
    mean = _summed(distinct, width, lambda x: model.project(x).sum(axis=0)[None, :], (1, k))[0] / n

    def white(x: np.ndarray) -> np.ndarray:
        w = model.project(x) - mean
        return w.T @ w

    error = np.abs(_summed(distinct, width, white, (k, k)) / n - np.eye(k)).max()
    return model._replace(identity_error=float(error))


def _deviation(x: np.ndarray, n: int, sums: Sequence[int]) -> list[int | None]:
    """Sum of ``(n * x - S) ** 2`` as a whole number, null where it does not fit into 64 bits."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    most = float(np.abs(x - whole).max(initial=0) + 1) * n
    if most * most * max(len(sums), 1) < 2.0 ** 62:
        d = (x - whole) * n - rest
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable row of ``df`` and component: the whitened coordinate, and figures of the fit.

    Repeated rows are returned as often as they stand. An empty table, or one without two different vectors, gives no row.
    """
    rows = stored(usable(df.select(F.col(key).alias("key"), F.col(vector).alias("vector")), "vector").select("key", "x"), "whole-vectors")
    model = fit(rows, components)
    kind = rows.schema["key"].dataType.simpleString()
    schema = (f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    width, k = len(model.sums), len(model.values)
    explained = model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            rows_of = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(rows_of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(rows_of), model.n)), pa.array(_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(rows_of)),
                 pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(rows_of), model.identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == width).mapInArrow(project, schema)
