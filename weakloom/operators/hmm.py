"""Hidden states of a document's paragraphs: forward-backward and Baum-Welch as scans of matrix products.

A paragraph is seen as one of a few symbols. Its step in the chain is a small matrix, and the steps of a run of paragraphs multiply to
one matrix of the same size; the product is associative but not commutative. So a document is cut into chunks by the paragraph number:

1. every chunk multiplies its steps (only documents with several chunks need this);
2. one row per chunk goes through a scan over the document, itself cut into groups if a document has very many chunks, which gives the state
   distribution before each chunk and the likelihood of what comes behind it;
3. every chunk then runs forward and backward by itself.

Paragraphs are packed into one row per chunk once; a round of training reads those rows and sums a fixed number of expected counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.session import durable

#: Paragraphs per chunk, and chunks per group of the scan.
CHUNK, GROUP = 256, 4096
#: Cells of paragraphs times states worked on at once.
CELLS = 1 << 20


@dataclass(frozen=True)
class HiddenStates:
    """Probabilities of the first state, of each state after each, and of each symbol in each state. All must be above 0."""

    start: tuple
    step: tuple
    emit: tuple

    def __post_init__(self) -> None:
        start, step, emit = self.arrays()
        n = len(start)
        if step.shape != (n, n) or emit.ndim != 2 or len(emit) != n:
            raise ValueError("one row of steps and of symbols per state")
        if min(start.min(), step.min(), emit.min()) <= 0:
            raise ValueError("probabilities must be above 0")

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.start, float), np.array(self.step, float), np.array(self.emit, float)

    @property
    def n_states(self) -> int:
        return len(self.start)

    @property
    def n_symbols(self) -> int:
        return len(self.emit[0])

    def seen(self) -> np.ndarray:
        """Likelihood of each symbol per state; the last row stands for an unknown symbol, which says nothing."""
        return np.vstack([np.array(self.emit, float).T, np.ones(self.n_states)])


def _frozen(x: np.ndarray) -> tuple:
    return tuple(_frozen(row) if row.ndim else float(row) for row in x)


# --- chunks -------------------------------------------------------------------------------------

def chunked(df: DataFrame, group: str, order: str, symbol: str, chunk: int = CHUNK) -> DataFrame:
    """``(doc, chunk, first, last, places, symbols)``: the rows of each group in order, one row per chunk, written once.

    ``(group, order)`` must be unique; rows without an order have no place and are left out. Gaps in the order do not matter.
    """
    slim = df.where(F.col(order).isNotNull()).select(
        F.col(group).alias("doc"), F.expr(f"`{order}` div {int(chunk)}").alias("chunk"),
        F.struct(F.col(order).cast("long").alias("place"), F.col(symbol).cast("int").alias("symbol")).alias("at"))
    packed = slim.groupBy("doc", "chunk").agg(F.array_sort(F.collect_list("at")).alias("at"))
    packed = durable(packed.select("doc", "chunk", F.col("at.place").alias("places"), F.col("at.symbol").alias("symbols")))
    ends = packed.groupBy(F.col("doc").alias("_doc")).agg(F.min("chunk").alias("_first"), F.max("chunk").alias("_last"))
    joined = packed.join(ends, F.col("doc").eqNullSafe(F.col("_doc")))
    return durable(joined.select("doc", "chunk", (F.col("chunk") == F.col("_first")).alias("first"),
                                 (F.col("chunk") == F.col("_last")).alias("last"), "places", "symbols"))


def _blocks(batch: pa.RecordBatch, n_states: int, n_symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, symbols, lengths)`` of runs of about equally long rows; unknown symbols get the number after the last."""
    lists = batch.column("symbols")
    lengths = lists.value_lengths().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = lists.flatten().fill_null(-1).to_numpy()
    flat = np.where((flat < 0) | (flat >= n_symbols), n_symbols, flat)
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * int(lengths[order[end]]) * n_states <= CELLS:
            end += 1
        rows = order[at:end]
        cells = starts[rows][:, None] + np.arange(lengths[rows].max())
        yield rows, flat[np.minimum(cells, len(flat) - 1)], lengths[rows]
        at = end


def _products(model: HiddenStates, symbols: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The product of the steps of each row, scaled. The first chunk of a document begins without a step."""
    _, step, _ = model.arrays()
    seen = model.seen()
    out = np.where(first[:, None, None], np.eye(len(step)), step) * seen[symbols[:, 0]][:, None, :]
    for t in range(1, symbols.shape[1]):
        inside = t < lengths
        new = (out @ step) * seen[symbols[:, t]][:, None, :]
        out = np.where(inside[:, None, None], new / new.max(axis=(1, 2), keepdims=True), out)
    return out


def _forward_backward(model: HiddenStates, symbols: np.ndarray, lengths: np.ndarray, first: np.ndarray, left: np.ndarray,
                      right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(posteriors, steps, likelihood)`` of each row: of each place, expected steps between states, and logarithm."""
    start, step, _ = model.arrays()
    seen = model.seen()[symbols]
    n, length = symbols.shape
    alpha, beta = np.zeros((n, length, len(start))), np.ones((n, length, len(start)))
    before = np.where(first[:, None], start, left @ step)
    logs = np.zeros(n)
    for t in range(length):
        inside = t < lengths
        now = (before if t == 0 else alpha[:, t - 1] @ step) * seen[:, t]
        total = now.sum(axis=1)
        alpha[:, t] = np.where(inside[:, None], now / total[:, None], alpha[:, t - 1] if t else 0.0)
        logs += np.where(inside, np.log(total), 0.0)
    counts = np.zeros((n, len(start), len(start)))
    for t in range(length - 1, -1, -1):
        if t + 1 < length:
            on = beta[:, t + 1] * seen[:, t + 1]
            behind = on @ step.T
            beta[:, t] = np.where((t + 1 < lengths)[:, None], behind / behind.max(axis=1, keepdims=True), beta[:, t])
        beta[:, t] = np.where((t + 1 == lengths)[:, None], right, beta[:, t])
        previous = alpha[:, t - 1] if t else left
        both = previous[:, :, None] * step * (beta[:, t] * seen[:, t])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        counted = (t < lengths) & ((t > 0) | ~first)
        counts += np.where(counted[:, None, None], both, 0.0)
    gamma = alpha * beta
    return gamma / gamma.sum(axis=2, keepdims=True), counts, logs


# --- the scan over chunks -----------------------------------------------------------------------

_PRODUCT = "doc {kind}, at bigint, first boolean, product array<double>"
_STATE = "doc {kind}, at bigint, before array<double>, behind array<double>"


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


def _matrices(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, n, n)


def _run(products: np.ndarray, before: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vector before each of a run of matrices and the one behind it, from those around the run."""
    n, size = len(products), len(before)
    left, right = np.empty((n, size)), np.empty((n, size))
    for i in range(n):
        left[i] = before
        before = before @ products[i]
        before = before / before.sum()
    for i in range(n - 1, -1, -1):
        right[i] = behind
        behind = products[i] @ behind
        behind = behind / behind.max()
    return left, right


def around_chunks(products: DataFrame, model: HiddenStates, group: int = GROUP) -> DataFrame:
    """``(doc, at, before, behind)`` for ``(doc, at, first, product)``: state distribution before and likelihood behind each chunk.

    A document with more than ``group`` chunks is cut once more: its groups are multiplied, scanned the same way, and then run.
    """
    size = model.n_states
    start, ones = model.arrays()[0], np.ones(size)
    kind = products.schema["doc"].dataType.simpleString()
    reach = products.agg((F.max("at") - F.min("at")).alias("reach")).first().reach
    if reach is None or reach < group:
        def whole(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            left, right = _run(_matrices(table["product"], size), start, ones)
            return pa.table({"doc": table["doc"], "at": table["at"], "before": _lists(left), "behind": _lists(right)})

        return products.groupBy("doc").applyInArrow(whole, _STATE.format(kind=kind))

    def multiplied(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        out = np.eye(size)
        for m in _matrices(table["product"], size):
            out = out @ m
            out = out / out.max()
        return pa.table({"doc": table["doc"][:1], "at": table["group"][:1], "first": [any(table["first"].to_pylist())],
                         "product": _lists(out.reshape(1, -1))})

    def inside(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("at")
        ends = [np.array(right[c][0].as_py()) for c in ("before", "behind")]
        before, behind = _run(_matrices(left["product"], size), *ends)
        return pa.table({"doc": left["doc"], "at": left["at"], "before": _lists(before), "behind": _lists(behind)})

    grouped = durable(products.withColumn("group", F.expr(f"at div {int(group)}")))
    larger = grouped.groupBy("doc", "group").applyInArrow(multiplied, _PRODUCT.format(kind=kind))
    around = durable(around_chunks(durable(larger), model, group)).select(
        F.col("doc").alias("of"), F.col("at").alias("group_of"), "before", "behind")
    return grouped.groupBy("doc", "group").cogroup(around.groupBy("of", "group_of")).applyInArrow(inside, _STATE.format(kind=kind))


def with_surroundings(chunks: DataFrame, model: HiddenStates, group: int = GROUP) -> DataFrame:
    """``chunks`` with ``before`` and ``behind``; those of documents with one chunk get none and take no part in the scan."""
    several = chunks.where("not (first and last)")
    kind = chunks.schema["doc"].dataType.simpleString()
    size, symbols = model.n_states, model.n_symbols

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first = batch.column("first").to_numpy(zero_copy_only=False)
                out = np.empty((batch.num_rows, size * size))
                for rows, seen, lengths in _blocks(batch, size, symbols):
                    out[rows] = _products(model, seen, lengths, first[rows]).reshape(len(rows), -1)
                yield pa.record_batch([batch.column("doc"), batch.column("chunk"), batch.column("first"), _lists(out)],
                                      ["doc", "at", "first", "product"])

    products = durable(several.select("doc", F.col("chunk").cast("long").alias("chunk"), "first", "symbols").mapInArrow(
        multiply, _PRODUCT.format(kind=kind)))
    around = around_chunks(products, model, group).select(F.col("doc").alias("_doc"), "at", "before", "behind")
    joined = several.join(around, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("chunk") == F.col("at"))).drop("_doc", "at")
    none = F.lit(None).cast("array<double>")
    return joined.unionByName(chunks.where("first and last").select("*", none.alias("before"), none.alias("behind")))


def _borders(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = batch.column("first").to_numpy(zero_copy_only=False)
    none = [1.0 / size] * size
    left = np.array([x or none for x in batch.column("before").to_pylist()], float)
    right = np.array([x or [1.0] * size for x in batch.column("behind").to_pylist()], float)
    return first, left, right


# --- operators ----------------------------------------------------------------------------------

def state_posteriors(chunks: DataFrame, model: HiddenStates, group: int = GROUP) -> DataFrame:
    """``(doc, place, proba)``: the probability of each state at each place, given all symbols of the document.

    An unknown symbol (null, or one the model has no number for) says nothing about its place; an empty table has no rows.
    """
    kind = chunks.schema["doc"].dataType.simpleString()
    size, symbols = model.n_states, model.n_symbols

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, left, right = _borders(batch, size)
            for rows, seen, lengths in _blocks(batch, size, symbols):
                gamma, _, _ = _forward_backward(model, seen, lengths, first[rows], left[rows], right[rows])
                inside = np.arange(seen.shape[1]) < lengths[:, None]
                docs = batch.column("doc").take(pa.array(np.repeat(rows, lengths)))
                places = batch.column("places").take(pa.array(rows)).flatten()
                yield pa.record_batch([docs, places, _lists(gamma[inside])], ["doc", "place", "proba"])

    return with_surroundings(chunks, model, group).select("doc", "first", "places", "symbols", "before", "behind").mapInArrow(
        judge, f"doc {kind}, place bigint, proba array<double>")


def expected_counts(chunks: DataFrame, model: HiddenStates, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected first states, steps and symbols over all documents, and the logarithm of their likelihood.

    A task sends one row; states times states and states times symbols reach the driver.
    """
    size, symbols = model.n_states, model.n_symbols

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, steps, emitted, total = np.zeros(size), np.zeros((size, size)), np.zeros((symbols + 1, size)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            first, left, right = _borders(batch, size)
            for rows, seen, lengths in _blocks(batch, size, symbols):
                gamma, counts, logs = _forward_backward(model, seen, lengths, first[rows], left[rows], right[rows])
                inside = np.arange(seen.shape[1]) < lengths[:, None]
                np.add.at(emitted, seen[inside], gamma[inside])
                starts += gamma[first[rows], 0].sum(axis=0)
                steps += counts.sum(axis=0)
                total += logs.sum()
        flat = np.concatenate([starts, steps.ravel(), emitted[:symbols].T.ravel(), [total]])
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "value"])

    rows = with_surroundings(chunks, model, group).select("first", "symbols", "before", "behind").mapInArrow(count, "i int, value double")
    table = {r.i: r.value for r in rows.groupBy("i").agg(F.sum("value").alias("value")).collect()}
    flat = np.array([table.get(i, 0.0) for i in range(size + size * size + size * symbols + 1)])
    steps, emitted = flat[size:size + size * size], flat[size + size * size:-1]
    return flat[:size], steps.reshape(size, size), emitted.reshape(size, symbols), float(flat[-1])


def updated(counts: Sequence, smoothing: float) -> HiddenStates:
    """The model of most likelihood for expected counts, each with ``smoothing`` added so that nothing becomes impossible."""
    shares = []
    for x in counts[:3]:
        x = np.asarray(x, float) + smoothing
        shares.append(_frozen(x / x.sum(axis=-1, keepdims=True)))
    return HiddenStates(*shares)


def fit_states(chunks: DataFrame, model: HiddenStates, rounds: int = 10, smoothing: float = 1e-3,
               group: int = GROUP) -> tuple[HiddenStates, list[float]]:
    """The model after ``rounds`` rounds from ``model``, and the log-likelihood before each round and after the last.

    Each round only carries the model's numbers on, so nothing has to be cut or kept between rounds.
    """
    likelihoods = []
    for _ in range(rounds):
        counts = expected_counts(chunks, model, group)
        likelihoods.append(counts[3])
        model = updated(counts, smoothing)
    likelihoods.append(expected_counts(chunks, model, group)[3])
    return model, likelihoods
