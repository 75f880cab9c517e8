"""Chat formatting in budgeted windows.

Turns are sorted by conversation with a range partitioning that may cut a conversation, so one conversation may hold any share
of the rows. Prefix sums of turn tokens are taken inside the partitions; a conversation that goes on in the
next one gets a carry, of which there is at most one per partition. The sums alone choose the spans: a turn
belongs to the span its first token falls into, and a turn that crosses the end of a span stands by itself.
So a window keeps to its budget unless it consists of one turn that is longer.

Every window holds the system turn, some turns before the span as history, and the span. Assistant
turns of the span are targets; what is repeated is masked. The texts are fetched by
(conversation, turn), which no conversation dominates.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.llm.store import stored
from weakloom.llm.tokens import encoder

BEGIN, END = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 4
TARGET, SYSTEM = "assistant", "system"

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash into every ``<|`` and one more into those that have some already."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where the escaped text begins and ends in it."""
    head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role and text of each turn of a window, and the borders of its escaped text."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def _numbered(turns: DataFrame, vocabulary: str) -> DataFrame:
    """Turns in order, with number and prefix sum of tokens inside their partition."""
    named = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, True).encode
        part, last, number, before = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            texts = [turn_text(r, t)[0] for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            counts = np.diff(encode(pa.array(texts, pa.string()))[1]).tolist()
            places, sums = [], []
            for conv, n in zip(batch.column("conv").to_pylist(), counts):
                if conv != last:
                    last, number, before = conv, 0, 0
                places.append(number)
                sums.append(before)
                number, before = number + 1, before + n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "conv_id", "role", "text")), pa.array([part] * len(texts), pa.int32()),
                 pa.array(places, pa.int64()), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())],
                ["conv", "conv_id", "role", "text", "part", "place", "before", "n_tokens"])

    rows = named.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "conv string, conv_id bigint, role string, text string, part int, place bigint, before bigint, n_tokens bigint")
    rows = stored(rows, "turns")
    earlier = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).select(
        "conv", "part", F.sum("n").over(earlier).alias("n_carried"), F.sum("t").over(earlier).alias("t_carried"))
    carry = carry.where("n_carried is not null")  # only the first conversation of a partition can go on from the one before
    return rows.join(F.broadcast(carry), ["conv", "part"], "left").select(
        "conv", "conv_id", "role", "text", "n_tokens", (F.col("place") + F.coalesce("n_carried", F.lit(0))).alias("turn"),
        (F.col("before") + F.coalesce("t_carried", F.lit(0))).alias("before"))


def spans(turns: DataFrame, budget: int, history_tokens: int) -> DataFrame:
    """``conv, turn, before, n_tokens, span, kept_tokens``: the span of each numbered turn; tokens of the system turn, or null."""
    slim = turns.select("conv", "turn", "before", "n_tokens", "role")
    system = slim.where((F.col("turn") == 0) & (F.col("role") == SYSTEM)).select("conv", F.col("n_tokens").alias("kept_tokens"))
    room = F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.coalesce("kept_tokens", F.lit(0)))
    joined = slim.join(system, "conv", "left").withColumn("room", room)
    start = F.col("before") - F.coalesce("kept_tokens", F.lit(0))
    first, last = F.floor(F.greatest(start, F.lit(0)) / F.col("room")), F.floor((start + F.col("n_tokens") - 1) / F.col("room"))
    return joined.select(
        "conv", "turn", "before", "n_tokens", "kept_tokens",
        F.when(start < 0, F.lit(0)).otherwise(2 * first + F.when(last > first, 1).otherwise(0)).cast("bigint").alias("span"))


def windows(turns: DataFrame, vocabulary: str, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
            history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Formatted windows of conversations given as ``conv_id, turn, role, text``.

    ``conv_id, first_turn, n_repeated, n_tokens, formatted, loss_begins, loss_ends``: the place of the first new turn, how
    many turns at the head are repeated, and the targets' borders in code points of ``formatted``.

    Turns are ordered by turn, role and text, nulls first; null roles and texts are empty, and rows without a
    conversation form one together. A first turn in the role ``system`` stands in every window. At most
    ``history_turns`` turns and ``history_tokens`` tokens before a span are repeated. Repeated rows are
    turns of their own. Only the four columns are read. No turns give no windows.
    """
    numbered = _numbered(turns, vocabulary)
    placed = stored(spans(numbered, budget, history_tokens), "turn-spans")
    heads = placed.groupBy("conv", "span").agg(F.min("turn").alias("first_turn"), F.min("before").alias("from_token"),
                                               F.sum("n_tokens").alias("span_tokens"), F.first("kept_tokens").alias("kept_tokens"))
    fresh = placed.select("conv", "span", "turn", F.lit(False).alias("repeated"))
    again = heads.where("kept_tokens is not null and first_turn > 0").select("conv", "span", F.lit(0).cast("bigint").alias("turn"), F.lit(True).alias("repeated"))
    free = F.lit(budget) - F.coalesce("kept_tokens", F.lit(0)) - F.col("span_tokens")
    back = heads.select("conv", "span", "kept_tokens", (F.col("from_token") - F.least(F.lit(history_tokens), free)).alias("not_before"), F.explode(F.transform(
        F.sequence(F.lit(1), F.lit(history_turns)), lambda k: F.col("first_turn") - k)).alias("turn"))
    back = back.where((F.col("turn") >= 0) & ~(F.col("kept_tokens").isNotNull() & (F.col("turn") == 0)))
    history = back.join(placed.select("conv", "turn", "before"), ["conv", "turn"]).where(
        F.col("before") >= F.col("not_before")).select("conv", "span", "turn", F.lit(True).alias("repeated"))
    wanted = fresh.unionByName(again).unionByName(history)
    texts = wanted.join(numbered.select("conv", "conv_id", "turn", "role", "text", "n_tokens"), ["conv", "turn"])
    grouped = texts.groupBy("conv", "span").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n_tokens").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("turn", "repeated", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_window(t) for t in batch.column("turns").to_pylist()]
            columns = [pa.array([o[k] for o in out], kind) for k, kind in
                       enumerate((pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("n_tokens"), *columns],
                                             ["conv_id", "n_tokens", "first_turn", "n_repeated", "formatted", "loss_begins", "loss_ends"])

    return grouped.select("conv_id", "n_tokens", "turns").mapInArrow(
        run, "conv_id bigint, n_tokens bigint, first_turn bigint, n_repeated bigint, formatted string, "
             "loss_begins array<bigint>, loss_ends array<bigint>")


def _window(turns: list[dict]) -> tuple[int, int, str, list[int], list[int]]:
    parts, begins, ends, at = [], [], [], 0
    for t in turns:
        text, begin, end = turn_text(t["role"], t["text"])
        parts.append(text)
        if t["role"] == TARGET and not t["repeated"]:
            begins.append(at + begin)
            ends.append(at + end)
        at += len(text)
    fresh = [t["turn"] for t in turns if not t["repeated"]]
    return fresh[0], len(turns) - len(fresh), "".join(parts), begins, ends


def read_back(found: DataFrame) -> DataFrame:
    """Digests of each conversation from its windows alone: new turns in order, and the text under the loss mask.

    A digest over a conversation reads it in order, so one conversation passes one task; it is streamed, not collected.
    """
    ordered = found.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        done.append(now.result())
                    now = _Digest(row["conv_id"])
                now.add(row)
            yield pa.RecordBatch.from_pylist(done, _DIGESTS)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.result()], _DIGESTS)

    return ordered.select("conv_id", "first_turn", "n_repeated", "formatted", "loss_begins", "loss_ends").mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                      ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Digest:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n_turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        text = row["formatted"]
        self.chars += len(text)
        for role, body, _, _ in parse(text)[row["n_repeated"]:]:
            self.n_turns += 1
            self.turns.update(f"{role}\n{body}\n".encode())
        for begin, end in zip(row["loss_begins"], row["loss_ends"]):
            target = unescape(text[begin:end])
            self.loss_chars += len(target)
            self.loss.update(target.encode())

    def result(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}
