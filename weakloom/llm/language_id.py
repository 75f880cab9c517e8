"""Language ID by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams (1 to 3 letters, words padded by a blank), most
frequent first. A document gets the language whose profile is nearest to its own by out-of-place distance:
the sum over the document's n-grams of how far their ranks differ, or the profile size where the language
lacks the n-gram.

Profiles are learned from every training text, not from a sample: n-grams are counted inside the tasks and only counts
are shuffled. The profiles (languages x profile size) go to all tasks; prediction is a narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weakloom.llm.words import released, slices

PROFILE = 300
LONGEST = 3
UNKNOWN = "und"
#: More labels than this are taken for an error in the labels; bounds what is sent to tasks.
MAX_LANGUAGES = 2000

_BLANK = 0x20
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _tables["letters"]


class Grams(NamedTuple):
    """N-grams of texts: one entry per text and distinct n-gram, sorted by both."""

    row: np.ndarray
    gram: np.ndarray  # code points of the n-gram, 21 bits each, first letter highest
    count: np.ndarray


def count_grams(texts: list[str | None], rows: np.ndarray, longest: int = LONGEST) -> Grams:
    """Count the n-grams of the texts by the given non-negative numbers, which may repeat."""
    names, rows = np.unique(rows, return_inverse=True)
    lowered = [(t or "").lower() for t in texts]
    codes = np.frombuffer(" ".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    row = np.repeat(rows, sizes)[:len(codes)]
    codes = np.where(_letters()[codes], codes, _BLANK)
    codes, row = np.concatenate([[_BLANK], codes, [_BLANK]]), np.concatenate([row[:1], row, row[-1:]])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)
    codes, row = codes[keep], row[keep]
    symbols, small = np.unique(codes, return_inverse=True)
    bits = max(1, int(len(symbols)).bit_length())
    if bits * longest + int(rows.max(initial=0)).bit_length() > 63:
        # A wild mixture of scripts: in halves. One text alone has the number 0 and always fits.
        half = len(texts) // 2
        return _merge([count_grams(texts[:half], names[rows[:half]], longest), count_grams(texts[half:], names[rows[half:]], longest)])
    small = small.astype(np.int64) + 1
    letter = codes != _BLANK
    found = []
    owner = row.copy()
    owner[:-1] = np.where(letter[:-1], row[:-1], row[1:])  # a leading blank belongs to the word after it
    for n in range(1, longest + 1):
        m = len(small) - n + 1
        if m <= 0:
            break
        key = np.zeros(m, np.int64)
        for k in range(longest):
            key = (key << bits) | (small[k:k + m] if k < n else 0)
        ok = letter[:m].copy() if n == 1 else np.ones(m, bool)
        if n == 2:
            ok &= letter[:m] | letter[1:]
        for k in range(1, n - 1):
            ok &= letter[k:k + m]
        found.append((owner[:m][ok] << (bits * longest)) | key[ok])
    every = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(every)))
    packed = every[new]
    gram = np.zeros(len(new), np.int64)
    wide = np.concatenate([[0], symbols.astype(np.int64)])
    for k in range(longest):
        part = (packed >> (bits * (longest - 1 - k))) & ((1 << bits) - 1)
        gram |= wide[part] << (21 * (longest - 1 - k))
    return Grams(names[packed >> (bits * longest)], gram, count)


def _merge(parts: list[Grams]) -> Grams:
    row, gram, count = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((gram, row))
    row, gram, count = row[order], gram[order], count[order]
    if not len(row):
        return Grams(row, gram, count)
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])]))
    return Grams(row[new], gram[new], np.add.reduceat(count, new))


def top(grams: Grams, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and rank of the ``size`` most frequent n-grams of each row; ties by code points."""
    most = int(grams.count.max(initial=0))
    order = np.argsort(grams.row * (most + 1) + (most - grams.count), kind="stable")
    row, gram = grams.row[order], grams.gram[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < size
    return row[keep], gram[keep], rank[keep]


class Profiles(NamedTuple):
    languages: list[str]
    grams: list[np.ndarray]  # sorted
    ranks: list[np.ndarray]
    size: int


def fit(train: DataFrame, lang: str = "lang", text: str = "text", size: int = PROFILE, longest: int = LONGEST) -> Profiles:
    """Profiles of all labels, from all rows with a label. Nothing to learn from gives no profile, and more than ``MAX_LANGUAGES`` labels
    raise ``ValueError``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("lang").dictionary_encode()
            numbers, names = labels.indices.to_numpy().astype(np.int64), labels.dictionary
            parts, at = [], 0
            for part in slices(batch, "text"):
                parts.append(count_grams(part.column("text").to_pylist(), numbers[at:at + part.num_rows], longest))
                at += part.num_rows
            if parts:
                grams = _merge(parts)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(grams.row)), pa.array(grams.gram), pa.array(grams.count)], ["lang", "gram", "n"])

    slim = train.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null")
    counts = slim.mapInArrow(released(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", place).where(F.col("rank") <= size)
    found = best.select("lang", "gram", "rank").limit(MAX_LANGUAGES * size + 1).toArrow().to_pandas()
    if len(found) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = found.sort_values(["lang", "gram"])
    groups = [(name, g["gram"].to_numpy(), g["rank"].to_numpy() - 1) for name, g in found.groupby("lang", sort=True)]
    return Profiles([g[0] for g in groups], [g[1] for g in groups], [g[2] for g in groups], size)


def distances(profiles: Profiles, row: np.ndarray, gram: np.ndarray, rank: np.ndarray, n_rows: int) -> np.ndarray:
    """Out-of-place distance of each row to each language."""
    out = np.zeros((n_rows, len(profiles.languages)))
    for k, (known, ranks) in enumerate(zip(profiles.grams, profiles.ranks)):
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        off = np.where(known[at] == gram, np.abs(ranks[at] - rank), profiles.size)
        out[:, k] = np.bincount(row, off, n_rows)
    return out


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added.

    ``score`` is 1 less the distance as a share of the largest possible one. Null texts and texts without a
    letter get ``und`` and 0, as does every text if there are no profiles. Equal distances go to the first
    name. All rows and other columns are kept; columns of these two names are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, text):
                names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if known.languages:
                    row, gram, rank = top(count_grams(part.column(text).to_pylist(), np.arange(part.num_rows), longest),
                                          known.size)
                    n = np.bincount(row, minlength=part.num_rows)
                    far = distances(known, row, gram, rank, part.num_rows)
                    best = far.argmin(axis=1)
                    some = n > 0
                    score[some] = 1 - far[some, best[some]] / (n[some] * known.size)
                    names = [known.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)],
                                                 [*part.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(released(run), schema + ", lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))
