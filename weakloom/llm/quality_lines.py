"""Quality rules: counts per document, and lines labelled content or boilerplate by a linear-chain CRF.

The field has two labels. A line's features are the buckets its measures fall into (share of symbols, of capitals,
of sentence ends and so on); each bucket has a weight, and each pair of neighbouring labels has one.
It is trained on a bounded sample of labelled documents: a logistic model over single lines first separates the bad
lines of bad documents from their good ones, then the whole field is fitted to these line labels by maximum
likelihood. Decoding is Viterbi over the lines of a document, side by side for all documents of a slice.

A document is dropped by the base rules, or if too small a share of its word characters is in content lines.
Everything after training is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weakloom.llm.words import BLANK, SLICE_BYTES, Words, hash_words, mix, slices, text_bytes, windows, whole, words_of

#: Labelled documents of each quality that the field is trained on, taken in the order of a hash of their ids.
SAMPLE_PER_CLASS = 1500
MIN_WORDS = 20
MIN_CONTENT = 0.5
REPEAT_WINDOW = 8

_bytes = np.arange(256)
_SYMBOL = np.isin(_bytes, np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (_bytes >= 0x41) & (_bytes <= 0x5A)
_LOWER = (_bytes >= 0x61) & (_bytes <= 0x7A)
_DIGIT = (_bytes >= 0x30) & (_bytes <= 0x39)
_MARK = np.isin(_bytes, np.frombuffer(b"!?", np.uint8))
_STOP = np.isin(_bytes, np.frombuffer(b".!?:", np.uint8))
_CHAR = (_bytes & 0xC0) != 0x80  # first byte of a character

#: Upper edges of the buckets of each measure.
EDGES = (
    np.array([10, 20, 40, 80, 160, 320, 640]),  # characters in words
    np.array([1, 2, 4, 8, 16, 32, 64]),  # words
    np.array([2, 3, 4, 5, 6, 8, 12]),  # characters in a word, on average
    np.array([0, .002, .01, .03, .1, .2, .4]),  # share of symbols
    np.array([0, .02, .1, .3, .5, .8]),  # share of capitals among ASCII letters
    np.array([0, .01, .05, .15, .3]),  # share of digits
    np.array([0, .02, .1, .3, .6]),  # exclamation and question marks per word
    np.array([.1, .3, .5, .7, .85, .99]),  # share of different words
    np.array([.2, .5, .7, .85, .95]),  # share of letters
    np.array([0]),  # ends like a sentence
    np.array([0]),  # stands in the document before
)
_WIDTHS = np.array([len(e) + 1 for e in EDGES])
_OFFSETS = np.concatenate([[0], np.cumsum(_WIDTHS)[:-1]])
N_FEATURES = int(_WIDTHS.sum())


class Lines(NamedTuple):
    """Lines with a word, and the counts of the texts they are in."""

    row: np.ndarray
    chars: np.ndarray  # characters in words
    features: np.ndarray  # one feature number per measure
    words: Words
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _upto(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its kind."""
    out = np.zeros(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = True
    return out


def lines_of(texts: pa.Array) -> Lines:
    data, borders = text_bytes(texts)
    words = words_of(texts, BLANK)
    n_rows = len(texts)
    inside = ~BLANK[data]
    newline = data == 0x0A
    cuts = np.unique(np.concatenate([borders, np.flatnonzero(newline) + 1]))
    starts, ends = cuts[:-1], cuts[1:].copy()
    ends[newline[ends - 1]] -= 1
    some = ends > starts
    starts, ends = starts[some], ends[some]
    hashes = hash_words(data, ~newline, starts, ends)
    row = np.searchsorted(borders, starts, side="right") - 1
    word_from, word_to = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    has_word = word_to > word_from
    starts, ends, hashes, row = starts[has_word], ends[has_word], hashes[has_word], row[has_word]
    word_from, word_to = word_from[has_word], word_to[has_word]

    def total(flags: np.ndarray) -> np.ndarray:
        upto = _upto(flags)
        return upto[ends] - upto[starts]

    word_char = inside & _CHAR[data]
    symbol = _SYMBOL[data]
    chars, n = total(word_char), word_to - word_from
    upper, lower, digit = total(_UPPER[data]), total(_LOWER[data]), total(_DIGIT[data])
    letters = upper + lower + total((data >= 0x80) & _CHAR[data])
    dup = ~_first_seen(mix(hashes ^ mix(row.astype(np.uint64))))
    line_of_word = np.repeat(np.arange(len(starts)), n)
    new_word = _first_seen(mix(words.hashes ^ mix(line_of_word.astype(np.uint64)))) if len(n) else np.zeros(0, bool)
    kinds = _upto(new_word)
    last = words.ends[word_to - 1] - 1 if len(n) else np.zeros(0, np.int64)
    measures = (
        chars, n, chars / np.maximum(n, 1), total(symbol) / np.maximum(chars, 1), upper / np.maximum(upper + lower, 1),
        digit / np.maximum(chars, 1), total(_MARK[data]) / np.maximum(n, 1), (kinds[word_to] - kinds[word_from]) / np.maximum(n, 1),
        letters / np.maximum(chars, 1), _STOP[data[last]], dup)
    features = np.stack([np.searchsorted(e, m, side="left") + o for e, m, o in zip(EDGES, measures, _OFFSETS)], axis=1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        upto = _upto(flags)
        return upto[borders[1:]] - upto[borders[:-1]]

    return Lines(row, chars, features, words, per_row(word_char), per_row(symbol),
                 np.bincount(row[dup], minlength=n_rows), repeated_words(words, n_rows))


def repeated_words(words: Words, n_rows: int, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text in windows that the text has twice or more."""
    ok = whole(words, width)
    at = np.flatnonzero(ok)
    if not len(at):
        return np.zeros(n_rows, np.int64)
    keys = mix(windows(words.hashes, width)[at] ^ mix(words.row[at].astype(np.uint64)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(n_rows, np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = at[twice[place] == keys]
    cover = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + width, -1)
    upto = _upto(np.cumsum(cover[:-1]) > 0)
    return upto[words.first[1:]] - upto[words.first[:-1]]


class Field(NamedTuple):
    """Weights in favour of content (label 1) over boilerplate (label 0), and between neighbours."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray  # 2 x 2


#: Without anything to learn from, every line is content.
ALL_CONTENT = Field(np.zeros(N_FEATURES), 1.0, np.zeros((2, 2)))


class _Chains(NamedTuple):
    """Chains of lines by decreasing length: at each step the first ``active`` chains have a line."""

    order: np.ndarray  # line numbers, step after step
    active: np.ndarray


def _chains(row: np.ndarray) -> _Chains:
    if not len(row):
        return _Chains(np.zeros(0, np.int64), np.zeros(0, np.int64))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = np.diff(np.append(first, len(row)))
    step = np.arange(len(row)) - np.repeat(first, length)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(first))
    order = np.lexsort((np.repeat(rank, length), step))
    return _Chains(order, np.bincount(step))


def _scores(field: Field, features: np.ndarray) -> np.ndarray:
    return field.weights[features].sum(axis=1) + field.bias


def viterbi(field: Field, row: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Most likely label of each line; ties are content. Lines of one row follow each other."""
    order, active = _chains(row)
    labels = np.zeros(len(row), np.int8)
    if not len(row):
        return labels
    score = _scores(field, features)[order]
    at = np.concatenate([[0], np.cumsum(active)])
    back = np.zeros((len(row), 2), np.int8)
    best = np.stack([np.zeros(active[0]), score[:active[0]]], axis=1)
    ends = [np.zeros((0, 2))] * len(active)
    for t in range(1, len(active)):
        ends[t - 1] = best[active[t]:]
        paths = best[:active[t], :, None] + field.steps
        choice = (paths[:, 1] >= paths[:, 0]).astype(np.int8)
        back[at[t]:at[t + 1]] = choice
        best = np.maximum(paths[:, 0], paths[:, 1])
        best[:, 1] += score[at[t]:at[t + 1]]
    ends[-1] = best
    now = np.zeros(0, np.int8)
    for t in range(len(active) - 1, -1, -1):
        if t + 1 < len(active):
            now = back[at[t + 1] + np.arange(len(now)), now]
        now = np.concatenate([now, (ends[t][:, 1] >= ends[t][:, 0]).astype(np.int8)])
        labels[order[at[t]:at[t + 1]]] = now
    return labels


def _logistic(features: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.5, shrink: float = 1e-3) -> tuple[np.ndarray, float]:
    weights, bias = np.zeros(N_FEATURES), 0.0
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        error = (y - 1 / (1 + np.exp(-(weights[features].sum(axis=1) + bias)))) * share
        grad = np.bincount(features.ravel(), np.repeat(error, features.shape[1]), N_FEATURES)
        weights += rate * (grad - shrink * weights)
        bias += rate * error.sum()
    return weights, bias


def train(row: np.ndarray, features: np.ndarray, good: np.ndarray, rounds: int = 120, rate: float = 2.0,
          shrink: float = 1e-3) -> Field:
    """Fit the field. ``good`` tells for each line whether its document is labelled good.

    Lines of good documents are content; lines of bad ones are boilerplate unless they look more like
    the lines of good documents.
    """
    if not len(row) or good.all() or not good.any():
        return ALL_CONTENT
    weights, bias = _logistic(features, good.astype(float))
    y = (good | (weights[features].sum(axis=1) + bias > 0)).astype(np.int64)
    if y.all():
        return ALL_CONTENT
    order, active = _chains(row)
    at = np.concatenate([[0], np.cumsum(active)])
    features, y = features[order], y[order]
    steps, n = np.zeros((2, 2)), len(row)
    follows = np.zeros((2, 2))
    for t in range(1, len(active)):
        np.add.at(follows, (y[at[t - 1]:at[t - 1] + active[t]], y[at[t]:at[t + 1]]), 1)
    seen = np.bincount(features.ravel(), np.repeat(y.astype(float), features.shape[1]), N_FEATURES)
    speed = [np.zeros(N_FEATURES), 0.0, np.zeros((2, 2))]
    for _ in range(rounds):
        score = weights[features].sum(axis=1) + bias
        emit = np.stack([np.zeros(n), score], axis=1)
        ahead, behind = emit.copy(), np.zeros((n, 2))
        for t in range(1, len(active)):
            before = ahead[at[t - 1]:at[t - 1] + active[t]]
            ahead[at[t]:at[t + 1]] += np.logaddexp(before[:, :1] + steps[0], before[:, 1:] + steps[1])
        for t in range(len(active) - 1, 0, -1):
            after = emit[at[t]:at[t + 1]] + behind[at[t]:at[t + 1]]
            behind[at[t - 1]:at[t - 1] + active[t]] = np.logaddexp(after[:, :1] + steps[:, 0], after[:, 1:] + steps[:, 1])
        both = ahead + behind
        norm = np.logaddexp(both[:, 0], both[:, 1])
        content = np.exp(both[:, 1] - norm)
        expected = np.zeros((2, 2))
        for t in range(1, len(active)):
            left, right = ahead[at[t - 1]:at[t - 1] + active[t]], emit[at[t]:at[t + 1]] + behind[at[t]:at[t + 1]]
            expected += np.exp(left[:, :, None] + steps + right[:, None, :] - norm[at[t]:at[t + 1], None, None]).sum(axis=0)
        grads = (
            (seen - np.bincount(features.ravel(), np.repeat(content, features.shape[1]), N_FEATURES)) / n - shrink * weights,
            (y.sum() - content.sum()) / n, (follows - expected) / n - shrink * steps)
        for k, g in enumerate(grads):
            speed[k] = 0.8 * speed[k] + 0.2 * g
        weights, bias, steps = weights + rate * speed[0], bias + rate * speed[1], steps + rate * speed[2]
    return Field(weights, bias, steps)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Field:
    """Train on at most ``per_class`` documents of each quality. ``labels`` has ``doc_id`` and ``quality`` (0 or 1).

    Rows without an id, text or quality are not learned from; with one quality only, every line is content.
    """
    order = F.xxhash64("doc_id")
    known = labels.select("doc_id", "quality").where("doc_id is not null")
    sample = known.where("quality = 0").orderBy(order, "doc_id").limit(per_class).unionByName(
        known.where("quality = 1").orderBy(order, "doc_id").limit(per_class)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = lines_of(part.column("text"))
                rows = pa.array(lines.row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("quality").take(rows).cast(pa.int32()), pa.array(np.arange(len(rows))),
                     pa.FixedSizeListArray.from_arrays(pa.array(lines.features.astype(np.int16).ravel()), len(EDGES)).cast(pa.list_(pa.int16()))],
                    ["doc_id", "quality", "line", "features"])

    found = chosen.mapInArrow(run, "doc_id bigint, quality int, line bigint, features array<smallint>").toArrow()
    found = found.combine_chunks().sort_by([("doc_id", "ascending"), ("line", "ascending")])
    if not len(found):
        return ALL_CONTENT
    features = found["features"].combine_chunks().flatten().to_numpy().reshape(-1, len(EDGES)).astype(np.int64)
    return train(found["doc_id"].to_numpy(), features, found["quality"].to_numpy() == 1)


def judge(docs: DataFrame, field: Field, min_words: int = MIN_WORDS, min_content: float = MIN_CONTENT) -> DataFrame:
    """Counts, line labels and verdict of each document.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, content
    (whether each line with a word is content), kept``. Words are runs of anything but ASCII white space.
    Null and empty texts have no words and fail. Every row gives a row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lines = lines_of(part.column("text"))
                n = part.num_rows
                label = viterbi(sent.value, lines.row, lines.features)
                n_words = np.diff(lines.words.first)
                good = np.bincount(lines.row, lines.chars * label, n)
                share = good / np.maximum(lines.word_chars, 1)
                failed = (n_words < min_words) | (100 * lines.n_repeat_words > 30 * n_words)
                border = np.searchsorted(lines.row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, (n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines,
                                                            lines.n_repeat_words, failed, share)),
                     pa.ListArray.from_arrays(pa.array(border), pa.array(label == 1)), pa.array(~failed & (share >= min_content))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     "content_share", "content", "kept"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
             "n_repeat_words bigint, base_failed boolean, content_share double, content array<boolean>, kept boolean")
