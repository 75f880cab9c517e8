"""Words, word hashes and word windows of Arrow string columns, by numpy over the UTF-8 bytes.

No Python string is made per word. Every separator class used here is ASCII, so it can be
read off single bytes: the bytes of a longer UTF-8 character are all 0x80 or higher and belong to words.

Words are compared by 64-bit hashes (random values per byte, odd powers per position, mixed).
Windows of words are hashed from the word hashes in the same way.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the working memory, a longer text forms a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = 1 << 12


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_LONG, _STEP)

_bytes = np.arange(256)
#: Bytes that end a word: white space only, or all ASCII but digits and letters.
BLANK = (_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D))
NOT_ALNUM = (_bytes < 0x80) & ~(
    ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x41) & (_bytes <= 0x5A)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)))
FOLD = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words(NamedTuple):
    """Words of a slice of texts, in order."""

    data: np.ndarray  # bytes of all texts, folded if asked for
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    row: np.ndarray  # text each word is in
    first: np.ndarray  # index of the first word of each text, and the number of words at the end
    hashes: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their borders; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[borders[0]:borders[-1]], borders - borders[0]


def words_of(texts: pa.Array, separators: np.ndarray, fold: bool = False) -> Words:
    """Words of the texts. ``separators`` is a table over bytes; ``fold`` lower-cases A-Z."""
    data, borders = text_bytes(texts)
    if fold:
        data = FOLD[data]
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = borders[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, borders)
    row = np.repeat(np.arange(len(borders) - 1), np.diff(first))
    return Words(data, starts, ends, row, first, hash_words(data, inside, starts, ends))


def hash_words(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.flatnonzero(inside)
    lengths = ends - starts
    place -= np.repeat(starts, lengths)
    longest = int(lengths.max())
    powers = _POWERS if longest <= _LONG else _powers(longest, _STEP)
    values = _VALUES[data[inside]] * powers[place]
    heads = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=heads[1:])
    return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))


def hash_of(word: str) -> int:
    """Hash of one word, equal to the one ``words_of`` gives it."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(hash_words(data, np.ones(len(data), bool), np.array([0]), np.array([len(data)]))[0])


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each word on; too few words leave nothing.

    Windows run over borders between texts: drop those with ``whole``.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = mix(_powers(width + 1, _STEP)[1:] + np.uint64(seed)) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += hashes[i:i + n] * factors[i]
    return mix(out)


def whole(words: Words, width: int) -> np.ndarray:
    """Which windows of this width lie in one text."""
    n = len(words.row) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    return words.row[:n] == words.row[width - 1:]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with the memory it has freed given back to the system at its end. Workers go on to other tasks, and what the allocators keep
    from many different ones adds up."""
    def until_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return until_end


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's BIGINT."""
    return h.view(np.int64)
