"""Token ids of whole texts with a public tokenizer file, one table look-up per piece.

The tokenizers used here cut a text before they merge: never across the beginning of a run of
white space, and never between an ASCII letter and a full stop, comma or the like after it. A text is
therefore the sequence of its pieces between such places, and its ids are those of the pieces in
order. Each Python worker keeps the ids of pieces it has met in flat arrays, found by a
64-bit hash and bounded in number; only new pieces go through the tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from weakloom.llm.words import BLANK, hash_words, text_bytes

#: Pieces a worker keeps; about 40 bytes each.
REMEMBERED = 2_000_000

_bytes = np.arange(256)
_LETTER = ((_bytes | 0x20) >= 0x61) & ((_bytes | 0x20) <= 0x7A) & (_bytes < 0x80)
_STOP = np.isin(_bytes, np.frombuffer(b".,;:!?", np.uint8))
_encoders: dict[tuple[str, bool], Encoder] = {}


def vocabulary_path(name: str) -> str:
    """Place of a public tokenizer file by its name."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _wide_blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character outside ASCII may end just before these places.

    Also true for some characters that are none: they then stay with what follows, which is always right.
    """
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return (at >= 2) & (one >= 0x80) & (
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | (three == 0xE1) | ((three == 0xE3) & (two == 0x80))
        | (three == 0xEF))


def pieces(data: np.ndarray, borders: np.ndarray, keep_blanks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all texts, and the text each is in."""
    inside = ~BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[borders] = True
    cut[1:-1] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    if keep_blanks:
        run = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
        cut[run[~_wide_blank_before(data, run)]] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
    else:
        cut[1:-1] |= inside[1:] != inside[:-1]
        at = np.flatnonzero(cut)
        some = inside[at[:-1]] if len(at) > 1 else np.zeros(0, bool)
        starts, ends = at[:-1][some], at[1:][some]
    return starts, ends, np.searchsorted(borders, starts, side="right") - 1


class Encoder:
    """``keep_blanks``: white space belongs to the word after it; else it has no ids."""

    def __init__(self, path: str, keep_blanks: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.keep_blanks = keep_blanks
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pieces
        self.slots = np.zeros(0, np.int64)  # their places below
        self.begin = np.zeros(1, np.int64)  # first id of each known piece, and the number of ids
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.keys) + len(hashes) > max(REMEMBERED, len(hashes)):
            self._forget()
        texts = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        slots = len(self.begin) - 1 + np.arange(len(found))
        upto = self.begin[-1] + np.cumsum([len(x) for x in found])
        self.begin = np.concatenate([self.begin, upto])
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in found for i in x), np.uint32)])
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.slots = np.insert(self.keys, at, hashes), np.insert(self.slots, at, slots)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.slots[at], self.keys[at] == hashes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the borders of the texts among them; a null text is empty."""
        data, borders = text_bytes(texts)
        starts, ends, row = pieces(data, borders, self.keep_blanks)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        inside = np.ones(len(data), bool) if self.keep_blanks else ~BLANK[data]
        hashes = hash_words(data, inside, starts, ends)
        kinds, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
        slots, known = self._find(kinds)
        if not known.all():
            new = one[~known]
            if len(self.keys) + len(new) > REMEMBERED:
                self._forget()
                new = one
            self._learn(data, starts[new], ends[new], hashes[new])
            slots, known = self._find(kinds)
        begin, count = self.begin[slots], self.begin[slots + 1] - self.begin[slots]
        counts = count[kind]
        upto = np.cumsum(counts)
        where = np.arange(upto[-1]) + np.repeat(begin[kind] - (upto - counts), counts)
        firsts = np.searchsorted(row, np.arange(len(texts) + 1))
        return self.ids[where], np.concatenate([[0], upto])[firsts]


def encoder(path: str, keep_blanks: bool) -> Encoder:
    """The worker's encoder for a file, loaded once."""
    key = (path, keep_blanks)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keep_blanks)
    return _encoders[key]
