"""Words of whole texts as arrays, straight from Arrow buffers: splitting and hashing a batch without Python strings.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit; equal byte sequences hash alike on every
worker. Texts are handled in slices of about SLICE bytes, so that memory does not depend on the batch; a longer text
is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 4 << 20
P1, P2, P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
MASK = (1 << 64) - 1
MULTIPLIER = np.uint64(0x5851F42D4C957F2D)
LONGEST = 1 << 12  # powers of the multiplier kept at hand; longer words take them in blocks

_powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(LONGEST - 1, MULTIPLIER)]), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * P2
    h = (h ^ (h >> np.uint64(27))) * P3
    return h ^ (h >> np.uint64(31))


_of_byte = mixed(np.arange(1, 257, dtype=np.uint64) * P1)


@dataclass
class Words:
    """Words of several documents. first[d]:first[d + 1] are the words of document d."""

    rows: range  # documents' places in the batch
    data: np.ndarray  # bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Each word's document, as a place in rows."""
        return np.repeat(np.arange(len(self.rows)), self.counts())


def _space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data - np.uint8(9)) < 5)


def slices(texts: pa.Array, lower: bool = False, size: int = SLICE) -> Iterator[Words]:
    """The words of every text; null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield _words(whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], range(at, to), lower)
        at = to


def _words(data: np.ndarray, offsets: np.ndarray, rows: range, lower: bool) -> Words:
    if lower:
        data = data + np.uint8(32) * ((data - np.uint8(65)) < 26)
    in_word = ~_space(data)
    begins, ends = in_word.copy(), in_word.copy()
    begins[1:] &= ~in_word[:-1]
    ends[:-1] &= ~in_word[1:]
    bounds = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end ends its last word
    begins[bounds] = in_word[bounds]
    ends[bounds - 1] = in_word[bounds - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    return Words(rows, data, start, end, first, _hashed(data, start, end))


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial over a word's bytes, mixed with its length. Sum of byte's code * multiplier^(place in the word)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    place = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    byte = _of_byte[data[np.repeat(start, length) + place]]
    if length.max() > LONGEST:
        power = _powers[place % LONGEST] * mixed((place // LONGEST).astype(np.uint64) + P1)
    else:
        power = _powers[place]
    sums = np.add.reduceat(byte * power, np.cumsum(length) - length)
    return mixed(sums + length.astype(np.uint64) * P1)


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive hashes from each place on; shorter by k - 1. Windows that span documents are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= MULTIPLIER
        out += hashes[j : j + n]
    return mixed(out + np.uint64(k * int(P1) & MASK))


def window_starts(words: Words, k: int) -> np.ndarray:
    """Places of words that begin a window of k words inside their document."""
    counts = words.counts()
    n = np.maximum(counts - k + 1, 0)
    return np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
