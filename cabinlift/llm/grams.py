"""Words of whole Arrow text columns as 64-bit hashes, with numpy.

A word's hash depends on its bytes only, so equal words agree in every task.
64-bit hashes of n different items meet by chance about n * n / 2**65 times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; a word or run of separators may extend a piece.
PIECE = 1 << 20
#: Bytes of text per slice of a batch, so that arrays per word stay small.
SLICE = 4 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _table(is_word: np.ndarray) -> np.ndarray:
    """A random odd number per byte, 0 for separators; A-Z as a-z."""
    values = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    return np.where(is_word, values, np.uint64(0))


_BYTES = np.arange(256)
#: Words of `[^\x20\x09-\x0D]+`, A-Z lower-cased.
SPACED = _table((_BYTES != 32) & ((_BYTES < 9) | (_BYTES > 13)))
#: Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, A-Z lower-cased.
ALNUM = _table((_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)))

_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, 0xD6E8FEB86659FD93, np.uint64))))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end and the n + 1 bounds; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(int(a), int(b - a))


class Words:
    """Words of some texts: hash, first byte and length in bytes; ``bounds`` says which belong to which text."""

    def __init__(self, column: pa.Array, table: np.ndarray) -> None:
        self.data, self.text_bounds = text_bytes(column)
        parts = list(self._pieces(table))
        self.hash = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
        self.start = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        self.size = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        self.bounds = np.searchsorted(self.start, self.text_bounds)

    def _pieces(self, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n, at = len(self.data), 0
        while at < n:
            end = min(n, at + PIECE)
            while end < n:  # a piece ends before a separator
                stops = np.flatnonzero(table[self.data[end:end + PIECE]] == 0)
                if len(stops):
                    end += int(stops[0])
                    break
                end = min(n, end + PIECE)
            value = table[self.data[at:end]]
            word = value != 0
            first = word.copy()
            first[1:] &= ~word[:-1]
            own = self.text_bounds[np.searchsorted(self.text_bounds, at):np.searchsorted(self.text_bounds, end)] - at
            first[own] = word[own]
            starts = np.flatnonzero(first)
            if len(starts):
                offset = np.arange(len(value)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
                sums = np.add.reduceat(value * powers(len(value))[np.maximum(offset, 0)], starts)
                sizes = np.add.reduceat(word.astype(np.int64), starts)
                yield mixed(sums + sizes.astype(np.uint64) * _ODD), starts + at, sizes
            at = end

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave their text mean nothing."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.full(n, k, np.uint64)
        for i in range(k):
            total += self.hash[i:i + n] * powers(64)[i + 1]
        return mixed(total)

    def text(self, first: int, last: int) -> bytes:
        """The bytes from word ``first`` up to and including word ``last``."""
        return self.data[self.start[first]:self.start[last] + self.size[last]].tobytes()
