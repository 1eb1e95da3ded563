"""64-bit hashes of words and of runs of words, computed on the bytes of Arrow batches.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. A-Z count as a-z. Texts are hashed as they lie in the batch, a bounded
number of bytes at a time, with no Python object per word. Two different words or runs
share a hash with probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    base = np.full(n, _BASE, np.uint64)
    base[0] = 1
    return np.multiply.accumulate(base)


def _hash_block(data: np.ndarray, firsts: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start positions of the words in `data`; a word also ends before `firsts`.

    A row of hashes of whole words, then one of their first n bytes for each n of `stems`.
    """
    inside = ~_SEPARATOR[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = firsts[firsts < len(data)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty((1 + len(stems), 0), np.uint64), starts
    ends = np.append(starts[1:], len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, ends - starts)
    values = _BYTE[data[starts[0] :]] * _powers(int(place.max()) + 1)[place]
    values[~inside[starts[0] :]] = 0
    rows = [mix(np.add.reduceat(values, starts - starts[0]))]
    for n in sorted(stems, reverse=True):
        values[place >= n] = 0
        rows.insert(1, mix(np.add.reduceat(values, starts - starts[0]) + np.uint64(n)))
    return np.stack(rows), starts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def word_hashes(column: pa.Array, stems: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, offsets of the rows in them) for runs of rows of about BLOCK_BYTES.

    A longer text is hashed block by block, cut between words. With `stems`, the hashes
    are a matrix: whole words first, then their first n bytes for each n in rising order.
    """
    data, offsets = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[to])
        if end - begin <= BLOCK_BYTES:
            firsts = offsets[row : to + 1] - begin
            hashes, starts = _hash_block(data[begin:end], firsts[:-1], stems)
            yield row, hashes if stems else hashes[0], np.searchsorted(starts, firsts)
        else:
            parts = []
            while begin < end:
                stop = min(end, begin + BLOCK_BYTES)
                while stop < end and not _SEPARATOR[data[stop]]:
                    gap = np.flatnonzero(_SEPARATOR[data[stop : min(end, stop + BLOCK_BYTES)]])
                    stop = min(end, stop + (int(gap[0]) if len(gap) else BLOCK_BYTES))
                parts.append(_hash_block(data[begin:stop], np.zeros(1, np.int64), stems)[0])
                begin = stop
            hashes = np.concatenate(parts, axis=1)
            yield row, hashes if stems else hashes[0], np.array([0, hashes.shape[1]])
        row = to


def combine(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash of several aligned arrays, in which order counts."""
    total = np.full(len(parts[0]), np.uint64(seed * 2 + 1), np.uint64)
    for part in parts:
        total = mix(total * np.uint64(_BASE) + part)
    return total


def shingle_sets(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word runs.

    A row with fewer words has one run, all its words; one without words has none.
    """
    n = len(hashes)
    runs = combine([hashes[k : n - width + 1 + k] for k in range(width)]) if n >= width else np.empty(0, np.uint64)
    for begin, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - begin >= width:
            yield np.unique(runs[begin : end - width + 1])
        elif end > begin:
            yield combine([hashes[k : k + 1] for k in range(begin, end)], seed=int(end - begin))
        else:
            yield np.empty(0, np.uint64)
