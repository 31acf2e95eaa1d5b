"""64-bit hashes of the words of Arrow text columns, by numpy over their bytes: no Python object a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; a longer word makes a longer piece.
PIECE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(1, 257, dtype=np.uint64)  # one more than the byte, so that every byte counts
_LOWER[65:91] += np.uint64(32)
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them over the whole range."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _hashed(data: np.ndarray, space: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hashes of the words that begin at ``begins`` and are parted by ``space`` or each other."""
    global _powers
    if not len(begins):
        return np.zeros(0, np.uint64)
    ends = np.append(begins[1:], len(data))
    if (longest := int((ends - begins).max())) > len(_powers):
        _powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * longest, _STEP)))
    within = np.arange(begins[0], len(data)) - np.repeat(begins, ends - begins)
    value = _LOWER[data[begins[0] :]] * _powers[within]
    value[space[begins[0] :]] = 0
    return mixed(np.add.reduceat(value, begins - begins[0]))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); words are runs of bytes that are no white space, A-Z as a-z."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    edges = offsets[offsets < len(data)]
    begin[edges] = ~space[edges]
    begins = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(begins, offsets))
    out, at = [], 0
    while at < len(begins):  # pieces end where a word begins
        low = begins[at]
        to = max(at + 1, int(np.searchsorted(begins, low + PIECE)))
        high = begins[to] if to < len(begins) else len(data)
        out.append(_hashed(data[low:high], space[low:high], begins[at:to] - low))
        at = to
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts
