"""Packed tables of short character n-grams: 64-bit hashes in order, with a number each."""

from __future__ import annotations

import numpy as np

#: Characters of the longest n-gram.
LONGEST = 6
_ODD = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def points(text: str) -> np.ndarray:
    """The code points of a string."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(_ODD[0])
    x = (x ^ x >> np.uint64(27)) * np.uint64(_ODD[1])
    return x ^ x >> np.uint64(31)


def rolled(chars: np.ndarray) -> list[np.ndarray]:
    """For lengths 0 to LONGEST, the hash of the n-gram that begins at each character (zeros beyond the end add nothing)."""
    n = len(chars)
    padded = np.concatenate([chars, np.zeros(LONGEST, np.uint32)]).astype(np.uint64)
    out = [np.zeros(n, np.uint64)]
    for i in range(LONGEST):
        out.append(out[-1] + _mixed(padded[i : i + n] + np.uint64(((i + 1) << 32) + 0x9E3779B97F4A7C15)))
    return out


def hashes(grams) -> np.ndarray:
    """The hash of each of some n-grams (strings of 1 to LONGEST characters)."""
    grams = list(grams)
    length = np.fromiter(map(len, grams), np.int64, len(grams))
    every = rolled(points("".join(grams)))
    at = np.cumsum(length) - length
    found = np.zeros(len(grams), np.uint64)
    for n in range(1, LONGEST + 1):
        found[length == n] = every[n][at[length == n]]
    return found


class Grams:
    """Numbers by n-gram: what a dict holds, in 16 bytes an entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.asarray(values, np.float64)[order]
        if len(keys) and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two n-grams share a hash")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of hashes (0 for those that are not held), and which are held."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        held = self.keys[at] == keys
        return np.where(held, self.values[at], 0.0), held

    def __len__(self) -> int:
        return len(self.keys)

    def __getitem__(self, gram: str) -> float:
        value, held = self.find(hashes([gram]))
        if not held[0]:
            raise KeyError(gram)
        return float(value[0])
