"""Periodic runs of words, by block matching (operator 13).

A run is a stretch of consecutive words in which words ``q`` apart are identical, ``q`` being its smallest period, that holds
at least two periods and ``least`` words and that no neighbouring word extends.

Method. Blocks of B = 2, 4, 8, ... words at places divisible by B are searched in the whole document by an Aho-Corasick
automaton of integer sequences. A run of period q and length L >= max(least, 2q) has L - q >= 2B - 1 places whose copy q words
on lies in the run too, if q is of the scale of B (:func:`distances`); so one whole aligned block and its copy lie in the run.
Every occurrence of a block at a distance of its scale seeds an exact extension to both sides.

The key of a block is the pair of the numbers that its halves have from the scale before, and the automaton reads those numbers
in strides of half a block: keys stay two integers long, so that neither memory nor the automaton's suffix links grow with
the blocks, not even in a text of one word. Blocks are searched only if both halves occur twice, as they must in order to occur
twice themselves; ordinary prose so ends after a few scales. A seed inside a stretch already extended for the same distance, or
inside a run whose period divides the distance, would find the same stretch and is skipped.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, whole_text

#: Words of the shortest run.
LEAST = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distances(block: int) -> tuple[int, int]:
    """The least and greatest period that blocks of ``block`` words (2, 4, 8, ...) find: together they are all periods."""
    return (1 if block == 2 else 2 * block - 1), 4 * block - 2


def _equal_until(words: np.ndarray, at: int, apart: int, step: int) -> int:
    """The first place from ``at`` on, going by ``step``, whose word differs from the one ``apart`` words on (or the end)."""
    n, size = len(words) - apart, 16
    while 0 <= at < n:
        end = min(n, at + size) if step > 0 else max(-1, at - size)
        low, high = (at, end) if step > 0 else (end + 1, at + 1)
        differ = np.flatnonzero(words[low:high] != words[low + apart : high + apart])
        if len(differ):
            return low + int(differ[0 if step > 0 else -1])
        at, size = end, size * 4
    return at


def _occurrences(names: np.ndarray, half: int, places: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the blocks at ``places``, wherever they occur (-1 elsewhere), and how many numbers there are.

    ``names`` has the number of the half block at every place of the document, -1 where it is none that matters.
    """
    n = len(names)
    top = int(names.max()) + 1
    keys = np.unique(names[places] * top + names[places + half])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for number, key in enumerate(keys.tolist()):
        automaton.add_word(divmod(key, top), number)
    automaton.make_automaton()
    rows = -(-n // half)
    strides = np.full((rows + 1) * half, top, np.int64)  # one line of ``top``, which no key holds, parts the strides
    strides[:n] = np.where(names < 0, top, names)
    ends = np.array([*automaton.iter(tuple(strides.reshape(rows + 1, half).T.ravel().tolist()))], np.int64).reshape(-1, 2)
    line, row = np.divmod(ends[:, 0], rows + 1)
    found = np.full(n, -1, np.int64)
    found[(row - 1) * half + line] = ends[:, 1]
    return found, len(keys)


def _seeds(names: np.ndarray, places: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a block, distance) of every other occurrence ``least`` to ``most`` words on, by place, then distance."""
    n = len(names)
    at = np.flatnonzero(names >= 0)
    codes = np.sort(names[at] * (n + 1) + at)
    own = names[places] * (n + 1)
    low = np.searchsorted(codes, own + np.minimum(places + least, n))
    high = np.searchsorted(codes, own + np.minimum(places + most, n), side="right")
    count = np.maximum(high - low, 0)
    first = np.repeat(places, count)
    other = codes[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())] % (n + 1)
    return first, other - first


def runs(words, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of integers (0 to 2^31 - 1), by start, then period.

    ``least`` is at least 9: shorter runs need not hold a block of two words and its copy.
    """
    if least < 9:
        raise ValueError("the shortest run has 9 words or more")
    n = len(words)
    if n < least:
        return []
    names = words = np.asarray(words, np.int64)
    pairs = words[:-1] << 32 | words[1:]
    _, which, times = np.unique(pairs, return_inverse=True, return_counts=True)
    places = 2 * np.flatnonzero(times[which][::2] > 1)
    found: dict[tuple[int, int], int] = {}
    cover = np.zeros((3, n), np.int64)  # start, end and period of the longest run over a place
    block = 2
    while len(places) and 2 * distances(block)[0] <= n:
        names, count = _occurrences(names, block // 2, places)
        first, apart = _seeds(names, places, *distances(block))
        start, end, period = cover[:, first]
        fresh = (period == 0) | (apart % np.maximum(period, 1) != 0) | (start > first) | (first + apart + block > end)
        reached: dict[int, int] = {}  # by distance: where the words of the last stretch cease to equal their copies
        for i, d in zip(first[fresh].tolist(), apart[fresh].tolist()):
            if i + block <= reached.get(d, 0):
                continue
            start, end, period = cover[:, i].tolist()
            if period and d % period == 0 and start <= i and i + d + block <= end:
                continue
            left = _equal_until(words, i - 1, d, -1) + 1
            right = _equal_until(words, i + block, d, 1)
            reached[d] = right
            stop = right + d
            if stop - left < max(least, 2 * d):
                continue
            found[left, stop] = min(d, found.get((left, stop), d))
            shorter = left + np.flatnonzero(cover[1, left:stop] - cover[0, left:stop] < stop - left)
            cover[:, shorter] = [[left], [stop], [d]]
        many = np.bincount(names[names >= 0], minlength=count) > 1
        good = np.append((names >= 0) & many[names], np.zeros(block, bool))
        places = np.arange(0, n - 2 * block + 1, 2 * block)
        places = places[good[places] & good[places + block]]
        block *= 2
    return sorted((start, stop - start, period) for (start, stop), period in found.items())


def kept(n: int, found) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period alone."""
    open_ = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        open_[start + period] += 1
        open_[start + length] -= 1
    return np.cumsum(open_[:n]) == 0


def numbered(words: list[str]) -> list[int]:
    """A number for each word, equal for equal words."""
    numbers: dict[str, int] = {}
    return [numbers.setdefault(w, len(numbers)) for w in words]


def planted(words: list[str], name: str) -> list[str]:
    """The words of a document, of which every tenth gets a periodic tail; the crc32 of its id's text decides."""
    h = zlib.crc32(name.encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def collapse(df: DataFrame, text: str = "text", into: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with the column ``into``: the words of ``text``, one space apart, without what repeats the first period of a run."""

    def run(batches):
        for batch in sliced(batches):
            out = []
            for value in batch.column(0).to_pylist():
                words = WORD.findall(value)
                found = runs(numbered(words), least)
                out.append(" ".join(w for w, k in zip(words, kept(len(words), found)) if k) if found else " ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string())], names=[*batch.schema.names[1:], "new"])

    # positions in place of names: columns of any name pass through
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    work = df.columns.index(text)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema)) + ", new string"
    made = plain.select(whole_text(f"c{work}").alias("work"), *plain.columns).mapInArrow(run, schema)
    if into in df.columns:
        at = df.columns.index(into)
        return made.select(*(F.col("new" if i == at else f"c{i}").alias(c) for i, c in enumerate(df.columns)))
    return made.toDF(*df.columns, into)


def find(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``key`` and ``runs``, an array of (start, length, period), of every row; numbers count words from 0.

    Null texts are empty and have no runs; equal rows give equal rows; an empty table gives none.
    """

    def run(batches):
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in sliced(batches):
            out = [[dict(zip(("start", "length", "period"), r)) for r in runs(numbered(WORD.findall(t)), least)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=[key, "runs"])

    made = df.select(F.col(key), whole_text(text).alias("work"))
    return made.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>")


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(words: list[str]) -> tuple:
    found = runs(numbered(words))
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in found)
    left = [w for w, k in zip(words, kept(len(words), found)) if k] if found else words
    facts = (*best, 1000 * best[1] // best[2]) if best else (None, None, None, None)
    return (len(found), *facts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(left).encode("utf-8", "surrogatepass")).hexdigest())


def digest_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The contract's digest of the runs of every document, every tenth of which has a periodic tail (:func:`planted`).

    A null id is an empty text for the choice of tails; null texts are empty: no runs, digests of nothing. Rows with equal ids
    are rows of their own. A very long text is one row, so one task; its memory grows with its words, not with its runs' square.
    Columns beside key and text are not read. An empty table gives no rows.
    """

    def run(batches):
        types = [pa.int64()] * 5 + [pa.string()] * 2
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for batch in sliced(batches):
            out = [_digest(planted(WORD.findall(t), name)) for name, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate(types))], names=["doc_id", *names])

    made = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), whole_text(text).alias("text"))
    return made.mapInArrow(run, f"doc_id {df.schema[key].dataType.simpleString()}, {DIGEST}")
