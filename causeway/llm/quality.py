"""Quality by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector shared by all grades, with ordered thresholds. x holds
the mean hashed indicators of a text's white-space-separated words, of their shapes, and of words that repeat the one before. The expected grade and the
probability of at least a given grade follow.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import BoundedCache, sliced, whole_text

#: The fit reads at most so many labelled rows, those with the least hash of their id. Scoring has no bound.
MAX_ROWS = 4000
BITS = 18
_RUNS = (re.compile("[a-zß-öø-ÿ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile("[0-9]+"), re.compile(r"([^aA0])\1+"))


def shape(word: str) -> str:
    """Runs of small letters, capitals and digits as a, A, 0; runs of another character as one."""
    small, capital, digit, other = _RUNS
    return other.sub(r"\1", digit.sub("0", capital.sub("A", small.sub("a", word))))


def repeats(words: list[str]) -> int:
    """How many words repeat the one before."""
    return sum(map(operator.eq, words, words[1:]))


def _again(bits: int) -> int:
    return xxhash.xxh3_64_intdigest("again") & ((1 << bits) - 1)


def _slots(bits: int):
    mask = (1 << bits) - 1
    return BoundedCache(lambda w: (xxhash.xxh3_64_intdigest("w" + w.lower()) & mask, xxhash.xxh3_64_intdigest("s" + shape(w)) & mask))


@dataclass
class Model:
    """Weights of 2**bits slots and ordered thresholds between the grades 0..len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def probabilities(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1..K, one row for each linear score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - linear[:, None], -40, 40)))


def fit_rows(slots: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, n_grades: int, bits: int = BITS, l2: float = 1e-4, steps: int = 150, rate: float = 0.5) -> Model:
    """Maximum likelihood by full-batch Adam on sparse rows (slots, mean counts) and grades 0..n_grades-1."""
    size, k = 1 << bits, max(1, n_grades - 1)
    if not len(grades):
        return Model(np.zeros(size), np.arange(k, dtype=float), bits)
    row = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    used, flat = np.unique(np.concatenate(slots), return_inverse=True)
    value = np.concatenate(counts)
    n, w = len(grades), np.zeros(len(used))
    share = np.clip([(grades >= j + 1).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)))
    cut = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # first threshold, then logs of gaps
    m, v, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(cut), np.zeros_like(cut)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        theta = np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        s = np.bincount(row, w[flat] * value, len(slots))
        high, low = edges[grades + 1], edges[grades]
        a, b = np.where(np.isinf(high), 1.0, sigmoid(high - s)), np.where(np.isinf(low), 0.0, sigmoid(low - s))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a) / p, b * (1 - b) / p
        gs = (da - db) / n  # derivative of the negative log-likelihood by s
        gw = np.bincount(flat, gs[row] * value, len(used)) + l2 * w
        gt = np.array([(-(da * (grades == j)).sum() + (db * (grades == j + 1)).sum()) / n for j in range(k)])
        gc = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(cut[j]) for j in range(1, k)]])
        for x, g, mm, vv, step in ((w, gw, m, v, rate), (cut, gc, mc, vc, rate / 5)):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g * g - vv)
            x -= step * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])])), bits)


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = MAX_ROWS, bits: int = BITS) -> Model:
    """Fit on at most ``max_rows`` rated documents, those with the least hash of their id.

    Null grades and ids are unrated; grades are whole numbers from 0. Of ratings that repeat an id the highest counts, of
    documents that repeat one the least text, so each id is one row. Null and empty texts are rows without words.
    """
    rated = ratings.where(F.col(grade).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(grade).cast("int")).alias("_grade"))
    sample = rated.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)

    def features(batches):
        slots = _slots(bits)
        for batch in sliced(batches, 500):
            grades, rows, values = batch.column(1).to_pylist(), [], []
            for body in batch.column(0).to_pylist():
                words = body.split()
                found = np.array([*(s for w in words for s in slots[w]), *[_again(bits)] * repeats(words)], np.int64)
                at, n = np.unique(found, return_counts=True)
                rows.append(at.astype(np.int32))
                values.append((n / max(1, len(words))).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(grades, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([v.tobytes() for v in values], pa.binary())], names=["grade", "slots", "counts"])

    joined = docs.select(F.col(key).alias("_id"), whole_text(text).alias("_text")).join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.max("_grade").alias("_grade")).select("_text", "_grade")
    found = joined.mapInArrow(features, "grade int, slots binary, counts binary").collect()  # at most max_rows
    found.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))
    grades = np.array([r[0] for r in found], np.int64)
    return fit_rows([np.frombuffer(r[1], np.int32) for r in found], [np.frombuffer(r[2], np.float32) for r in found], grades, int(grades.max()) + 1 if len(grades) else 2, bits)


def _tails(df: DataFrame, model: Model, at: int):
    """A function from record batches, with texts in column ``at``, to batches and P(grade >= k) of their rows."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.bits))

    def run(batches):
        weights, thresholds, bits = shared.value
        mask, table = (1 << bits) - 1, weights.tolist()
        value = BoundedCache(lambda w: table[xxhash.xxh3_64_intdigest("w" + w.lower()) & mask] + table[xxhash.xxh3_64_intdigest("s" + shape(w)) & mask])
        local, again = Model(weights, thresholds, bits), table[_again(bits)]
        for batch in sliced(batches):
            linear = np.zeros(batch.num_rows)
            for i, body in enumerate(batch.column(at).to_pylist()):
                words = (body or "").split()
                linear[i] = (sum(map(value.__getitem__, words)) + again * repeats(words)) / len(words) if words else 0.0
            yield batch, local.probabilities(linear)

    return run


NEW = ("expected_grade", "tail_probability", "keep")


def score(df: DataFrame, model: Model, at_least: int = 1, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``df`` with expected_grade, tail_probability (grade >= at_least) and keep (1 if that is >= threshold).

    Null and empty texts get the thresholds' own probabilities. Texts of any length are read whole; rows with equal texts
    get equal values. Columns of these names in ``df`` are replaced, all others stay. An empty table gives no rows.
    """
    kept = [f for f in df.schema.fields if f.name not in NEW]
    schema = StructType([*kept]).add("expected_grade", DoubleType()).add("tail_probability", DoubleType()).add("keep", IntegerType())
    names, at = [f.name for f in kept], next(i for i, f in enumerate(kept) if f.name == text)
    tails = _tails(df, model, at)

    def run(batches):
        for batch, p in tails(batches):
            tail = p[:, min(at_least, p.shape[1]) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(tail), pa.array((tail >= threshold).astype(np.int32))], names=[*names, *NEW])

    return df.select(*names).mapInArrow(run, schema)


def select(df: DataFrame, model: Model, at_least: int = 1, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, whose probability of a grade from ``at_least`` reaches ``threshold``."""
    tails = _tails(df, model, df.columns.index(text))

    def run(batches):
        for batch, p in tails(batches):
            yield batch.filter(pa.array(p[:, min(at_least, p.shape[1]) - 1] >= threshold))

    return df.mapInArrow(run, df.schema)
