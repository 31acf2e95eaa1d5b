"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary documents, spell words: n-grams of four to six
characters (and shorter ones at a word's start) with class counts, lower orders with continuation counts. Below them both share one backoff, whose trigram
counts are the distinct words of the whole corpus that hold a trigram; a rare expression, or one that neither class
has seen, is scored by what the shared part and the contexts say, and alike in both where they say nothing. The
log-likelihoods of a document's words are compared after division by the length, over the whole document and over the
stretches of some lengths in which toxic leads most (a long document may be toxic in one place); a logistic calibration
on labelled documents that the models have not counted makes a probability of them.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import BoundedCache, materialize, sliced, whole_text
from .grams import Grams, hashes, points, rolled

#: The classes' counts come from at most so many labelled documents of each class, those with the least hash of their id.
MAX_DOCS = 3000
LOW, HIGH = 4, 6
CACHE = 100_000
#: Longer chunks are not kept in a cache; characters that are scored at a time; texts that are.
LONG, PIECE, TEXTS = 256, 1 << 16, 200
#: N-grams of the fit that are strings of Python at a time.
BLOCK = 1 << 15
#: Lengths in words at which a document's stretches are compared, beside its whole.
STRETCHES = (1, 4, 16, 64)
DISCOUNT, FEATURES = 0.75, 2 + len(STRETCHES)
START, END = "\x02", "\x03"
EDGES = string.punctuation + "«»„“”‚‘’…–—¡¿·"


def word_of(chunk: str) -> str:
    """A chunk without edges; the marks of start and end, which a text may hold, are blanks within a word."""
    return chunk.lower().strip(EDGES).replace(START, " ").replace(END, " ")


class Lookup(dict):
    """Ratios by chunk: twice CACHE entries at most beside the chunks that are asked for; unknown ones are scored together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.long = model, []

    def fill(self, chunks: set[str]) -> None:
        for c in self.long:
            self.pop(c, None)
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > 2 * CACHE:
            kept = {c: self[c] for c in chunks if c in self}
            self.clear()
            self.update(kept)
        words = {c: word_of(c) for c in new}
        once = list(set(words.values()))
        ratio = dict(zip(once, self.model.words(once).tolist()))
        self.update((c, ratio[w]) for c, w in words.items())
        self.long = [c for c in new if len(c) > LONG]


@dataclass
class Model:
    """Log-likelihood ratios (toxic to ordinary) of n-grams and of the step below a context, and the calibration."""

    ratio: Grams
    backoff: Grams
    weights: np.ndarray
    prior: float = 0.01

    def word(self, word: str) -> float:
        """The log-likelihood ratio of one word."""
        return float(self.words([word])[0])

    def words(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word, whatever its length; 0 for an empty one."""
        out, pieces, room = np.zeros(len(words)), [], PIECE
        for i, word in enumerate(words):
            if not word:
                continue
            s = START + word + END
            for at in range(0, len(s), PIECE):  # a piece also has what the n-grams at its start begin with
                first = max(0, at - HIGH + 1)
                pieces.append((i, first, at - first, s[first : at + PIECE]))
                room -= len(pieces[-1][3])
                if room <= 0:
                    self._add(out, pieces)
                    pieces, room = [], PIECE
        self._add(out, pieces)
        return out

    def _add(self, out: np.ndarray, pieces: list[tuple[int, int, int, str]]) -> None:
        """Add to ``out`` the ratios of pieces (word, place in the word, characters scored before, text)."""
        if not pieces:
            return
        word, first, before, texts = zip(*pieces)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        hashed = rolled(points("".join(texts)))
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        place = inner + np.repeat(first, length)
        total = np.zeros(len(place))
        open_ = np.flatnonzero((place > 0) & (inner >= np.repeat(before, length)))
        for n in range(HIGH, 1, -1):
            at_n = open_[place[open_] >= n - 1] if n >= LOW else open_[place[open_] == n - 1]
            below, known = self.backoff.find(hashed[n - 1][at_n - n + 1])
            at_n, below = at_n[known], below[known]  # no n-gram of an unknown context is held
            found, held = self.ratio.find(hashed[n][at_n - n + 1])
            total[at_n] += np.where(held, found, below)
            done = np.zeros(len(place), bool)
            done[at_n[held]] = True
            open_ = open_[~done[open_]]
        np.add.at(out, np.array(word), np.add.reduceat(total, np.cumsum(length) - length))

    def lookup(self) -> Lookup:
        return Lookup(self)

    def features(self, texts: list[str], lookup: Lookup) -> np.ndarray:
        """A row a text: the log-likelihood ratio divided by the length, of the whole document and of the stretches of each length in which it is highest; and the length."""
        rows = np.zeros((len(texts), FEATURES))
        for first in range(0, len(texts), TEXTS):
            split = [text.split() for text in texts[first : first + TEXTS]]
            lookup.fill(set().union(*split))
            for i, chunks in enumerate(split, first):
                if chunks:
                    total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(lookup.__getitem__, chunks), np.float64, len(chunks)))])
                    n = len(chunks)
                    best = [(total[w:] - total[:-w]).max() / w for w in (min(w, n) for w in STRETCHES)]
                    rows[i] = [total[-1] / n, *best, math.log1p(n)]
        return rows

    def probability(self, features: np.ndarray) -> np.ndarray:
        """Calibrated scores; a text without words has the share of toxic documents among those of the calibration."""
        p = 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -500, 500)))
        return np.round(np.where(features[:, -1] == 0, self.prior, p), 12)


def _words(batches):
    """Per batch of (text, toxic): words and the number of their documents by class."""
    for batch in sliced(batches, 500):
        docs, norm = (Counter(), Counter()), BoundedCache(word_of)
        for body, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            docs[toxic].update({norm[c] for c in body.split()})
        keys = [*(docs[0] | docs[1])]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([docs[0][k] for k in keys], pa.int64()), pa.array([docs[1][k] for k in keys], pa.int64())], names=["w", "n0", "n1"])


def _grams(batches):
    """Per batch of words: their n-grams of the highest length (and shorter ones at a word's start) with both counts."""
    for batch in sliced(batches, 20_000):
        counts = ({}, {})
        for w, *n in zip(*(c.to_pylist() for c in batch.columns)):
            s = START + w + END
            for end in range(2, len(s) + 1):
                g = s[max(0, end - HIGH) : end]
                for c in (0, 1):
                    if n[c]:
                        counts[c][g] = counts[c].get(g, 0) + n[c]
        keys = [*(counts[0] | counts[1])]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[c].get(k, 0) for k in keys], pa.int64()) for c in (0, 1))], names=["g", "n0", "n1"])


@dataclass
class Shared:
    """What the shared backoff asks for: counts (n) and kinds of continuation (k) of one to three characters, by code."""

    n3: Grams
    n2: Grams
    k2: Grams
    n1: Grams
    k1: Grams
    last: Grams

    @staticmethod
    def of(trigrams: dict[str, int]) -> Shared:
        """From trigrams with the number of words that hold them."""
        code = np.array([_code(*map(ord, g)) for g in trigrams], np.int64)
        n = np.array(list(trigrams.values()), np.int64)

        def grouped(keys, n):
            once, at, kinds = np.unique(keys, return_inverse=True, return_counts=True)
            return once, np.bincount(at, n, len(once)), kinds

        two, last = grouped(code >> 21, n), grouped(code & (1 << 21) - 1, n)
        return Shared.packed((code, n), two, grouped(two[0] >> 21, two[1]), last[:2])

    @staticmethod
    def packed(three, two, one, last) -> Shared:
        table = lambda t, i: Grams(t[0].astype(np.uint64), t[i])
        return Shared(table(three, 1), table(two, 1), table(two, 2), table(one, 1), table(one, 2), table(last, 1))

    def probability(self, texts: list[str]) -> np.ndarray:
        """Of the last of one to three characters after the others."""
        c = points("".join(x.rjust(3, END) for x in texts)).astype(np.uint64).reshape(-1, 3)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        p = (self.last.find(c[:, 2])[0] + 1) / (self.last.values.sum() + len(self.last) + 256)
        one, two, bits = c[:, 1], c[:, 1] << np.uint64(21) | c[:, 2], np.uint64(21)
        before = c[:, 0] << bits | c[:, 1]
        for least, n, context, kinds in (
            (2, self.n2.find(two)[0], self.n1.find(one)[0], self.k1.find(one)[0]),
            (3, self.n3.find(before << bits | c[:, 2])[0], self.n2.find(before)[0], self.k2.find(before)[0]),
        ):
            seen = np.maximum(context, 1)
            p = np.where((length >= least) & (context > 0), np.maximum(n - DISCOUNT, 0) / seen + DISCOUNT * kinds / seen * p, p)
        return p


def _code(one, two, three):
    return one << 42 | two << 21 | three


def _trigrams(docs: DataFrame, text: str) -> DataFrame:
    """code, n: trigrams of the whole corpus with the number of its distinct words that hold them, by their places."""

    def spelled(batches):
        chunks: set[str] = set()
        for batch in sliced(batches):
            for body in batch.column(0).to_pylist():
                chunks.update(body.split())
            if len(chunks) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array({*map(word_of, chunks)}, pa.string())], names=["w"])
                chunks = set()
        if chunks:
            yield pa.RecordBatch.from_arrays([pa.array({*map(word_of, chunks)}, pa.string())], names=["w"])

    def tally(batches):
        for batch in sliced(batches, 20_000):
            joined = points(START + (END + START).join(batch.column(0).to_pylist()) + END).astype(np.int64)
            code = _code(joined[:-2], joined[1:-1], joined[2:])
            code, n = np.unique(code[(joined[:-2] != ord(END)) & (joined[1:-1] != ord(END))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    words = docs.select(whole_text(text).alias("text")).mapInArrow(spelled, "w string").distinct()
    return words.mapInArrow(tally, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _shared(docs: DataFrame, text: str, grams: list[str] | pa.ChunkedArray) -> Shared:
    """The shared counts of the whole corpus that the n-grams of the labelled sample ask for; the others stay in their table."""
    spark, mask = docs.sparkSession, (1 << 21) - 1
    ends = set().union(*({g[-3:] for g in some if len(g) > 2} for some in _blocks(grams)))
    c = points("".join(ends)).astype(np.int64).reshape(-1, 3)
    three = np.unique(_code(c[:, 0], c[:, 1], c[:, 2]))
    two = np.unique(np.concatenate([three >> 21, three & (1 << 42) - 1]))
    table = materialize(_trigrams(docs, text), "toxicity-shared")
    pairs = table.groupBy(F.shiftright("code", 21).alias("code")).agg(F.sum("n").alias("n"), F.count("*").alias("k"))

    def taken(df, codes=None):
        if codes is not None:
            df = df.join(F.broadcast(spark.createDataFrame(pa.table({"code": codes}))), "code", "left_semi")
        return [column.to_numpy() for column in df.toArrow().columns]

    ones = pairs.groupBy(F.shiftright("code", 21).alias("code")).agg(F.sum("n"), F.count("*"))
    return Shared.packed(taken(table, three), taken(pairs, two), taken(ones), taken(table.groupBy(F.col("code").bitwiseAND(mask).alias("code")).agg(F.sum("n"))))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, steps: int = 60) -> np.ndarray:
    """Weights (bias first) by Newton's method on standardized features."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([-4.0 if not len(y) or y.max() == 0 else 4.0] + [0.0] * x.shape[1])
    mean, dev = x.mean(0), x.std(0)
    dev[dev < 1e-6] = np.inf  # a constant says nothing
    a = np.concatenate([np.ones((len(y), 1)), (x - mean) / dev], 1)
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) + l2 * w)
    return np.concatenate([[w[0] - (w[1:] * mean / dev).sum()], w[1:] / dev])


def _ratios(grams, contexts, shared: Shared | dict[str, int]) -> tuple[Grams, Grams]:
    """Interpolated Kneser-Ney probabilities of both classes as ratios: of n-grams, and of the weight below each context.

    ``grams`` has an n-gram and both counts, ``contexts`` a context, its counts and its kinds, as rows or Arrow tables.
    Their strings are made and hashed BLOCK at a time; numbers alone are held of all.
    """
    if isinstance(shared, dict):
        shared = Shared.of(shared)
    texts, n = _columns(grams, 2)
    names, t = _columns([(c, *x) for c, x in contexts.items()] if isinstance(contexts, dict) else contexts, 4)
    weight = np.where(t[:2] > 0, DISCOUNT * t[2:] / np.maximum(t[:2], 1), 1.0)
    every, below = _hashes(texts), _hashes(names)
    row, context = Grams(every, np.arange(len(every))), Grams(below, np.arange(len(below)))

    def at(table: Grams, columns: np.ndarray, keys: list[str], missing: float) -> np.ndarray:
        i, held = table.find(hashes(keys))
        return np.where(held, columns[:, i.astype(np.int64)], missing) if len(table) else np.full((2, len(keys)), missing)

    def probability(some: list[str]) -> np.ndarray:
        """By class, of the last character of each n-gram after the others."""
        plain = np.array([len(g) < LOW and not (len(g) > 1 and g[0] == START) for g in some], bool)
        out = np.zeros((2, len(some)))
        if plain.any():
            out[:, plain] = shared.probability([g for g, p in zip(some, plain) if p])
        if not plain.all():
            rest = [g for g, p in zip(some, plain) if not p]
            before = [g[:-1] for g in rest]
            seen = at(context, t[:2], before, 0.0)
            out[:, ~plain] = at(context, weight, before, 1.0) * probability([g[1:] for g in rest]) + np.where(seen > 0, np.maximum(at(row, n, rest, 0.0) - DISCOUNT, 0) / np.maximum(seen, 1), 0)
        return out

    p = np.concatenate([np.zeros((2, 0)), *map(probability, _blocks(texts))], 1)
    return Grams(every, np.log(p[1] / p[0])), Grams(below, np.log(weight[1] / weight[0]))


def _blocks(texts: list[str] | pa.ChunkedArray):
    """The strings, in lists of at most BLOCK."""
    for at in range(0, len(texts), BLOCK):
        some = texts[at : at + BLOCK]
        yield some if isinstance(some, list) else some.to_pylist()


def _hashes(texts: list[str] | pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *map(hashes, _blocks(texts))])


def _columns(rows, width: int) -> tuple[list[str] | pa.ChunkedArray, np.ndarray]:
    """The strings and the numbers (a row a column) of rows or of an Arrow table."""
    if isinstance(rows, pa.Table):
        return rows.column(0), np.array([c.to_numpy() for c in rows.columns[1:]], float).reshape(width, -1)
    return [r[0] for r in rows], np.array([r[1:] for r in rows], float).reshape(-1, width).T


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS) -> Model:
    """Fit on labelled documents whose crc32 of the id as text is not 1 modulo 3; other labels are never read.

    Two thirds of them give the classes' counts and one third the calibration. Without toxic labels every score is low.
    Of labels that repeat an id the highest counts, of documents that repeat one the least text, so the sample is of
    2 * ``max_docs`` documents at most. Null ids and labels are not read. The counts do not depend on the layout of rows.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col(key).cast("string")) % 3 != 1)).groupBy(F.col(key).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_toxic")).withColumn("_hash", F.xxhash64("_id"))
    picked = [usable.where(F.col("_toxic") == c).orderBy("_hash", "_id").limit(max_docs) for c in (0, 1)]
    sample = picked[0].unionByName(picked[1]).withColumn("_fold", F.expr("pmod(_hash, 3)")).drop("_hash")
    bodies = materialize(docs.select(F.col(key).alias("_id"), whole_text(text).alias("text")).join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"), F.max("_fold").alias("fold")).drop("_id"), "toxicity-sample")
    words = bodies.where("fold > 0").select("text", "toxic").mapInArrow(_words, "w string, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    level = words.mapInArrow(_grams, "g string, n0 long, n1 long").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    level = materialize(level, "toxicity-grams")
    at_start = level.where(F.col("g").startswith(START) & (F.length("g") < HIGH))
    level = level.where(F.length("g") == HIGH)
    levels = [level]
    for n in range(HIGH - 1, LOW - 1, -1):  # lower orders count the characters seen before; at a word's start, documents
        level = level.groupBy(F.substring("g", 2, HIGH).alias("g")).agg(F.count(F.when(F.col("n0") > 0, 1)).alias("n0"), F.count(F.when(F.col("n1") > 0, 1)).alias("n1")).unionByName(at_start.where(F.length("g") == n))
        levels.append(level)
    grams = levels[0].unionByName(at_start.where(F.length("g") < LOW))
    for level in levels[1:]:
        grams = grams.unionByName(level)
    grams = materialize(grams, "toxicity-levels").withColumn("context", F.expr("substring(g, 1, length(g) - 1)"))
    totals = grams.groupBy("context").agg(F.sum("n0"), F.sum("n1"), F.count(F.when(F.col("n0") > 0, 1)), F.count(F.when(F.col("n1") > 0, 1)))
    held = grams.select("g", "n0", "n1").toArrow()  # grows with the sample, of at most MAX_DOCS documents a class, alone
    common = _shared(docs, text, held.column(0))
    ratio, backoff = _ratios(held, totals.toArrow(), common)
    del held, common
    pa.default_memory_pool().release_unused()
    model = Model(ratio, backoff, np.zeros(FEATURES + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches):
        lookup = shared.value.lookup()
        for batch in sliced(batches, 500):
            found = shared.value.features(batch.column(0).to_pylist(), lookup)
            yield pa.RecordBatch.from_arrays([*(pa.array(found[:, i]) for i in range(FEATURES)), batch.column(1)], names=[*map("f{}".format, range(FEATURES)), "toxic"])

    seen = np.array(sorted(tuple(r) for r in bodies.where("fold = 0").select("text", "toxic").mapInArrow(measured, ", ".join(f"f{i} double" for i in range(FEATURES)) + ", toxic int").collect()), float).reshape(-1, FEATURES + 1)
    shared.destroy()  # workers and the driver would keep this copy beside the scoring one
    model.weights, model.prior = _logistic(seen[:, :-1], seen[:, -1]), float((seen[:, -1].sum() + 1) / (len(seen) + 2)) if len(seen) else 0.01
    return model


NEW = ("score", "predicted")


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 from ``threshold``). Null and empty texts get the calibration's share of toxic documents.

    Columns of these names in ``df`` are replaced; nothing but the text is an input of the score.
    """
    kept = [f for f in df.schema.fields if f.name not in NEW]
    schema = StructType([*kept]).add("score", DoubleType()).add("predicted", IntegerType())
    names, at = [f.name for f in kept], next(i for i, f in enumerate(kept) if f.name == text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        lookup = m.lookup()
        for batch in sliced(batches):
            p = m.probability(m.features([b or "" for b in batch.column(at).to_pylist()], lookup))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, *NEW])

    return df.select(*names).mapInArrow(run, schema)


def score_documents(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``df``, repeated ones too; other columns are not read.

    Null texts are empty, and a null id is held out by no remainder: false. An empty table gives no rows.
    """
    scored = score(df.select("doc_id", whole_text().alias("text")), fit(df, labels))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def select(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, with all their columns, whose score stays below ``threshold``."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches):
        m = shared.value
        lookup = m.lookup()
        for batch in sliced(batches):
            p = m.probability(m.features([b or "" for b in batch.column(at).to_pylist()], lookup))
            yield batch.filter(pa.array(p < threshold))

    return df.mapInArrow(run, df.schema)
