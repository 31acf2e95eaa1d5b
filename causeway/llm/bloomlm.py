"""Language-model scores from a log-frequency Bloom filter (operator 11).

Tokens are words (A-Z as a-z) and one end a document. Words and pairs of consecutive tokens of the training documents are
counted in Spark: a task adds up what it reads and sends sorted blocks of (hash, count) to the segment of their hashes, whose
task adds the blocks. A count c is held as its level, the number of thresholds 1, 2, 3, 4, 6, 8, 12, ... (a half more each) up
to c; the filter holds the items (n-gram, 1) to (n-gram, level) with BITS bits an item and PROBES probes each. A count is read
by probing (n-gram, 1), (n-gram, 2), ... until one is missing, and is never read too low. A pair counts at most as often as
its words, which undoes most false finds.

    P(w)   = (c(w) + 1) / (N + V + 1)
    P(w|v) = (c(vw) + MU P(w)) / (c(v) + MU)            (Dirichlet smoothing; v is the end before a first word)

The filter is made of segments of bounded size, one a task; it grows with the distinct n-grams of the corpus. Up to
``broadcast_bytes`` it goes to the workers as it is. Beyond, the n-grams go to the segments: blocks of documents ask each
segment for their distinct hashes in order, its task reads the levels of all blocks at once, and a byte a hash returns to the
documents. Both ways give the same scores. The base score needs exact counts of words: the most frequent (FREQUENT at most) are broadcast, the documents'
other words are joined with the table of counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import materialize, whole_text

#: Bits and probes of an item, and the weight of the words' probabilities in those of pairs.
BITS, PROBES, MU = 8, 4, 300.0
#: Tokens that a task adds up before it sends them, and that a segment of the filter is made from.
HELD, SEGMENT_TOKENS = 1 << 19, 1 << 21
#: Words whose exact counts are broadcast (16 bytes each).
FREQUENT = 2_000_000
#: A larger filter stays in Spark; documents ask it in blocks of about so many bytes of text.
BROADCAST_BYTES, BLOCK_BYTES = 128 << 20, 4 << 20
#: Hashes that a segment looks up at once.
LOOKED_UP = 1 << 20
#: The end of a document: no word hashes to it but by chance, as to any other word.
END = wordhash.mixed(np.array([0xE0D], np.uint64))[0]
_U = np.uint64


def _thresholds() -> np.ndarray:
    found = [1, 2, 3]
    while found[-1] < 1 << 60:
        found.append(found[-2] * 2)
    return np.array(found, np.int64)


THRESHOLDS = _thresholds()
#: The count that a level stands for: the middle of those it holds; level 0 is none.
MEANT = np.append(0.0, (THRESHOLDS[:-1] + THRESHOLDS[1:] - 1) / 2)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The level of each count: how many thresholds it reaches."""
    return np.searchsorted(THRESHOLDS, counts, side="right")


def word_keys(tokens: np.ndarray) -> np.ndarray:
    return wordhash.mixed(tokens + _U(1))


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return wordhash.mixed(before * _U(0xD1342543DE82EF95) + tokens + _U(2))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments hold consecutive hashes, so sorted hashes come in their order."""
    return ((keys >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)


def _places(keys: np.ndarray, level: int, bits: np.ndarray):
    """The bits of the item (key, level) in a filter of ``bits`` bits, one array a probe."""
    one = wordhash.mixed(keys + _U(level * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
    two = wordhash.mixed(one ^ _U(0x9FB21C651E98DF25)) | _U(1)
    for nth in range(PROBES):
        yield (one + _U(nth) * two) % bits


def filled(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of a filter that holds ``keys`` with ``counts``: 8 of them at least."""
    level = levels_of(counts)
    size = _U(max(64, -(-int(level.sum()) * BITS // 64) * 64))
    bits = np.zeros(int(size), bool)
    for nth in range(1, int(level.max(initial=0)) + 1):
        for at in _places(keys[level >= nth], nth, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """Segments of a log-frequency filter, one after the other in ``data``; ``starts`` are their first bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        self.data, self.starts = data, starts

    @classmethod
    def of(cls, segments: list) -> Filter:
        return cls(np.frombuffer(b"".join(segments), np.uint8), np.cumsum([0, *map(len, segments)]))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probes until one is missing."""
        found = np.zeros(len(keys), np.uint8)
        if len(self.starts) < 2:
            return found
        where = segment_of(keys, len(self.starts) - 1)
        first, bits = self.starts[where], ((self.starts[where + 1] - self.starts[where]) * 8).astype(np.uint64)
        live = np.arange(len(keys))
        for level in range(1, len(THRESHOLDS)):
            held = np.ones(len(live), bool)
            for at in _places(keys[live], level, bits[live]):
                at = at.astype(np.int64)
                held &= (self.data[first[live] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[held]
            if not len(live):
                break
            found[live] = level
        return found


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all texts one after the other, tokens of each text): its words and one end."""
    hashes, counts = wordhash.words(column)
    counts = counts + 1
    out = np.full(int(counts.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = hashes
    return out, counts


def _texts(batches, size: int = 1 << 19):
    """Slices of record batches with about ``size`` bytes in their last column (texts), one row at least."""
    try:
        for batch in batches:
            column = batch.column(batch.num_columns - 1).cast(pa.large_string())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
                yield batch.slice(at, to - at)
                at = to
    finally:  # workers serve many tasks: what this one took goes back
        pa.default_memory_pool().release_unused()


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts, of parts (keys, counts)."""
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _added(make, emit):
    """A map over texts: adds up the keys that ``make`` has of each slice and emits sums of at most about 2 x HELD keys."""

    def run(batches):
        parts, held = [], 0
        for batch in _texts(batches):
            for keys in make(batch):
                found, counts = np.unique(keys, return_counts=True)
                parts.append((found, counts.astype(np.int64)))
                held += len(found)
            if held >= HELD:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held >= HELD // 2:
                    yield from emit(*parts[0])
                    parts, held = [], 0
        if held:
            yield from emit(*_summed(parts))

    return run


def _rows_of_words(keys, counts):
    for at in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])], names=["word", "n"])


def _pairs(batch):
    tokens, _ = tokens_of(batch.column(0))
    yield word_keys(tokens)
    yield pair_keys(np.append(END, tokens[:-1]), tokens)


def _blocks(segments: int):
    def emit(keys, counts):
        edges = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
        full = np.flatnonzero(np.diff(edges))
        for at in range(0, len(full), 256):
            cut = [(int(s), keys[edges[s] : edges[s + 1]].tobytes(), counts[edges[s] : edges[s + 1]].tobytes()) for s in full[at : at + 256]]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), *(pa.array([c[i] for c in cut], pa.binary()) for i in (1, 2))], names=["segment", "keys", "counts"])

    return emit


def _filled(table: pa.Table) -> pa.Table:
    parts = [(np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
    data = filled(*_summed(parts)).tobytes()
    return pa.table({"segment": table.column("segment").slice(0, 1), "data": pa.array([data], pa.binary()), "size": pa.array([len(data)], pa.int64())})


class Model:
    """What :func:`fit` has gathered: tables in the shared folder, and what is small enough to broadcast."""

    def __init__(self, words: DataFrame, segments: DataFrame, count: int, tokens: int, distinct: int, size: int):
        self.words, self.segments, self.count, self.tokens, self.distinct, self.size = words, segments, count, tokens, distinct, size


def fit(df: DataFrame, text: str = "text") -> Model:
    """Counts of the words and pairs of all rows of ``df``, exact for words, as a log-frequency filter for both.

    Null texts are empty: an end alone. An empty table gives a model without tokens, for which every token is new.
    """
    texts = df.select(whole_text(text).alias("text"))
    counted = texts.mapInArrow(_added(lambda batch: [tokens_of(batch.column(0))[0]], _rows_of_words), "word long, n long")
    words = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    count = max(1, -(-2 * tokens // SEGMENT_TOKENS))
    blocks = texts.mapInArrow(_added(_pairs, _blocks(count)), "segment int, keys binary, counts binary")
    segments = materialize(blocks.groupBy("segment").applyInArrow(_filled, "segment int, data binary, size long"), "filter")
    size = segments.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return Model(words, segments, count, tokens, distinct, size)


def frequent_words(words: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(least count, words, counts) of all words with at least that count: as many whole counts as ``most`` words allow."""
    least, total = None, 0
    for n, times in words.groupBy("n").count().orderBy(F.desc("n")).limit(most).toLocalIterator():
        if total + times > most:
            break
        least, total = n, total + times
    if least is None:
        return 1 << 62, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = words.where(F.col("n") >= least).toArrow()
    keys, counts = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    return least, keys[order], counts[order]


def _looked_up(keys: np.ndarray, held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of ``keys`` in the sorted ``held``, 0 where they are not held."""
    if not len(held):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return np.where(held[at] == keys, values[at], 0)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


class _Scorer:
    """Scores of documents from the levels of their words and pairs, and from exact counts of frequent words."""

    def __init__(self, tokens: int, distinct: int, words: np.ndarray, counts: np.ndarray, all_held: bool, mu: float):
        self.size, self.words, self.counts, self.all_held, self.mu = tokens + distinct + 1, words, counts, all_held, mu

    def asked(self, tokens: np.ndarray):
        """(distinct tokens, which of them each token is, keys of them, keys of all pairs)."""
        distinct, which = np.unique(tokens, return_inverse=True)
        return distinct, which, word_keys(distinct), pair_keys(np.append(END, tokens[:-1]), tokens)

    def rows(self, tokens: np.ndarray, counts: np.ndarray, levels) -> list:
        """n_tokens, n_known, base, score, words and times of each document; ``levels`` has the levels of keys.

        Words beside the frequent ones, if there are others, are listed with the times they occur and not yet counted.
        """
        distinct, which, keys, pairs = self.asked(tokens)
        held = MEANT[levels(keys)]
        own = held[which]
        before = np.append(held[np.searchsorted(distinct, END)], own[:-1])
        pair = np.minimum(MEANT[levels(pairs)], np.minimum(own, before))
        score = np.log10((pair + self.mu * ((own + 1) / self.size)) / (before + self.mu))
        exact = _looked_up(distinct, self.words, self.counts)
        known, base = (exact > 0)[which], np.log10((exact + 1) / self.size)[which]
        starts = np.cumsum(counts) - counts
        if self.all_held:
            other = [[]] * len(counts)
            times = other
        else:
            base[~known] = 0.0
            at = np.flatnonzero(~known)
            # one number a (document, word): sorting rows of two takes ten times as long
            codes, met = np.unique((np.searchsorted(starts, at, side="right") - 1) * len(distinct) + which[at], return_counts=True)
            edges = np.searchsorted(codes, np.arange(len(counts) + 1) * len(distinct))
            names = distinct[codes % max(1, len(distinct))].view(np.int64)
            other = [names[edges[i] : edges[i + 1]] for i in range(len(counts))]
            times = [met[edges[i] : edges[i + 1]] for i in range(len(counts))]
        return [counts, _sums(known.astype(np.int64), counts), _sums(base, counts), _sums(score, counts), other, times]


_SCORED = "n_tokens long, n_known long, base_score double, score double, words array<long>, times array<long>"


def _batch(row0: int, keys, found: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _SCORED.split(", ")]
    numbers = pa.array(np.arange(row0, row0 + len(keys)), pa.int64())
    return pa.RecordBatch.from_arrays([numbers, keys, *(pa.array(v, k) for v, k in zip(found, kinds))], names=["row", "key", *names])


def _numbered() -> int:
    """The first row number of this task; numbers are unique in one written result."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 40


def _direct(held):
    def run(batches):
        scorer, found = held.value
        row = _numbered()
        for batch in _texts(batches):
            tokens, counts = tokens_of(batch.column(1))
            yield _batch(row, batch.column(0), scorer.rows(tokens, counts, found.levels))
            row += len(counts)

    return run


def _cut(batches):
    """Blocks of documents: number, keys and texts."""
    row = _numbered()
    for batch in _texts(batches, BLOCK_BYTES):
        listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), listed(batch.column(0)), listed(batch.column(1).cast(pa.string()))], names=["block", "doc_keys", "texts"])
        row += batch.num_rows


def _keys_of(scorer: _Scorer, tokens: np.ndarray) -> np.ndarray:
    """What a block asks for: its distinct keys in order, which is the order of segments too."""
    *_, words, pairs = scorer.asked(tokens)
    return np.unique(np.concatenate([words, pairs]))


def _asks(scorer, segments: int):
    def run(batches):
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = _keys_of(scorer.value, tokens_of(texts.values)[0])
                for cut in _blocks(segments)(keys, np.zeros(len(keys), np.int8)):
                    yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([block] * len(cut), pa.int64()), cut.column(1)], names=["segment", "block", "keys"])

    return run


def _answers(asks: pa.Table, data: pa.Table) -> pa.Table:
    """The levels of all keys that blocks ask of one segment (a segment by itself holds every key asked of it).

    Blocks ask for few keys each and often for the same: many blocks' keys are looked up at once, each once.
    """
    here = Filter.of(data.column("data").to_pylist())
    keys = [np.frombuffer(k, np.uint64) for k in asks.column("keys").to_pylist()]
    ends, levels, at = np.cumsum([0, *map(len, keys)]), [], 0
    while at < len(keys):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + LOOKED_UP, side="right")) - 1)
        distinct, which = np.unique(np.concatenate(keys[at:to]), return_inverse=True)
        found = here.levels(distinct)[which]
        levels += [found[ends[i] - ends[at] : ends[i + 1] - ends[at]].tobytes() for i in range(at, to)]
        at = to
    return pa.table({"block": asks.column("block"), "segment": asks.column("segment"), "levels": pa.array(levels, pa.binary())})


def _answered(scorer):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        blocks, answers = blocks.combine_chunks(), answers.sort_by("segment")
        levels = np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)
        tokens, counts = tokens_of(blocks.column("texts").chunk(0).flatten())
        keys = _keys_of(scorer.value, tokens)
        found = scorer.value.rows(tokens, counts, lambda asked: levels[np.searchsorted(keys, asked)])
        return pa.Table.from_batches([_batch(blocks.column("block")[0].as_py(), blocks.column("doc_keys").chunk(0).flatten(), found)])

    return run


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", mu: float = MU, broadcast_bytes: int = BROADCAST_BYTES, frequent: int = FREQUENT) -> DataFrame:
    """key, n_tokens, n_known, base_score, score of every row: its log10 probability by single words and by the model.

    Null texts are empty: one end. Rows with equal keys are rows of their own; null keys stay. A very long text is scored by one
    task in memory that follows its length. Columns beside key and text are not read. An empty table gives no rows.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    least, words, counts = frequent_words(model.words, frequent)
    scorer = _Scorer(model.tokens, model.distinct, words, counts, len(words) == model.distinct, mu)
    texts = df.select(F.col(key).alias("key"), whole_text(text).alias("text"))
    schema = f"row long, key {kind}, {_SCORED}"
    if model.size <= broadcast_bytes:
        table = model.segments.select("segment", "data").toArrow().sort_by("segment")
        empty = filled(np.zeros(0, np.uint64), np.zeros(0, np.int64)).tobytes()
        data = dict(zip(table.column("segment").to_pylist(), table.column("data").to_pylist()))
        held = spark.sparkContext.broadcast((scorer, Filter.of([data.get(i, empty) for i in range(model.count)])))
        found = texts.mapInArrow(_direct(held), schema)
    else:
        held = spark.sparkContext.broadcast(scorer)
        blocks = materialize(texts.mapInArrow(_cut, f"block long, doc_keys array<{kind}>, texts array<string>"), "text-blocks", "zstd")
        asks = blocks.select("block", "texts").mapInArrow(_asks(held, model.count), "segment int, block long, keys binary")
        answers = asks.groupBy("segment").cogroup(model.segments.groupBy("segment")).applyInArrow(_answers, "block long, segment int, levels binary")
        found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered(held), schema)
    columns = ["row", "key", "n_tokens", "n_known", "base_score", "score"]
    if not scorer.all_held:
        found = materialize(found, "scored")
        other = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
        rare = model.words.where(F.col("n") < least).withColumnRenamed("word", "words")
        met = other.join(rare, "words", "left").groupBy("row").agg(
            F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(scorer.size))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"),
        )
        found = found.join(met, "row", "left").withColumns({"base_score": F.col("base_score") + F.coalesce("more", F.lit(0.0)), "n_known": F.col("n_known") + F.coalesce("met", F.lit(0))})
    return found.select(*columns).drop("row").withColumnRenamed("key", key)


def held_out(key: str):
    """The contract's documents to learn nothing from: the crc32 of the id's text leaves 2 by 7; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7 == 2


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents, learnt from those not held out."""
    model = fit(df.where(~held_out(key)), text)
    found = score(df, model, key, text, **options)
    return found.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
