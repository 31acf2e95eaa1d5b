"""Grams of many documents at once (E18): packs of documents, each with a lexicon of its own, and the document frequencies of their grams.

A pack is a row that holds the words of some 12 MB of text, compressed. Within it a gram is a pair of places in its sorted words, so counting is
sorting of integers. Packs ask for the frequencies of their distinct grams by 80 bits of hash (of a billion grams, two share them
with a chance below one in a million), a message for each range of hashes, and are answered in the same order: a gram travels
once a pack, and its frequency comes back as a number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Bytes and documents of a pack (a document is not cut), and messages' grams that one task adds up.
PACK, DOCS, ASKED = 12 << 20, 1 << 18, 1 << 22
#: What parts words.
APART = r"[^\p{L}\p{N}_]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them over the whole range."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, compressed by the places of their bytes."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def opened(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    """The arrays of ``n`` numbers each that :func:`squeezed` was given."""
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind in map(np.dtype, kinds):
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def columns(kind: str) -> str:
    """The columns of packs of documents with ids of this type."""
    return f"pack long, ids array<{kind}>, rows array<int>, sizes array<int>, n_words long, n_docs long, lexicon binary, n_bytes long, codes binary"


def packs(docs: DataFrame, stop_words=()) -> DataFrame:
    """pack, ids, rows, sizes, n_words, n_docs, lexicon, codes: ``docs`` (doc_id, text) as packs; rows of one id have to be adjacent.

    Words are runs of letters, digits and _; those of one character and ``stop_words`` are left out, and so are rows without others.
    Null ids are a document that is not counted in ``n_docs``.
    """
    kind, unwanted = docs.schema["doc_id"].dataType.simpleString(), pa.array([*stop_words], pa.string())

    def pack(number: int, held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held)
        lists = pc.split_pattern(pc.replace_substring_regex(t["text"].combine_chunks().cast(pa.large_string()), APART, " "), " ")
        coded = lists.flatten().dictionary_encode()
        good = pc.and_(pc.greater(pc.utf8_length(coded.dictionary), 1), pc.invert(pc.is_in(coded.dictionary, unwanted.cast(pa.large_string()))))
        order = pc.sort_indices(coded.dictionary).to_numpy()
        order = order[good.to_numpy(zero_copy_only=False)[order]]
        rank = np.full(len(coded.dictionary), -1, np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        codes = rank[coded.indices.to_numpy()]
        sizes = np.bincount(np.repeat(np.arange(t.num_rows), pc.list_value_length(lists).to_numpy()), codes >= 0, t.num_rows).astype(np.int32)
        codes, ids, rows, distinct = codes[codes >= 0], t["doc_id"].to_pylist(), [], []
        for i in np.flatnonzero(sizes):
            if rows and ids[i] == distinct[-1]:
                rows[-1] += 1
            else:
                rows.append(1)
                distinct.append(ids[i])
        lexicon = " ".join(coded.dictionary.take(order).to_pylist()).encode()
        place, known = TaskContext.get().partitionId() << 24 | number, sum(i is not None for i in distinct)
        arrays = {"ids": pa.array([distinct], pa.list_(t.schema.field("doc_id").type)), "rows": pa.array([rows], pa.list_(pa.int32())), "sizes": pa.array([sizes[sizes > 0]], pa.list_(pa.int32()))}
        return pa.RecordBatch.from_pydict({"pack": [place], **arrays, "n_words": [len(codes)], "n_docs": [known], "lexicon": [squeezed(np.frombuffer(lexicon, np.uint8))], "n_bytes": [len(lexicon)], "codes": [squeezed(codes)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, number, last = [], 0, 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids, lengths, begin = t["doc_id"].to_pylist(), pc.binary_length(t["text"]).to_pylist(), 0
            for i, (one, length) in enumerate(zip(ids, lengths)):
                if count and (size >= PACK or count >= DOCS) and one != last:
                    yield pack(number, [*held, t.slice(begin, i - begin)])
                    held, size, count, number, begin = [], 0, 0, number + 1, i
                size, count, last = size + length, count + 1, one
            held.append(t.slice(begin))
        if held:
            yield pack(number, held)

    made = docs.select("doc_id", F.lower("text").alias("text")).where("text is not null").mapInArrow(run, columns(kind))
    return made.where("n_words > 0")


#: The columns of a pack that :class:`Pack` reads.
READ = ("pack", "ids", "rows", "sizes", "n_words", "lexicon", "n_bytes", "codes")


class Pack:
    """The postings of a pack, by gram and document.

    keys: its distinct grams, ascending; gram, doc, tf: of each posting the places of its gram and document and how often it
    stands there; ids: of the documents.
    """

    def __init__(self, table: pa.Table | pa.RecordBatch, row: int = 0):
        got = {c: table[c][row] for c in READ}
        lexicon = pa.py_buffer(opened(got["lexicon"].as_py(), n := got["n_bytes"].as_py(), np.uint8)[0])
        self.lexicon = pc.split_pattern(pa.LargeStringArray.from_buffers(1, pa.py_buffer(np.array([0, n], np.int64)), lexicon), " ").flatten()
        word = opened(got["codes"].as_py(), got["n_words"].as_py(), np.int32)[0].astype(np.uint64)
        self.ids, sizes = got["ids"].values, got["sizes"].values.to_numpy()
        rows = np.repeat(np.arange(len(sizes)), sizes)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.uint64), got["rows"].values.to_numpy())[rows]
        adjacent = np.flatnonzero(rows[1:] == rows[:-1])
        one, doc = np.concatenate([word, word[adjacent]]), np.concatenate([doc, doc[adjacent]])
        two = np.concatenate([np.zeros(len(word), np.uint64), word[adjacent + 1] + np.uint64(1)])
        wide, high = len(self.lexicon).bit_length(), (len(self.ids) - 1).bit_length()
        if 2 * wide + high <= 64:  # numbers are sorted faster than places
            bits = lambda n: np.uint64(n)
            all_three = one << bits(wide + high) | two << bits(high) | doc
            all_three.sort()
            one, two, doc = all_three >> bits(wide + high), all_three >> bits(high) & bits((1 << wide) - 1), all_three & bits((1 << high) - 1)
        else:
            order = np.lexsort((doc, two, one))
            one, two, doc = one[order], two[order], doc[order]
        key = one << np.uint64(32) | two
        other = np.append(True, key[1:] != key[:-1])
        begins = np.flatnonzero(other | np.append(True, doc[1:] != doc[:-1]))
        self.tf = np.diff(np.append(begins, len(key)))
        self.keys, self.gram, self.doc = key[other], (np.cumsum(other) - 1)[begins], doc[begins].astype(np.int64)

    @cached_property
    def in_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct grams by their hashes, and the sorted hashes: the order of messages and answers."""
        a, b = hashes(self.lexicon.to_pylist(), self.keys)
        order = np.argsort(a)
        if (a[order[1:]] == a[order[:-1]]).any():
            order = np.lexsort((b, a))
        return order, a[order], b[order]

    def grams(self, which: np.ndarray) -> pa.Array:
        """The texts of distinct grams."""
        first, second = (self.keys[which] >> np.uint64(32)).astype(np.int64), (self.keys[which] & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
        alone, rest = self.lexicon.take(pa.array(first)), self.lexicon.take(pa.array(np.maximum(second, 0)))
        return pc.if_else(pa.array(second < 0), alone, pc.binary_join_element_wise(alone, rest, pa.scalar(" ", rest.type)))


def hashes(words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 16 bits of grams of ``words``: place of the first << 32 | place of the second + 1, or 0."""
    both = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words), np.uint64).reshape(-1, 2)
    one, two = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first, second = mixed(both) * _ODD, np.vstack([np.zeros((1, 2), np.uint64), both])
    wide = lambda c: mixed(first[:, c][one] + second[:, c][two])
    return wide(0), (wide(1) >> np.uint64(48)).astype(np.uint16)


def _grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of hashes in which equal ones are adjacent, and where in it each begins."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (y[1:][same] != y[:-1][same]).any():  # 64 bits are shared by unlike grams
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    return order, np.flatnonzero(np.append(True, ~same))


def frequencies(packed: DataFrame, asked: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """pack, part, n, df: written answers to all packs, in the order of parts; pack -1 has those to ``asked`` hashes that are known.

    For -1, df are places among the asked ones and their frequencies.
    """
    spark = packed.sparkSession
    parts = max(1, -(-2 * (packed.agg(F.sum("n_words")).first()[0] or 0) // ASKED))
    wanted = None if asked is None else spark.sparkContext.broadcast(asked)

    def ask(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                p = Pack(batch, row)
                local = np.bincount(p.gram, minlength=len(p.keys)).astype(np.uint32)
                order, a, b = p.in_order
                local = local[order]
                part = ((a >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
                for i, j in zip(cuts[:-1], cuts[1:]):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part[i]], pa.int64()), "pack": [batch["pack"][row].as_py()], "n": pa.array([j - i], pa.int64()), "data": [squeezed(a[i:j], b[i:j], local[i:j])]})

    def answer(met: pa.Table) -> pa.Table:
        ns = met["n"].to_pylist()
        a, b, local = (np.concatenate(x) for x in zip(*(opened(d, n, np.uint64, np.uint16, np.uint32) for d, n in zip(met["data"].to_pylist(), ns))))
        order, begins = _grouped(a, b)
        sums = np.add.reduceat(local[order].astype(np.int64), begins)
        df = np.empty(len(a), np.int64)
        df[order] = np.repeat(sums, np.diff(np.append(begins, len(a))))
        out = [(p, n, squeezed(x)) for p, n, x in zip(met["pack"].to_pylist(), ns, np.split(df, np.cumsum(ns)[:-1]))]
        if wanted is not None:
            place, at = found(*wanted.value, a[order[begins]], b[order[begins]])
            out.append((-1, len(at), squeezed(at, sums[place])))
        return pa.table({"pack": pa.array([o[0] for o in out], pa.int64()), "part": pa.array([met["part"][0].as_py()] * len(out), pa.int64()), "n": pa.array([o[1] for o in out], pa.int64()), "df": pa.array([o[2] for o in out], pa.binary())})

    sent = packed.select(*READ).mapInArrow(ask, "part long, pack long, n long, data binary")
    return written(sent.groupBy("part").applyInArrow(answer, "pack long, part long, n long, df binary"), "frequencies")


def found(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the hashes (a, b), which are distinct and sorted, of those hashes (x, y) that are there, and their places in these."""
    low, high = np.searchsorted(a, x), np.searchsorted(a, x, "right")
    places, at, step = [], [], 0
    while (more := low + step < high).any():  # more than one step only where 64 bits are shared
        i = np.flatnonzero(more)
        i = i[b[low[i] + step] == y[i]]
        places.append(low[i] + step)
        at.append(i)
        step += 1
    return (np.concatenate(places), np.concatenate(at)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def weighed(packed: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """Rows of ``run(pack, df)`` for every pack: its postings, and the frequencies of its distinct grams."""

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        p = Pack(left)
        df = np.empty(len(p.keys), np.int64)
        df[p.in_order[0]] = np.concatenate([opened(d, n, np.int64)[0] for d, n in zip(right["df"].to_pylist(), right["n"].to_pylist())])
        return run(p, df)

    rows = packed.select(*READ).groupBy("pack")
    return rows.cogroup(answers.where("pack >= 0").groupBy("pack")).applyInArrow(met, schema)
