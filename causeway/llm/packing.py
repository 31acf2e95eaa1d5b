"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most ``capacity``
numbers) reaches the driver: the reduction and the best fit work on counts of equal lengths, and give runs of
ranks instead of single pieces. Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced, whole_text

CAPACITY = 1024
END_ID = 2


@lru_cache(maxsize=2)
def _encoder(vocabulary: str, special: str):
    """The byte-level BPE of a ``tokenizers`` JSON file as a tiktoken encoding: same pre-split, ranks and ids, several times the speed."""
    import json

    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(table[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def token_ids(text: str, vocabulary: str = "byte_bpe_50k.json") -> np.ndarray:
    """A text's ids as the tokenizers library gives them (special tokens in a text count as such), without an end mark."""
    enc = _encoder(vocabulary, "all")
    return enc.encode_to_numpy(text, allowed_special="all") if "<|" in text else enc.encode_to_numpy(text, disallowed_special=())


def pieces(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document, cut into pieces of ``capacity``; the first may be shorter."""

    def cut(batches):
        for batch in sliced(batches):
            keys, out = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc, body in zip(keys, batch.column(1).to_pylist()):
                ids = np.append(token_ids(body, vocabulary), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                for n, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if not n else at + capacity]
                    for column, value in zip(out, (doc, n, at, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), whole_text(text).alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class _Plan:
    """Places of pieces by length and rank: rows (length, first rank, last rank, first sequence, copies a sequence, offset)."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        self.taken = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def place(self, size: int, sequence: int, bins: int, copies: int, offset: int) -> None:
        at = self.taken[size]
        self.rows.append((size, at, at + bins * copies - 1, sequence, copies, offset))
        self.taken[size] = at + bins * copies
        self.left[size] -= bins * copies
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def fix(self, sizes: list[int], times: int) -> None:
        """``times`` sequences that hold exactly ``sizes``."""
        offset = 0
        for size in sizes:
            self.place(size, self.sequences, times, 1, offset)
            offset += size
        self.sequences += times

    def largest(self, room: int, without: tuple[int, ...] = ()) -> int:
        """The largest length of at most ``room`` that is left beside ``without``; 0: none."""
        i = bisect.bisect_right(self.sizes, room)
        while i:
            i -= 1
            s = self.sizes[i]
            if self.left[s] > without.count(s):
                return s
        return 0

    def smallest(self, n: int, without: int) -> int:
        """The sum of the ``n`` smallest pieces beside one of ``without``; a large number if there are fewer."""
        total = 0
        for s in self.sizes:
            here = min(n, self.left[s] - (s == without))
            total, n = total + here * s, n - here
            if not n:
                return total
        return 1 << 60


def reduce_by_dominance(plan: _Plan, capacity: int) -> None:
    """Martello-Toth reduction: fix sets of up to three pieces that dominate all feasible sets with their largest piece.

    With j the piece, R the room beside it and i the largest piece that fits: {j} if none fits; {j, i} if i fills R or
    if two more pieces never fit; with at most two more, {j, i} if i is as long as any pair that fits, and {j, a, b}
    if a = i and no pair that fits has a smaller member above b.
    """
    again = True
    while again:
        again = False
        for j in list(reversed(plan.sizes)):
            while plan.left.get(j):
                room = capacity - j
                i = plan.largest(room, (j,))
                if not i:
                    plan.fix([j], plan.left[j])
                elif i == room or plan.smallest(2, j) > room:
                    plan.fix([j, i], max(1, plan.left[j] // 2) if i == j else min(plan.left[j], plan.left[i]))
                elif plan.smallest(3, j) > room:
                    best, pair, top = 0, (0, 0), 0
                    for b in plan.sizes:
                        if b > room - b:
                            break
                        if plan.left[b] <= (b == j):
                            continue
                        a = plan.largest(room - b, (j, b))
                        if a >= b:
                            top = b
                            if a + b >= best:
                                best, pair = a + b, (a, b)
                    if i >= best:
                        plan.fix([j, i], 1 if i == j else min(plan.left[j], plan.left[i]))
                    elif pair[0] == i and top <= pair[1]:
                        same = len({j, *pair}) < 3
                        plan.fix([j, *pair], 1 if same else min(plan.left[s] for s in (j, *pair)))
                    else:
                        break
                else:
                    break
                again = True


def best_fit(plan: _Plan, capacity: int) -> None:
    """Best fit in decreasing order of what is left: a piece goes to the open sequence with the least room that holds it.

    Sequences with equal contents form a run; a length touches a run as a whole, so runs stay few.
    """
    open_runs: list[tuple[int, int, int]] = []  # (room, first sequence, number), sorted
    for size in list(reversed(plan.sizes)):
        while (n := plan.left.get(size, 0)) > 0:
            at = bisect.bisect_left(open_runs, (size, -1, -1))
            if at < len(open_runs):
                room, first, number = open_runs.pop(at)
            else:
                copies = capacity // size
                room, first, number = capacity, plan.sequences, -(-n // copies)
                plan.sequences += number
            copies = room // size
            full = min(number, n // copies)
            if full:
                plan.place(size, first, full, copies, capacity - room)
                if room % size or room - copies * size:
                    bisect.insort(open_runs, (room - copies * size, first, full))
            rest, first, number = plan.left.get(size, 0), first + full, number - full
            if number and rest:
                some = min(rest, copies - 1) if rest < copies else 0
                if some:
                    plan.place(size, first, 1, some, capacity - room)
                    bisect.insort(open_runs, (room - some * size, first, 1))
                    first, number = first + 1, number - 1
            if number:
                bisect.insort(open_runs, (room, first, number))


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int, int]:
    """Places for a histogram of lengths; the number of sequences, and of those fixed by dominance."""
    plan = _Plan(counts)
    reduce_by_dominance(plan, capacity)
    fixed = plan.sequences
    best_fit(plan, capacity)
    return plan.rows, plan.sequences, fixed


def pack(cut: DataFrame, capacity: int = CAPACITY, salt_rows: int = 200_000) -> DataFrame:
    """``cut`` with sequence_id and offset: pieces of ``capacity`` alone, all others by reduction and best fit.

    Ranks within a length are counted in salted groups of about ``salt_rows``, so a length that a third of all pieces
    share is spread over tasks. Lengths repeat, ties have no effect on the number of sequences. Empty input: no rows.
    """
    spark = cut.sparkSession
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most capacity rows
    rows, _, _ = plan_lengths(counts, capacity)
    salts = spark.createDataFrame([(s, max(1, n // salt_rows)) for s, n in counts.items()] or [(0, 1)], "length long, salts long")
    keyed = cut.join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(doc_id, piece), salts)"))
    sums = keyed.groupBy("length", "salt").count()
    before = sums.selectExpr("length", "salt", "sum(count) over (partition by length order by salt) - count as base")
    ranked = keyed.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, piece, start, ids_crc32) - 1 as nth").join(before, ["length", "salt"]).withColumn("rank", F.col("nth") + F.col("base"))
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(r[0], []).append({"hi": r[2], "lo": r[1], "seq": r[3], "copies": r[4], "off": r[5]})
    places = spark.createDataFrame(list(by_size.items()) or [(0, [])], "length long, runs array<struct<hi:long,lo:long,seq:long,copies:long,off:long>>")
    found = ranked.join(F.broadcast(places), "length").withColumn("run", F.expr("filter(runs, r -> rank <= r.hi)[0]"))
    return found.selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "run.seq + (rank - run.lo) div run.copies as sequence_id", "run.off + ((rank - run.lo) % run.copies) * length as offset")


def pack_documents(df: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack every row of ``df``, whole; null texts are empty (the end id alone).

    Repeated rows are packed as often as they come; rows that share an id and differ in text are told apart by ids_crc32.
    Other columns are not read. An empty table gives no rows.
    """
    return pack(materialize(pieces(df, capacity, end_id, vocabulary, key, text), "pieces"), capacity)
