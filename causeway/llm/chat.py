"""Chat formatting: a hidden Markov model recovers the turns and roles of transcripts.

A line's hidden state is its speaker's role and whether the line begins a turn. It emits independent features: the class
of a speaker marker, its length, a question mark at its end, and a list or code start; the four make one byte. Counts of
labelled transcripts give all probabilities. Roles are the Viterbi path. A transcript of one block is decoded where it is
read, many at a time. Longer ones are decoded exactly in blocks: each block's best score from every entry to every exit
state is a small matrix; those are chained over a transcript, and each block is then decoded between its states. The
turns are rendered in one canonical form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
NAMES = {
    "system": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user",
    "assistant": "assistant", "bot": "assistant", "ai": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant",
}
MARKER = re.compile(r"\s*(?:#{1,4}\s*|\[|\*\*|<\|?)?([A-Za-z]{1,14})(?:\]|\*\*|\|?>)?\s?(?::|>|\]|(?<=>))\s?")
LIST = re.compile(r"\s*(?:[-*•]\s|\d{1,3}[.)]\s|```| {4})")
FEATURES = (("none", "other", *ROLES), tuple(range(7)), (False, True), (False, True))
#: Numbers of the input's pieces in a block, lines of a block at most, and lines that are decoded at a time.
BLOCK, LINES, BATCH_LINES = 64, 4096, 20_000
SMOOTH = 0.5
#: The fit reads the transcripts of so many turns, those with the least hash of their id. Parsing has no bound.
MAX_TURNS = 20_000


def marker(line: str) -> tuple[str, int]:
    """The class of a line's speaker marker and where the text after it begins."""
    m = MARKER.match(line)
    if not m:
        return "none", 0
    role = NAMES.get(m[1].lower())
    return (role, m.end()) if role else ("other", 0)


def features(line: str) -> tuple[int, int, int, int]:
    kind, _ = marker(line)
    return FEATURES[0].index(kind), min(6, len(line).bit_length() // 2), int(line.rstrip().endswith("?")), int(bool(LIST.match(line)))


def code(line: str) -> int:
    """The four features as one number below 140."""
    a, b, c, d = features(line)
    return ((a * 7 + b) * 2 + c) * 2 + d


def codes(lines: list[str]) -> np.ndarray:
    return np.fromiter(map(code, lines), np.uint8, len(lines))


@dataclass
class Model:
    """Log-probabilities: of first states, of the next state (row: from), and of each feature's values by state."""

    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    def __post_init__(self):
        a, b, c, d = np.unravel_index(np.arange(140), (5, 7, 2, 2))
        #: Log-probability of each code by state, a row a code.
        self.table = sum(self.emit[f][:, v].T for f, v in enumerate((a, b, c, d)))

    def through(self, block: np.ndarray) -> np.ndarray:
        """Best log-probability of a block's codes from each state before it to each state at its end."""
        best = None
        for e in self.table[block]:
            best = self.step + e if best is None else (best[:, :, None] + self.step[None]).max(1) + e
        return best

    def alone(self, block: np.ndarray) -> np.ndarray:
        """Best log-probability of a first block by its last state."""
        score = self.start + self.table[block[0]]
        return score if len(block) == 1 else (score[:, None] + self.through(block[1:])).max(0)

    def paths(self, blocks: list[np.ndarray], entry=None, last=None) -> list[np.ndarray]:
        """The best states of each block of codes. ``entry`` is the state before a block (-1: it is the first), ``last`` its
        last state (-1: the best); by default all blocks are whole transcripts. Ties go to the earlier state."""
        n = len(blocks)
        length = np.array([len(b) for b in blocks])
        order = np.argsort(-length, kind="stable")
        tall = length[order]
        padded = np.zeros((n, int(tall[0])), np.uint8)
        for i, at in enumerate(order):
            padded[i, : length[at]] = blocks[at]
        first = np.tile(self.start, (n, 1)) if entry is None else np.where(np.asarray(entry)[:, None] < 0, self.start, self.step[np.maximum(entry, 0)])
        score = first[order] + self.table[padded[:, 0]]
        back = np.zeros((padded.shape[1], n, len(STATES)), np.uint8)
        for t in range(1, padded.shape[1]):
            m = int(np.searchsorted(-tall, -t, "left"))  # blocks with a line t
            options = score[:m, :, None] + self.step
            back[t, :m] = options.argmax(1)
            score[:m] = options.max(1) + self.table[padded[:m, t]]
        states = np.zeros(padded.shape, np.int64)
        at_end = score.argmax(1)
        if last is not None:
            given = np.asarray(last)[order]
            at_end = np.where(given < 0, at_end, given)
        rows = np.arange(n)
        states[rows, tall - 1] = at_end
        for t in range(padded.shape[1] - 1, 0, -1):
            m = int(np.searchsorted(-tall, -t, "left"))
            states[rows[:m], t - 1] = back[t, rows[:m], states[rows[:m], t]]
        out: list = [None] * n
        for i, at in enumerate(order):
            out[at] = states[i, : length[at]]
        return out


def turns_of(lines: list[str], states) -> list[list]:
    """The turns that states give: [begins here, role, lines], markers cut from first lines."""
    turns: list[list] = []
    for line, s in zip(lines, states):
        role, begins = STATES[s]
        if begins or not turns:
            kind, at = marker(line) if begins else ("none", 0)
            turns.append([begins, role, [line[at:] if kind != "other" else line]])
        else:
            turns[-1][2].append(line)
    return turns


def fit(labelled: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_turns: int = MAX_TURNS) -> Model:
    """Count a model from turns whose rows hold their role and their raw text (marker included).

    A turn's first line begins it; turns follow each other by ``turn``, equal numbers by a hash. Other roles than the three,
    and null roles, ids and turns, are skipped. The transcripts of ``max_turns`` turns, those with the least hash of their
    id, are read, each whole; only the sums reach the driver. Without labels all probabilities are even.
    """

    def count(batches):
        for batch in sliced(batches):
            sums: dict[tuple[int, int, int], int] = {}
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = ROLES.index(name)
                lines = (body or "").split("\n")
                for n, line in enumerate(lines):
                    state = 2 * r + (n > 0)
                    for f, value in enumerate(features(line)):
                        k = (f, state, value)
                        sums[k] = sums.get(k, 0) + 1
                for a, b, n in ((0, 1, len(lines) > 1), (1, 1, len(lines) - 2), (0, 2, len(lines) == 1), (1, 2, len(lines) > 1)):
                    if n > 0:
                        k = (9, 2 * r + a, b)
                        sums[k] = sums.get(k, 0) + n
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in sums], pa.int32()) for i in range(3)), pa.array(list(sums.values()), pa.int64())], names=["f", "state", "value", "n"])

    rows = labelled.where(F.col(role).isin(*ROLES) & F.col(key).isNotNull() & F.col(turn).isNotNull()).select(F.col(role).alias("role"), F.col(text).cast("string").alias("text"), F.col(key).alias("key"), F.col(turn).alias("turn"))
    some = rows.select("key", "turn").orderBy(F.xxhash64("key"), "key", "turn").limit(max_turns).select("key").distinct()
    rows = rows.join(F.broadcast(some), "key")  # max_turns ids at most
    emitted = [np.full((len(STATES), len(values)), SMOOTH) for values in FEATURES]
    inner = np.full((len(STATES), 3), SMOOTH)  # by state: ... , goes on, ends
    for f, state, value, n in rows.select("role", "text").mapInArrow(count, "f int, state int, value int, n long").groupBy("f", "state", "value").agg(F.sum("n")).collect():
        (inner if f == 9 else emitted[f])[state, value] += n
    ahead = rows.select("key", "turn", "role", F.xxhash64("text").alias("h")).selectExpr("role", "lag(role) over (partition by key order by turn, h) as before").groupBy("before", "role").count().collect()
    between, first = np.full((3, 3), SMOOTH), np.full(3, SMOOTH)
    for before, name, n in ahead:
        if before is None:
            first[ROLES.index(name)] += n
        else:
            between[ROLES.index(before), ROLES.index(name)] += n
    start, step = np.full(len(STATES), -np.inf), np.full((len(STATES), len(STATES)), -np.inf)
    start[::2] = np.log(first / first.sum())
    between = np.log(between / between.sum(1, keepdims=True))
    for s in range(len(STATES)):
        on, end = np.log(inner[s, 1:] / inner[s, 1:].sum())
        step[s, 2 * (s // 2) + 1] = on
        step[s, ::2] = end + between[s // 2]
    return Model(start, step, [np.log(e / e.sum(1, keepdims=True)) for e in emitted])


PART = "conv_id {0}, block long, sub int, turns array<struct<role:string,text:string>>, matrix binary, alone binary, codes binary, text string"
TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _whole(model: Model, texts: list[list[str]]) -> list[list[dict]]:
    """The turns of whole transcripts of lines."""
    paths = model.paths([codes(lines) for lines in texts]) if texts else []
    return [[{"role": t[1], "text": "\n".join(t[2])} for t in turns_of(lines, states)] for lines, states in zip(texts, paths)]


def _blocks(shared):
    """Over rows (conv_id, block, text, many) in order: transcripts of one block as turns, blocks of others with codes and matrix."""

    def run(batches):
        m, ready, parts, room = shared.value, [], [], BATCH_LINES
        kind, now, lines, sub, many = None, None, [], 0, False

        def part(these):
            c = codes(these)
            parts.append((now[0], now[1], sub, None, m.through(c).tobytes(), m.alone(c).tobytes(), c.tobytes(), "\n".join(these)))

        def close():
            if now is None:
                return
            if many or sub:
                part(lines)
            else:
                ready.append((now, lines))

        def flush():
            turns = _whole(m, [x for _, x in ready])
            rows = [(k[0], k[1], 0, t, None, None, None, None) for (k, _), t in zip(ready, turns)] + parts
            kinds = (kind, pa.int64(), pa.int32(), TURN, pa.binary(), pa.binary(), pa.binary(), pa.string())
            ready.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["conv_id", "block", "sub", "turns", "matrix", "alone", "codes", "text"])

        for batch in sliced(batches):
            kind = batch.schema.field(0).type
            for c, b, body, long in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (c, b) != now:
                    close()
                    now, lines, sub, many = (c, b), [], 0, long
                found = body.split("\n")
                room -= len(found)
                lines = lines + found if lines else found
                while len(lines) > LINES:  # a block of bounded size, whatever its rows
                    part(lines[:LINES])
                    lines, sub = lines[LINES:], sub + 1
                if room <= 0:
                    room = BATCH_LINES
                    yield flush()
        close()
        if ready or parts:
            yield flush()

    return run


def _chained(batches):
    """Over rows (conv_id, block, sub, matrix, alone) in order: each block's state before it (-1: none) and last state."""
    size, now, blocks, back, score, kind = len(STATES), None, [], [], None, None

    def close():
        last = [int(score.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last = last[::-1]
        return pa.RecordBatch.from_arrays([pa.array([now] * len(last), kind), pa.array([b for b, _ in blocks], pa.int64()), pa.array([s for _, s in blocks], pa.int32()), pa.array([-1, *last[:-1]], pa.int32()), pa.array(last, pa.int32())], names=["conv_id", "block", "sub", "entry", "last"])

    for batch in sliced(batches):
        kind = batch.schema.field(0).type
        for c, b, sub, matrix, alone in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if c != now:
                if blocks:
                    yield close()
                now, blocks, back, score = c, [], [], np.frombuffer(alone)
            else:
                options = score[:, None] + np.frombuffer(matrix).reshape(size, size)
                back.append(options.argmax(0).astype(np.uint8))
                score = options.max(0)
            blocks.append((b, sub))
    if blocks:
        yield close()


def _decoded(shared):
    """Over rows (conv_id, block, sub, codes, text, entry, last): the parts of turns in each block."""

    def run(batches):
        m = shared.value
        for batch in sliced(batches, 64):
            c, b, sub, raw, text, entry, last = (batch.column(i).to_pylist() for i in range(7))
            paths = m.paths([np.frombuffer(x, np.uint8) for x in raw], entry, last) if raw else []
            rows = [(c[i], b[i], sub[i], n, int(t[0]), t[1], "\n".join(t[2])) for i in range(len(c)) for n, t in enumerate(turns_of(text[i].split("\n"), paths[i]))]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["conv_id", "block", "sub", "seq", "begins", "role", "text"])

    return run


def parse(df: DataFrame, model: Model, key: str = "conv_id", piece: str = "turn", text: str = "text") -> DataFrame:
    """conv_id, turn_no, role, text, rendered: the turns of transcripts that come in ordered pieces of whole lines.

    ``piece`` orders the rows of a transcript; pieces with equal numbers, repeated ones too, follow each other by text. A
    null text is one empty line. A row without an id or a number has no place in a transcript and is parsed as one of its
    own, with turns from 0. Turns may span pieces and blocks. Empty input gives no rows; other columns are not read. Tasks
    read blocks of bounded size in order, so a transcript may be of any length.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("conv_id"), F.col(piece).cast("long").alias("piece"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("piece") / BLOCK).cast("long"))
    placed = rows.where("conv_id is not null and piece is not null")
    several = placed.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("_id"))
    marked = placed.join(several, F.col("conv_id") == F.col("_id"), "left").select("conv_id", "block", "piece", "text", F.col("_id").isNotNull().alias("many"))
    ordered = marked.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "piece", "text")
    parts = materialize(ordered.select("conv_id", "block", "text", "many").mapInArrow(_blocks(shared), PART.format(kind)), "chat-parts")

    def alone(batches):
        for batch in sliced(batches):
            turns = _whole(shared.value, [body.split("\n") for body in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, TURN)], names=["conv_id", "turns"])

    loose = rows.where("conv_id is null or piece is null").select("conv_id", "text").mapInArrow(alone, f"conv_id {kind}, turns array<struct<role:string,text:string>>")
    short = parts.where("turns is not null").select("conv_id", "turns").unionByName(loose)
    short = short.select("conv_id", F.posexplode("turns").alias("turn_no", "t")).select("conv_id", F.col("turn_no").cast("long").alias("turn_no"), "t.role", "t.text")

    links = parts.where("turns is null")
    ends = links.select("conv_id", "block", "sub", "matrix", "alone").repartition("conv_id").sortWithinPartitions("conv_id", "block", "sub").mapInArrow(_chained, f"conv_id {kind}, block long, sub int, entry int, last int")
    keys = ["conv_id", "block", "sub"]
    pieces = links.select(*keys, "codes", "text").join(ends, keys).select(*keys, "codes", "text", "entry", "last").mapInArrow(_decoded(shared), f"conv_id {kind}, block long, sub int, seq int, begins int, role string, text string")
    pieces = materialize(pieces, "chat-pieces")
    sums = pieces.groupBy(*keys).agg(F.sum("begins").alias("n")).selectExpr(*keys, "sum(n) over (partition by conv_id order by block, sub) - n as base")
    numbered = pieces.join(sums, keys).selectExpr(*keys, "seq", "role", "text", "base + sum(begins) over (partition by conv_id, block, sub order by seq) - 1 as turn_no")
    long = numbered.groupBy("conv_id", "turn_no").agg(F.min("role").alias("role"), F.array_sort(F.collect_list(F.struct("block", "sub", "seq", "text"))).alias("pieces"))
    long = long.select("conv_id", "turn_no", "role", F.array_join(F.transform("pieces", lambda x: x["text"]), "\n").alias("text"))
    return short.unionByName(long).withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("text"), F.lit("\n<|end|>")))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """The conversations as raw transcripts: one marker style a conversation, a fifth of the markers lost; roles kept aside as ``true_role``."""
    style = F.expr("cast(pmod(xxhash64(conv_id), 6) as int)")
    name = F.when(style % 2 == 0, F.col("role")).otherwise(F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "bot").otherwise(F.col("role")))
    forms = F.array(F.concat(F.initcap(name), F.lit(": ")), F.concat(F.lit("### "), F.initcap(name), F.lit(": ")), F.concat(F.lit("["), name, F.lit("] : ")), F.concat(F.lit("**"), F.initcap(name), F.lit("**: ")), F.concat(F.lit("<|"), name, F.lit("|> ")), F.concat(F.upper(name), F.lit("> ")))
    lost = F.expr("pmod(xxhash64(conv_id, turn), 5) = 0")
    return conversations.select("conv_id", "turn", F.concat(F.when(lost, F.lit("")).otherwise(F.coalesce(F.get(forms, style), F.lit(""))), F.coalesce("text", F.lit(""))).alias("text"), F.col("role").alias("true_role"))
