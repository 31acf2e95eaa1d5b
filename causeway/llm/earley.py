"""Repair of the role structure of conversations by error-correcting Earley parsing (operator 12).

The grammar of roles, with productions for errors, is left-linear; a symbol derives a beginning of the conversation:

    Opened   -> eps | Opened deleted
    Briefed  -> Opened s | Briefed deleted
    Asked    -> (Opened | Briefed | Answered) (u | reroled | inserted) | Asked deleted
    Answered -> Asked (a | reroled | inserted) | Answered deleted
    a conversation is Opened or Answered

A chart item is a dotted production with its origin; it retains its least (cost, audit), the audit being the initials of the
edits so far (Keep, Rerole, Delete, Insert), compared as ASCII. That is exact: audits of the same rows that begin alike differ
in cost or go on to differ, because an audit fixes its own cost, so the lesser of two equal-cost items stays the lesser
whatever follows. All items begin at the first column, so a column needs only the one before it.

Conversations are dealt to tasks by ranges of (conversation, turn, ...), so one that holds a third of all rows is spread over
many. A task parses what it has in segments of at most SEGMENT rows; the segments of a conversation that may go on in another
task are parsed once from each symbol, which gives a matrix of least (cost, audit) from symbol to symbol. The matrices of a
conversation are joined in order, its best path names the symbol at which every segment begins, and the segments repair their
own rows. One digest of a whole conversation, as the contract has it, can only be fed in order: that last step streams.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a segment; characters of one are bounded too.
SEGMENT, SEGMENT_CHARS = 1024, 4 << 20

SYMBOLS = OPENED, BRIEFED, ASKED, ANSWERED = range(4)
ACCEPTED = (OPENED, ANSWERED)
#: (symbol, symbol before, terminal, cost, initial of the edit)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
PRODUCTIONS = [
    (BRIEFED, OPENED, "s", 0, KEEP),
    *((ASKED, before, terminal, cost, edit) for before in (OPENED, BRIEFED, ANSWERED) for terminal, cost, edit in (("u", 0, KEEP), ("any", 2, REROLE), ("", 2, INSERT))),
    *((ANSWERED, ASKED, terminal, cost, edit) for terminal, cost, edit in (("a", 0, KEEP), ("any", 2, REROLE), ("", 2, INSERT))),
    *((symbol, symbol, "deleted", 3, DELETE) for symbol in SYMBOLS),
]
_BY_BEFORE = [[p for p in PRODUCTIONS if p[1] == before] for before in SYMBOLS]
ROLE = {ASKED: "user", ANSWERED: "assistant"}
WORDLESS = re.compile(r"[\x20\x09-\x0D]*")


def _completed(items: dict) -> dict:
    """The completed items of a column, with those that inserted turns complete; cheapest first, so each is settled once."""
    agenda = [(cost, audit, symbol) for symbol, (cost, audit) in items.items()]
    heapq.heapify(agenda)
    done: dict = {}
    while agenda:
        cost, audit, symbol = heapq.heappop(agenda)
        if symbol in done:
            continue
        done[symbol] = (cost, audit)
        for after, _, terminal, more, edit in _BY_BEFORE[symbol]:
            if terminal == "" and after not in done:
                heapq.heappush(agenda, (cost + more, audit + edit, after))
    return done


def _scanned(done: dict, initial: str, condemned: bool, truncated: bool) -> dict:
    """The items that one row completes: dotted productions before a terminal that the row matches move over it."""
    items: dict = {}
    for symbol, (cost, audit) in done.items():
        for after, _, terminal, more, edit in _BY_BEFORE[symbol]:
            if terminal == "" or condemned and terminal != "deleted" or terminal in ("s", "u", "a") and terminal != initial:
                continue
            item = (cost + more + (truncated and terminal != "deleted"), audit + edit)
            if after not in items or item < items[after]:
                items[after] = item
    return items


def parse(rows, begin: int = OPENED) -> dict:
    """{symbol: (cost, audit)} after ``rows`` of (initial of the role, must be deleted, truncated), from the symbol ``begin``.

    Turns inserted after the last row are among the edits; before a later segment, :func:`joined` drops paths they double.
    """
    column = _completed({begin: (0, "")})
    for initial, condemned, truncated in rows:
        column = _completed(_scanned(column, initial, condemned, truncated))
    return column


def joined(column: dict, matrix: dict) -> tuple[dict, dict]:
    """The items after a segment whose ``matrix`` has {begin: {end: (cost, audit)}}, and each end's best beginning."""
    items, origin = {}, {}
    for begin, (cost, audit) in column.items():
        for end, (more, edits) in matrix[begin].items():
            item = (cost + more, audit + edits)
            if end not in items or item < items[end]:
                items[end], origin[end] = item, begin
    return items, origin


def repaired(rows, audit: str, begin: int = OPENED) -> list[tuple[str, str]]:
    """(role, text) of the turns that the edits ``audit`` leave of ``rows`` of (role, text)."""
    out, symbol, at = [], begin, 0
    for edit in audit:
        if edit == DELETE:
            at += 1
            continue
        if edit == INSERT:
            symbol = ANSWERED if symbol == ASKED else ASKED
            out.append((ROLE[symbol], ""))
            continue
        role, text = rows[at]
        at += 1
        if edit == KEEP and role[:1] == "s":
            symbol = BRIEFED
        else:
            symbol = ANSWERED if symbol == ASKED else ASKED
        out.append((role if edit == KEEP else ROLE[symbol], text))
    return out


def best(column: dict) -> tuple[int, str, int]:
    """(cost, audit, symbol) of the cheapest completed conversation, ties to the least audit."""
    return min((*column[symbol], symbol) for symbol in ACCEPTED if symbol in column)


def truncated_text(text: str) -> bool:
    """Is the last character that is not white space none of '.', '!' and '?'? (A blank text has none.)"""
    left = text.rstrip("\x20\t\n\v\f\r")
    return bool(left) and left[-1] not in ".!?"


# --- Spark ---------------------------------------------------------------------------------------------------------------


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turn, role, text of the contract's damaged rows: the crc32 of ``key:turn`` decides; nulls are one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), shown(role).alias("role"), shown(text).alias("text"), (F.crc32(F.concat(shown(key), F.lit(":"), shown(turn))) % 20).alias("h"))
    rows = rows.where("h <> 0").withColumn("text", F.expr(r"case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '') else text end")).withColumn("role", F.expr("if(h = 4, 'user', role)"))
    return rows.withColumn("copy", F.explode(F.expr("if(h = 3, array(0, 1), array(0))"))).drop("h", "copy")


PLACE = ["dated", "turn", "role", "mark"]


def _marked(rows: DataFrame) -> DataFrame:
    """key, PLACE, text, times, later of rows (key, turn, role, text): equal rows of a turn counted together.

    ``later``: role and text were seen in an earlier turn. Copies cost one row a turn; only what a conversation really repeats
    is joined back. PLACE is a total order of a conversation's rows: by turn (nulls first), role, and md5 of role and text.
    """
    counted = rows.groupBy("key", "turn", "role", "text").agg(F.count("*").alias("times"))
    counted = counted.withColumns({"dated": F.col("turn").isNotNull(), "mark": F.md5(F.concat_ws("\x01", "role", "text"))})
    place = F.struct("dated", "turn")
    firsts = counted.groupBy("key", "mark").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1").select(F.col("key").alias("k"), F.col("mark").alias("m"), "first")
    met = counted.join(firsts, F.col("key").eqNullSafe(F.col("k")) & (F.col("mark") == F.col("m")), "left")
    return met.select("key", *PLACE, "text", "times", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))


class _Segment:
    """Consecutive rows of one conversation and what has to be known of them."""

    def __init__(self, place):
        self.place, self.rows, self.texts, self.chars = place, [], [], 0
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn, role, text, times, later):
        initial = role[:1]
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        blank = WORDLESS.fullmatch(text) is not None
        cut = not blank and not later and truncated_text(text)
        if blank:
            self.blank += times
        else:
            self.duplicate += times if later else times - 1
            self.truncated += cut
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += illegal(self.last_initial, initial)
        self.illegal += (times - 1) * illegal(initial, initial)
        self.last_initial = initial
        self.rows.append((initial, blank or later, cut))
        self.texts.append((role, text))
        for _ in range(times - 1):
            self.rows.append((initial, True, False))
            self.texts.append((role, ""))  # it goes
        self.chars += len(text)

    def full(self) -> bool:
        return len(self.rows) >= SEGMENT or self.chars >= SEGMENT_CHARS

    def row(self, key, whole: bool) -> tuple:
        facts = (self.first_turn, self.last_turn, self.turns, self.blank, self.duplicate, self.truncated, self.illegal)
        if whole:
            cost, audit, _ = best(parse(self.rows))
            digest = hashlib.sha256()
            _fed(digest, repaired(self.texts, audit), False)
            return (key, *self.place, *facts, None, None, None, None, None, cost, audit, digest.hexdigest())
        matrix = [{"begin": b, "end": e, "cost": c, "audit": audit} for b in SYMBOLS for e, (c, audit) in parse(self.rows, b).items()]
        return (key, *self.place, *facts, self.first_initial, self.last_initial, matrix, [r for r, _ in self.texts], [t for _, t in self.texts], None, None, None)


def illegal(before: str, after: str) -> bool:
    """May no turn with the initial ``after`` follow one with ``before``?"""
    return before + after not in ("su", "ua", "au")


def _fed(digest, turns, begun: bool) -> bool:
    for role, text in turns:
        digest.update((("\n" if begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        begun = True
    return begun


_PLACE = "dated boolean, turn long, role string, mark string"
_FACTS = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long"
_RESULT = "cost long, audit string, repaired_sha256 string"
_SEGMENTS = f"{_PLACE}, {_FACTS}, first_initial string, last_initial string, matrix array<struct<begin:int,end:int,cost:long,audit:string>>, roles array<string>, texts array<string>, {_RESULT}"


def _out(rows: list, schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _rows_of(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))


def _schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _grouped(stream, schema, work, bound: int = 500):
    """Record batches of the rows that ``work`` yields from a stream of rows."""
    held, chars = [], 0
    for row in work(stream):
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str)) + sum(len(t) for v in row if isinstance(v, list) for t in v if isinstance(t, str))
        if len(held) >= bound or chars >= SEGMENT_CHARS:
            yield _out(held, schema)
            held, chars = [], 0
    yield _out(held, schema)


def _segments(stream):
    """Rows of _SEGMENTS from sorted rows (key, PLACE, text, times, later) of a range of conversations.

    The first and last conversation may go on in other tasks; others of one segment are finished here.
    """
    segment, key, first_key, begun = None, None, True, False
    for k, dated, turn, role, mark, text, times, later in stream:
        if segment is not None and (k != key or segment.full()):
            yield segment.row(key, k != key and not first_key and not begun)
            begun, first_key = k == key, first_key and k == key
            segment = None
        if segment is None:
            segment, key = _Segment((dated, turn, role, mark)), k
        segment.add(turn, role, text, times, later)
    if segment is not None:
        yield segment.row(key, False)


def _paths(stream):
    """(key, PLACE, begin, edits, facts, cost, audit) a segment, facts and audit with a conversation's last, from its sorted segments."""

    def closed(key, facts, first_turn, last_turn, column, back, places):
        cost, audit, symbol = best(column)
        chosen = []
        for origin, matrix in reversed(back):
            before = origin[symbol]
            chosen.append((before, matrix[before][symbol][1]))
            symbol = before
        for nth, (place, (begin, edits)) in enumerate(zip(places, reversed(chosen))):
            last = nth + 1 == len(places)
            yield (key, *place, begin, edits, *((first_turn, last_turn, *facts) if last else [None] * 7), cost if last else None, audit if last else None)

    key, places, started = None, [], False
    for k, dated, turn, role, mark, first, last, turns, blank, duplicate, truncated, wrong, initial, final, matrix in stream:
        if started and k != key:
            yield from closed(key, facts, first_turn, last_turn, column, back, places)
            started = False
        if not started:
            key, started, places, back, facts = k, True, [], [], [0, 0, 0, 0, 0]
            first_turn = last_turn = before = None
            column = {OPENED: (0, "")}
        table: dict = {symbol: {} for symbol in SYMBOLS}
        for cell in matrix:
            table[cell["begin"]][cell["end"]] = (cell["cost"], cell["audit"])
        column, origin = joined(column, table)
        back.append((origin, table))
        places.append((dated, turn, role, mark))
        if first is not None:
            turns -= first == last_turn
            first_turn, last_turn = first if first_turn is None else first_turn, last
        wrong += before is not None and illegal(before, initial)
        facts = [x + y for x, y in zip(facts, (turns, blank, duplicate, truncated, wrong))]
        before = final
    if started:
        yield from closed(key, facts, first_turn, last_turn, column, back, places)


def _digests(stream):
    """(key, digest) of every conversation, from its sorted segments (key, begin, edits, roles, texts); nothing is held."""
    key, digest, begun = None, None, False
    for k, begin, edits, roles, texts in stream:
        if digest is not None and k != key:
            yield key, digest.hexdigest()
            digest = None
        if digest is None:
            key, digest, begun = k, hashlib.sha256(), False
        begun = _fed(digest, repaired([*zip(roles, texts)], edits, begin), begun)
    if digest is not None:
        yield key, digest.hexdigest()


def _mapped(df: DataFrame, work, ddl: str) -> DataFrame:
    """``work`` over the rows of every partition, in their order."""
    kind = df.schema["key"].dataType.simpleString()
    ddl = f"key {kind}, {ddl}"
    schema = _schema(df.sparkSession, ddl)
    return df.mapInArrow(lambda batches: _grouped(_rows_of(batches), schema, work), ddl)


RESULT = "gaps", "blank", "duplicate", "truncated", "illegal", "cost"


def repair(rows: DataFrame) -> DataFrame:
    """conversation facts, cheapest repair and its digest of rows (key, turn, role, text): a row a key that has rows.

    key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Nulls are one space in role and text; rows
    without a key are one conversation, those without a turn come first; rows of one turn are in order of role, then of md5.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("key", F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"))
    order = ["key", *PLACE]
    dealt = _marked(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = materialize(_mapped(dealt, _segments, _SEGMENTS), "segments")
    facts = [c.split()[0] for c in _FACTS.split(", ")]
    parts = segments.where("matrix is not null")
    narrow = parts.select(*order, *facts, "first_initial", "last_initial", "matrix").repartition("key").sortWithinPartitions(*order)
    paths = materialize(_mapped(narrow, _paths, f"{_PLACE}, begin int, edits string, {_FACTS}, cost long, audit string"), "paths")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in order]
    with_texts = parts.alias("s").join(paths.alias("p"), same).select(*(F.col(f"s.{c}") for c in order), "p.begin", "p.edits", "s.roles", "s.texts")
    with_texts = with_texts.repartition("key").sortWithinPartitions(*order).select("key", "begin", "edits", "roles", "texts")
    digests = _mapped(with_texts, _digests, "repaired_sha256 string").select(F.col("key").alias("k"), "repaired_sha256")
    long = paths.where("audit is not null").join(digests, F.col("key").eqNullSafe(F.col("k"))).select("key", *facts, "cost", "audit", "repaired_sha256")
    both = segments.where("matrix is null").select(*long.columns).unionByName(long)
    return both.select("key", F.coalesce(F.expr("last_turn - first_turn + 1 - turns"), F.lit(0)).alias("gaps"), *RESULT[1:], "audit", "repaired_sha256")


def repair_turns(rows: DataFrame) -> DataFrame:
    """The repaired turns themselves: key, position (from 0), role, text of rows (key, turn, role, text).

    A whole conversation is one group here; :func:`repair` has no such bound.
    """
    import pandas as pd

    kind = rows.schema["key"].dataType.simpleString()

    def fixed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(PLACE, na_position="first")
        segment = _Segment(None)
        for turn, role, text, times, later in zip(group.turn, group.role, group.text, group.times, group.later):
            segment.add(None if pd.isna(turn) else turn, role, text, times, later)
        turns = repaired(segment.texts, best(parse(segment.rows))[1])
        return pd.DataFrame([(group.key.iloc[0], i, r, t) for i, (r, t) in enumerate(turns)], columns=["key", "position", "role", "text"])

    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    marked = _marked(rows.select("key", F.col("turn").cast("long").alias("turn"), shown("role"), shown("text")))
    return marked.groupBy("key").applyInPandas(fixed, f"key {kind}, position long, role string, text string")


def repair_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The contract's result: one row for every key of ``df``, whose rows are damaged first (:func:`damaged`).

    A key without rows after damage has zeros, an empty audit and the digest of nothing. A null key is a key. Repeated rows are
    duplicates of each other; columns beside the four are not read; an empty table gives no rows.
    """
    every = df.select(F.col(key).alias("conv_id")).distinct()
    found = repair(damaged(df, key, turn, role, text))
    nothing = hashlib.sha256().hexdigest()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("key")), "left").select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in RESULT), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
