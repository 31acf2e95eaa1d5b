import hashlib
import itertools
import random
import re
import zlib

import pytest

from causeway.llm import earley as E

GRAMMAR = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit) of the cheapest repair of rows (role, text), by search of all edits in order of (cost, audit)."""
    import heapq

    seen_before, marks = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        dup = (role, text) in seen_before
        seen_before.add((role, text))
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        marks.append((blank or dup, not blank and not dup and last[-1] not in ".!?"))
    # Dijkstra on (rows read, last initial); nothing here knows of charts
    agenda, done = [(0, "", 0, "", ())], set()
    while agenda:
        cost, audit, at, last, out = heapq.heappop(agenda)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        allowed = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for initial, name in (("u", "user"), ("a", "assistant")):
            if initial in allowed:
                heapq.heappush(agenda, (cost + 2, audit + "I", at, initial, (*out, (name, ""))))
        if at < len(rows):
            (role, text), (condemned, cut) = rows[at], marks[at]
            heapq.heappush(agenda, (cost + 3, audit + "D", at + 1, last, out))
            if not condemned:
                if role[:1] and role[:1] in allowed:
                    heapq.heappush(agenda, (cost + cut, audit + "K", at + 1, role[:1], (*out, (role, text))))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if initial in allowed:
                        heapq.heappush(agenda, (cost + 2 + cut, audit + "R", at + 1, initial, (*out, (name, text))))


def facts(rows):
    """What the contract asks of one conversation's rows (turn, role, text) in order."""
    blank = duplicate = truncated = 0
    seen = set()
    for _, role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        if not ink:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif ink[-1] not in ".!?":
            truncated += 1
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, out = cheapest([r[1:] for r in rows])
    return gaps, blank, duplicate, truncated, wrong, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def in_order(rows):
    mark = lambda r: hashlib.md5(f"{r[1]}\x01{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], mark(r)))


def damage(rows):
    """The damaged rows of (conv, turn, role, text), by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        shown = lambda v: " " if v is None else str(v)
        h = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        here = out.setdefault(conv, [])
        if h == 0:
            continue
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        here += [row] * (2 if h == 3 else 1)
    return {conv: in_order(found) for conv, found in out.items()}


def some_rows(r, n):
    pool = ["Yes.", "No!", "cut", "", " \t", "x?", "Yes. ", "é."]
    roles = ["user", "assistant", "system", "tool", "", " "]
    return [(r.choice(roles[: r.choice([2, 3, 6])]), r.choice([*pool, f"t{r.random():.3f}.", f"t{r.random():.3f}."])) for _ in range(n)]


def test_parse_is_the_cheapest_of_all_repairs():
    r = random.Random(3)
    for _ in range(800):
        rows = some_rows(r, r.randint(0, 9))
        segment = E._Segment(None)
        seen = set()
        for i, (role, text) in enumerate(rows):
            segment.add(i, role, text, 1, (role, text) in seen)
            seen.add((role, text))
        cost, audit, _ = E.best(E.parse(segment.rows))
        want = cheapest(rows)
        assert (cost, audit) == want[:2]
        turns = E.repaired(segment.texts, audit)
        assert tuple(turns) == want[2]
        assert GRAMMAR.fullmatch("".join(t[0][:1] for t in turns))
        # cut anywhere, the matrices of the pieces give the same
        column, at = {E.OPENED: (0, "")}, 0
        while at < len(rows):
            size = r.randint(1, 3)
            column, _ = E.joined(column, {s: E.parse(segment.rows[at : at + size], s) for s in E.SYMBOLS})
            at += size
        assert E.best(column)[:2] == (cost, audit) or not rows


SCHEMA = "conv_id long, turn long, role string, text string"


def compared(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r[0]: tuple(r)[1:] for r in E.repair_conversations(df).collect()}
    want = {conv: facts(found) for conv, found in damage(rows).items()}
    assert got == want
    return got


@pytest.mark.parametrize("seed", [3, 1024])
def test_spark_equals_brute_force(spark, seed):
    """Whole conversations, and long ones in segments, with nulls, ties of turns, repeated rows and gaps."""
    r = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.choice([1, 2, 5, 9, 40])):
            for role, text in some_rows(r, r.choice([1, 1, 1, 2])):
                rows.append((conv, None if r.random() < 0.08 else turn + (turn > 4) * 3, None if r.random() < 0.05 else role, None if r.random() < 0.05 else text))
    rows += r.sample(rows, 30)
    compared(spark, rows)


def test_one_conversation_over_many_tasks(spark):
    """A hot conversation is parsed in segments by many tasks; half of its turns have no number, many repeat."""
    r = random.Random(9)
    rows = [(7, None if r.random() < 0.2 else i // 2, *some_rows(r, 1)[0]) for i in range(6000)] + [(c, t, "user", "A.") for c in (1, 8) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = compared(spark, rows, 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got[7][6]) > 5000


def test_empty_and_clashing(spark):
    assert E.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    names = ["key", "dated", "mark", "times", "later", "k", "m", "matrix", "begin", "edits", "first", "h", "copy"]
    df = spark.createDataFrame([(5, 1, "user", "x" * 300_000 + ".", *range(len(names)))], SCHEMA + "".join(f", {n} long" for n in names))
    assert [tuple(r)[:7] for r in E.repair_conversations(df).collect()] == [(5, *facts(damage([(5, 1, "user", "x" * 300_000 + ".")])[5])[:6])]


def test_turns(spark):
    rows = [(1, 0, "user", "A."), (1, 1, "user", "B."), (1, 1, "user", "B."), (2, 3, "assistant", "C.")]
    got = sorted(map(tuple, E.repair_turns(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("conv_id", "key")).collect()))
    assert got == [(1, 0, "user", "A."), (1, 1, "assistant", "B."), (2, 0, "user", ""), (2, 1, "assistant", "C.")]
