import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from paths import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from causeway.llm import bpe, packing, queries

WORDS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
CHARS = "aabcdeehilmnorstuvxyzABCΣσςİßÀé'’s't 're ll 0129²Ⅷ½ \n\t\r\x1c\x1f\x85\xa0　̈ñ日한😀|<>…—\x00"


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(CHARS), max_size=60), st.sampled_from(["", "<|endoftext|>", "<|startoftext|>x"]))
def test_ids_are_those_of_the_library(text, special):
    text = text + special + text[::-1]
    want = WORDS.encode(text, add_special_tokens=False).ids
    codec = bpe.codec("word_bpe_49k.json")
    assert codec.encode(text) == want and codec.strings(text)[1] == WORDS.decode(want, skip_special_tokens=False) == codec.decode(want)
    assert packing.token_ids(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_the_merge_loop(seed):
    """Against the plain definition of BPE, on random merges."""
    rng = random.Random(seed)
    symbols = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
    merges, known = [], list(symbols)
    while len(merges) < 25:
        a, b = rng.choice([s for s in known if not s.endswith("</w>")]), rng.choice(known)
        if a + b not in known:
            merges.append((a, b))
            known.append(a + b)
    shown = bpe.byte_symbols()
    vocabulary = {s: i for i, s in enumerate([*known, *(c for c in shown if c not in known), *(c + "</w>" for c in shown if c + "</w>" not in known)])}
    automaton = bpe.Automaton(vocabulary, merges)

    def merged(parts):
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    spelled = lambda t: [*t.removesuffix("</w>")[:-1], t.removesuffix("</w>")[-1] + "</w>"] if t.endswith("</w>") else [*t]
    alone = [t for t in known if merged(spelled(t)) == [t]]
    for t in alone:  # the table has an arc exactly where BPE keeps both tokens
        for x in alone:
            if not t.endswith("</w>"):
                assert automaton.has_arc(vocabulary[t], vocabulary[x]) == (merged(spelled(t) + spelled(x)) == [t, x]), (t, x)
    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        parts = [*word[:-1], word[-1] + "</w>"]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        assert [automaton.labels[i] for i in automaton.encode(word)] == parts


def test_token_query(spark):
    rows = {r.doc_id: r for r in queries.op7_bpe_automaton(spark, SMALL).collect()}
    import hashlib

    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        e = WORDS.encode(d.text, add_special_tokens=False)
        assert rows[d.doc_id].n_tokens == len(e.ids) and rows[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(WORDS.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_edges(spark, docs):
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_documents(docs(None, "", " \n", "x" * 30000, "Ab ab")).collect()}
    assert got[0] == got[1] == got[2] == ([], "") and len(got[3][0]) > 100 and got[4][1] == "ab</w> ab</w>"
    assert bpe.encode_documents(docs("a").limit(0)).count() == 0


def test_token_repeats_and_clashes(spark, docs):
    table = docs("Ab ab", "Ab ab", "x" * 5000 + " y", ids=[3, 3, 4]).selectExpr("*", "1 as n_tokens", "'z' as ids")
    rows = bpe.digest_documents(table).collect()
    assert sorted(r.doc_id for r in rows) == [3, 3, 4] and len({r.ids_sha256 for r in rows}) == 2 and bpe.encode_documents(table).columns == ["doc_id", "ids", "decoded"]


def places(rows):
    bins = {}
    for size, lo, hi, first, copies, offset in rows:
        for r in range(lo, hi + 1):
            bins.setdefault(first + (r - lo) // copies, []).append((offset + (r - lo) % copies * size, size))
    return bins


def fewest(sizes, capacity):
    """The least number of bins, by search."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted({*range(len(bins))}, key=lambda b: bins[b]):
            if bins[b] >= sizes[i]:
                go(i + 1, [*bins[:b], bins[b] - sizes[i], *bins[b + 1 :]])
        go(i + 1, [*bins, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_reduction_keeps_an_optimum(sizes):
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing._Plan(counts)
    packing.reduce_by_dominance(plan, 20)
    left = [s for s, n in plan.left.items() for _ in range(n)]
    assert plan.sequences + fewest(left, 20) == fewest(sizes, 20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.sampled_from([50, 64, 100]))
def test_plans_are_gapless(sizes, capacity):
    rows, n, fixed = packing.plan_lengths({s: sizes.count(s) for s in sizes}, capacity)
    bins = places(rows)
    assert sorted(s for b in bins.values() for _, s in b) == sorted(sizes) and set(bins) == set(range(n)) and fixed <= n
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity


def test_packing(spark, docs):
    table = docs("", None, "one two three", "word " * 3000, "one two three", "b" + " b" * 1021, ids=[0, 1, 2, 3, 2, 5])
    rows = packing.pack_documents(table).collect()
    assert sum(r.length for r in rows if r.doc_id == 3) == 3002 - (3002 - len(packing.token_ids("word " * 3000)) - 1) and [r.length for r in rows if r.doc_id in (0, 1)] == [1, 1]
    long = sorted((r for r in rows if r.doc_id == 3), key=lambda r: r.piece)
    ids = np.append(packing.token_ids("word " * 3000), 2).astype("<u4")
    assert [r.length for r in long[1:]] == [1024] * (len(long) - 1) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in long)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in by.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 1024
    assert len(rows) == 5 + len(long) and packing.pack_documents(table.limit(0)).count() == 0


def test_packing_repeats_and_clashes(spark, docs):
    """One id with two texts and a repeated row: every piece has one place."""
    table = docs("one two", "six ten", "one two", ids=[7, 7, 7]).selectExpr("*", "9 as length", "'z' as offset", "1 as salt")
    rows = packing.pack_documents(table).collect()
    assert len(rows) == 3 and len({(r.sequence_id, r.offset) for r in rows}) == 3 and len({r.ids_crc32 for r in rows}) == 2


def test_packing_query(spark):
    rows = queries.op5_best_fit_packing(spark, SMALL).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs) and sum(r.length for r in rows) == sum(len(BYTES.encode(t, add_special_tokens=False).ids) + 1 for t in docs.values())
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 1024) + 3
