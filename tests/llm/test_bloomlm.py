import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import bloomlm as B
from causeway.llm import wordhash as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return [*WORD.findall((text or "").translate(ASCII)), "\n"]


def test_words_are_those_of_the_pattern():
    r = random.Random(1)
    texts = ["", None, " ", "a", "A  b\x0bc\x1cd e É é Z", "x" * 3000 + " y", " wide"] + ["".join(r.choices("aAb \n\té　", k=r.randint(0, 60))) for _ in range(300)]
    for piece in (3, 1 << 20):
        W.PIECE, old = piece, W.PIECE
        try:
            hashes, counts = W.words(pa.array(["skipped", *[t or "" for t in texts]])[1:])
        finally:
            W.PIECE = old
        flat = [w for t in texts for w in tokens(t)[:-1]]
        assert counts.tolist() == [len(tokens(t)) - 1 for t in texts]
        named = {}
        assert all(named.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist()))
        assert len(set(named.values())) == len(named)


def test_filter_never_reads_too_little():
    r = np.random.default_rng(2)
    keys = np.unique(r.integers(0, 2**63, 40_000).astype(np.uint64))
    counts = np.minimum(r.zipf(1.6, len(keys)), 10**9)
    held = B.Filter.of([B.filled(keys[B.segment_of(keys, 5) == s], counts[B.segment_of(keys, 5) == s]).tobytes() for s in range(5)])
    found = held.levels(keys)
    assert (found >= B.levels_of(counts)).all()
    assert (found == B.levels_of(counts)).mean() > 0.95
    assert (held.levels(r.integers(2**63, 2**64 - 1, 40_000, dtype=np.uint64)) > 0).mean() < 0.04
    assert len(held.data) * 8 <= B.levels_of(counts).sum() * B.BITS + 5 * 64
    assert B.levels_of(np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 12])).tolist() == [0, 1, 2, 3, 4, 4, 5, 5, 6, 7]
    assert all(abs(B.MEANT[B.levels_of(np.array([c]))[0]] - c) <= 0.25 * c for c in range(1, 5000))


def some_docs(docs, n=160):
    r = random.Random(4)
    pool = [f"w{int(r.paretovariate(0.7))}" for _ in range(3000)]
    texts = [" ".join(r.choice([w, w.upper()]) for w in r.choices(pool, k=r.randint(0, 60))) for _ in range(n)]
    texts += ["the same text " * 40, "the same text " * 40, None, "", "q" * 200_000, "É é"]
    ids = [*range(len(texts) - 2), 3, None]
    return docs(*texts, ids=ids), list(zip(ids, texts))


def by_row(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("frequent", [2_000_000, 40, 0])
def test_base_and_counts_are_exact(docs, frequent):
    df, rows = some_docs(docs)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(t for i, text in rows if not out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = by_row((i, out(i), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows)
    got = B.score_documents(df, frequent=frequent).collect()
    assert by_row((*r[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_are_those_of_the_formula(docs, monkeypatch):
    """P(w|v) is the stated one: exactly with a filter so roomy that nothing is found falsely, nearly with the usual one."""
    _, rows = some_docs(docs)
    singles, pairs = collections.Counter(), collections.Counter()
    for _, text in rows:
        ts = tokens(text)
        singles.update(ts)
        pairs.update(zip(["\n", *ts], ts))
    meant = lambda c: float(B.MEANT[B.levels_of(np.array([c]))[0]])
    size = sum(singles.values()) + len(singles) + 1

    def score(text):
        ts = tokens(text)
        return sum(math.log10((min(meant(pairs[v, w]), meant(singles[v]), meant(singles[w])) + B.MU * (meant(singles[w]) + 1) / size) / (meant(singles[v]) + B.MU)) for v, w in zip(["\n", *ts], ts))

    column = pa.array([t or "" for _, t in rows])
    flat, counts = B.tokens_of(column)
    before = np.append(B.END, flat[:-1])
    keys, times = np.unique(np.concatenate([B.word_keys(flat), B.pair_keys(before, flat)]), return_counts=True)
    scorer = B._Scorer(sum(singles.values()), len(singles), np.zeros(0, np.uint64), np.zeros(0, np.int64), True, B.MU)
    want = np.array([score(t) for _, t in rows])
    for bits, off in ((128, 1e-9), (B.BITS, 0.05)):
        monkeypatch.setattr(B, "BITS", bits)
        got = scorer.rows(flat, counts, B.Filter.of([B.filled(keys, times).tobytes()]).levels)
        assert got[0].tolist() == [len(tokens(t)) for _, t in rows]
        assert (np.abs(got[3] - want) / got[0]).mean() < off


def test_probes_sent_to_segments_give_the_same(spark, docs, monkeypatch):
    df, _ = some_docs(docs)
    monkeypatch.setattr(B, "SEGMENT_TOKENS", 400)
    model = B.fit(df.where("doc_id % 3 <> 0"))
    assert model.count > 10
    direct = by_row(map(tuple, B.score(df, model).collect()))
    assert by_row(map(tuple, B.score(df.repartition(5), model, broadcast_bytes=0).collect())) == direct
    few = by_row(map(tuple, B.score(df, model, broadcast_bytes=0, frequent=30).collect()))
    assert all(a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-6 for a, b in zip(few, direct))


def test_a_segment_looks_up_many_blocks_at_once(spark, docs, monkeypatch):
    """A look-up a block of each segment took most of the time of a filter of many segments: their number grows with both."""
    keys = np.unique(np.random.default_rng(6).integers(0, 2**63, 3000).astype(np.uint64))
    data = B.filled(keys, np.arange(1, len(keys) + 1)).tobytes()
    asked = [keys[i % 7 :: 7] for i in range(40)]
    calls, levels = [], B.Filter.levels
    monkeypatch.setattr(B.Filter, "levels", lambda self, k: calls.append(len(k)) or levels(self, k))
    asks = pa.table({"segment": pa.array([0] * 40, pa.int32()), "block": list(range(40)), "keys": pa.array([k.tobytes() for k in asked], pa.binary())})
    for most, times in ((B.LOOKED_UP, 1), (1000, 20)):
        monkeypatch.setattr(B, "LOOKED_UP", most)
        calls.clear()
        got = B._answers(asks, pa.table({"data": pa.array([data], pa.binary())}))
        assert len(calls) <= times and got.column("block").to_pylist() == list(range(40))
        assert got.column("levels").to_pylist() == [levels(B.Filter.of([data]), k).tobytes() for k in asked]


def test_model_prefers_held_out_copies_of_the_language(docs):
    r = random.Random(8)
    follow = {f"w{i}": [f"w{r.randrange(60)}" for _ in range(3)] for i in range(60)}

    def said(n):
        w = "w0"
        for _ in range(n):
            yield w
            w = r.choice(follow[w])

    texts = [" ".join(said(80)) for _ in range(150)]
    got = B.score_documents(docs(*texts)).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_empty_tables_and_clashing_names(spark, docs):
    assert B.score_documents(docs()).collect() == []
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = B.score_documents(docs("a b", "", None, ids=only)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0.0, 0.0)] * 2 + [(3, 0, 0, 0.0, 0.0)]
    names = ["key", "row", "word", "words", "n", "times", "segment", "block", "score", "held_out", "more", "met"]
    df = spark.createDataFrame([(next(i for i in range(99) if i not in only and zlib.crc32(str(i).encode()) % 7 != 2), "a b a", *names)], "doc_id long, text string" + "".join(f", {n} string" for n in names))
    assert B.score_documents(df, frequent=0).select("n_tokens", "n_known").collect() == [(4, 4)]
