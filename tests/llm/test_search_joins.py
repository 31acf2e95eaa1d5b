import random

import numpy as np
import pandas as pd
import pytest
from paths import SMALL

from causeway.llm import jaccard, queries, topk


def brute_classes(texts: dict) -> dict:
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed: int) -> dict:
    """Chains of edited copies, a passage and a line that many texts share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, line = [word() for _ in range(55)], [word() for _ in range(8)]
    texts = {}
    for g in range(25):
        base = [word() for _ in range(rng.choice([5, 6, 9, 20, 45, 130, 400]))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            now = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                now[rng.randrange(len(now))] = word()
            if rng.random() < 0.3:
                base = now
            if rng.random() < 0.3:
                now = now + passage
            if rng.random() < 0.3:
                now = line + now
            texts[rng.randrange(10**6)] = rng.choice([" ", "\n", "\t "]).join(now)
    texts |= {-1: None, -2: "", -3: " \n", -4: "one two", -5: "ONE  two", -6: "one two three"}
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_classes_against_brute_force(spark, seed):
    texts = near_copies(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()}
    assert got == brute_classes(texts)
    if not seed:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, broadcast_ids=0).collect()} == got


def test_frequent_lists_never_change_the_result(spark, monkeypatch):
    texts = near_copies(9)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    few = {r.doc_id: r.component_id for r in jaccard.classes(df).collect()}
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    none = {r.doc_id: r.component_id for r in jaccard.classes(df).collect()}
    assert few == none == {d: c for d, (_, c) in brute_classes(texts).items()}


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    no = jaccard.Frequent(np.empty(0, np.uint64))
    for size in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 20, 31, 32, 40, 64, 90, 128, 129, 200, 255, 256, 500, 1023, 1024, 3000):
        for _ in range(200 if size < 64 else 20):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, size // 7 + 1))
            add = int(rng.integers(0, max(2, size // 5)))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if 4 * same >= 3 * (len(a) + len(b) - same):
                assert set(np.concatenate(jaccard.signatures(a, no)).tolist()) & set(np.concatenate(jaccard.signatures(b, no)).tolist())
                assert jaccard.close(jaccard.sketch_of(a), jaccard.sketch_of(b), len(a), len(b))


def test_sets_in_few_partitions_share_a_signature(monkeypatch):
    """Sets whose features crowd in few partitions, so that no equal subset of them need hold any, still meet."""
    rng, no = np.random.default_rng(3), jaccard.Frequent(np.empty(0, np.uint64))
    met = 0
    for _ in range(3000):
        size = int(rng.integers(3, 48))
        ends = rng.integers(0, 1 << 63, 2).astype(np.uint64) * np.uint64(2)
        base = np.unique((ends[rng.integers(0, 2, size)] >> np.uint64(58) << np.uint64(58)) + (rng.integers(0, 4, size).astype(np.uint64) << np.uint64(33)) + rng.integers(0, 1 << 20, size).astype(np.uint64))
        more = np.unique(np.concatenate([rng.permutation(base)[int(rng.integers(0, 3)) :], (base[:1] >> np.uint64(34) << np.uint64(34)) + rng.integers(0, 1 << 20, int(rng.integers(0, 4))).astype(np.uint64)]))
        same = len(np.intersect1d(base, more))
        if 4 * same >= 3 * (len(base) + len(more) - same):
            met += 1
            assert set(np.concatenate(jaccard.signatures(base, no)).tolist()) & set(np.concatenate(jaccard.signatures(more, no)).tolist())
    assert met > 500


def test_small_sets_enumerate_subsets():
    """A set of a small band signs every two of its k + 2 partitions that hold a feature."""
    features = np.sort(np.random.default_rng(8).integers(1, 1 << 63, 7).astype(np.uint64))
    own = jaccard._pairs(3, jaccard.SIMILAR)
    assert own.shape == (6, 4) and (own.sum(1) == 2).all() and 3 <= len(np.concatenate(jaccard.signatures(features, jaccard.Frequent(np.empty(0, np.uint64)))))


def test_classes_of_long_texts_and_clashing_columns(spark):
    """Two near copies of 30,000 words, repeated rows, and columns named as the operator's own."""
    words = [f"w{i * 7919 % 30011}" for i in range(30_000)]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join(["new", *words[:-9]])), (2, " ".join(["new", *words[:-9]])), (3, " ".join(words[:15_000]))]
    df = spark.createDataFrame([(*r, 5, "s", 0) for r in rows], "doc_id long, text string, node int, sig string, component_id int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect())
    assert got == [(0, 29_996, None), (1, 29_996, 1), (2, 29_988, 1), (2, 29_988, 1), (3, 14_996, 3)]
    assert jaccard.one_of_each(df).columns == df.columns


def test_one_of_each(spark, docs):
    text = " ".join(f"w{i}" for i in range(40))
    table = docs(text, text + " end", "other words here", None, "other words here", ids=[4, 2, 7, 8, 7])
    assert sorted(r.doc_id for r in jaccard.one_of_each(table).collect()) == [2, 7, 8]
    assert jaccard.one_of_each(table).columns == table.columns and jaccard.classes(table.limit(0)).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {(r.node, r.comp) for r in jaccard.components(chain).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def brute_top(rows: dict, k: int = 10) -> dict:
    whole = {i: [int(np.floor(1024 * float(x))) for x in v] for i, v in rows.items() if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for q in whole:
        if q % 100 == 0:
            scores = sorted(((sum(a * b for a, b in zip(whole[q], v)), -i) for i, v in whole.items() if i != q), reverse=True)[:k]
            out.update({(q, n + 1): (-i, s) for n, (s, i) in enumerate(scores)})
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows.items()], "vec_id long, embedding array<float>, score string")


@pytest.mark.parametrize("kind", ["plain", "skewed", "ties"])
def test_top_k_against_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 6)).astype(np.float32)
    if kind == "skewed":
        v *= np.exp(rng.normal(size=(700, 1)) * 2).astype(np.float32)
    if kind == "ties":
        v = np.round(v)
    rows = {i: [float(x) for x in r] for i, r in enumerate(v)}
    rows |= {1000: None, 1001: [1.0, None], 1002: [float("nan")] * 6, 1100: [0.0] * 6, 1200: []}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame(spark, rows), bucket_rows=100, query_rows=3).collect()}
    assert got == brute_top(rows)


def test_top_k_few_and_large(spark):
    rows = {0: [3e30, 1.0], 5: [2e30, -1.0], 100: [1.0, 1.0]}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame(spark, rows)).collect()}
    assert got[(0, 1)] == (5, topk.LONG) and len(got) == 4 and topk.top_k(frame(spark, rows).limit(0)).count() == 0


def test_top_k_repeats(spark):
    """Repeated ids are one query and candidates each; the seeds' thresholds lose nothing."""
    rng = np.random.default_rng(12)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in [*range(300), 7, 7, 100]]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), bucket_rows=40).collect()
    whole = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    for q in (0, 200):
        best = sorted((-sum(a * b for a, b in zip(whole[q][1], v)), i) for i, v in whole if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == best
    assert sum(r.query_id == 100 for r in got) == 10


def test_coordinate_pruning_is_used_and_exact():
    rng = np.random.default_rng(6)
    v = np.floor(1000 * np.eye(8)[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 8)) * 30)
    norms, ids = np.sqrt((v * v).sum(1)), np.arange(4000)
    q = v[:3].copy()
    exact = v @ q.T
    floors = np.sort(exact, 0)[-10]
    found = topk.search_bucket(ids, v, norms, np.array([-1, -2, -3]), q, np.sqrt((q * q).sum(1)), floors, 10)
    for n, query in enumerate((-1, -2, -3)):
        want = sorted(((-int(exact[i, n]), i) for i in ids))[:10]
        assert [(-s, i) for a, i, s in found if a == query] == [(s, int(i)) for s, i in want]


def test_top_k_query(spark, duck, same):
    assert same(queries.op4_norm_bucket_topk(spark, SMALL), duck.sql(topk.TOP_K_SQL)) == 50


def test_class_query(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_partenum_jaccard(spark, SMALL).collect()}
    assert got == brute_classes(docs) and isinstance(pd.Series(got), pd.Series)


def test_known_components_are_joined_not_made_again(spark):
    """New edges move the components that they join, and edges within components cost one written table and no round."""

    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    rng = np.random.default_rng(5)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (220, 2))]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = jaccard.components(table(edges[:120]))
    whole = {(r.node, r.comp) for r in jaccard.components(table(edges)).collect()}
    assert {(r.node, r.comp) for r in jaccard.components(table(edges[120:]), known).collect()} == whole
    assert {(r.node, r.comp) for r in jaccard.components(table(edges), jaccard.components(table([]))).collect()} == whole
    before = jobs()
    again = jaccard.components(table(edges[:60]), known)
    assert jobs() - before <= 6 and again is known


def test_near_copies_without_candidates_run_few_jobs(spark):
    """Texts that share no signature: nothing is compared, labelled or counted in jobs of its own."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(20)], "doc_id long, text string")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert jaccard.one_of_each(docs).count() == 20
    assert jobs() - before <= 55
