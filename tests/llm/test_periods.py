import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.llm import periods as P


def brute(w, least=12):
    """Every run, by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i += i == start
    return sorted((s, e - s, q) for (s, e), q in found.items())


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.integers(0, k), max_size=90)), st.sampled_from([9, 12, 15]))
def test_runs_of_few_words(words, least):
    assert P.runs(words, least) == brute(words, least)


def test_runs_of_planted_periods():
    r = random.Random(5)
    for _ in range(400):
        words = [r.randrange(r.choice([2, 6, 60])) for _ in range(r.randint(10, 260))]
        for _ in range(r.randint(1, 3)):
            a = r.randrange(len(words))
            p = 1 + r.randrange(max(1, (len(words) - a) // 2))
            for i in range(a, r.randint(a, len(words))):
                words[i] = words[a + (i - a) % p]
        assert P.runs(words) == brute(words)


def test_every_period_has_a_scale():
    scales = [2**k for k in range(1, 12)]
    for q in range(1, 4000):
        (b,) = [b for b in scales if P.distances(b)[0] <= q <= P.distances(b)[1]]
        assert max(9, 2 * q) - q >= 2 * b - 1  # an aligned block and its copy fit
    with pytest.raises(ValueError):
        P.runs([1] * 20, 8)


def test_long_texts_of_one_period():
    """Time and memory follow the words, whatever the period."""
    for period in (1, 2, 17, 9000):
        assert P.runs([i % period for i in range(60_000)]) == [(0, 60_000, period)]


def want(doc_id, text):
    """The contract's row, step by step."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1]
    facts = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *facts, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_digest_equals_brute_force(spark, docs):
    r = random.Random(2)
    words = ["a", "b", "é", "x.", "y z", "c"]
    texts = [" ".join(r.choices(words, k=r.randint(0, 160))) for _ in range(120)]
    texts += [None, "", " \t\n", "one", "ab\x0bab " * 9, "w " * 2000, "w " * 2000, " ".join(f"v{i}" for i in range(3000))]
    ids = [*range(len(texts) - 2), 3, None]
    rows = [(*row, 7) for row in zip(ids, texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs_sha256 long")
    got = sorted(map(tuple, P.digest_documents(df).collect()), key=str)
    assert got == sorted((want(i, t) for i, t in zip(ids, texts)), key=str)
    assert sum(r[1] > 0 for r in got) > 5
    assert P.digest_documents(df.limit(0)).collect() == []


def test_find_and_collapse(spark):
    text = "start " + "spam and eggs " * 5 + "end"
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k"), (2, None, "k")], "doc_id long, text string, work string")
    assert sorted((r.doc_id, [tuple(x) for x in r.runs]) for r in P.find(df).collect()) == [(1, [(1, 15, 3)]), (2, []), (2, [])]
    out = P.collapse(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "start spam and eggs end", "k"), (2, "", "k"), (2, "", "k")]
    assert P.collapse(df, into="clean").columns == [*df.columns, "clean"]
