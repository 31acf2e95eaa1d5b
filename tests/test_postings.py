import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import index as I
from causeway.operators import postings as P
from causeway.operators import retrieve as V

DOC = "doc_id long, text string"


@pytest.fixture
def corpus():
    r = random.Random(5)
    pool = [f"wörd{int(r.paretovariate(0.9))}" for _ in range(800)] + ["x", "é", "Ünd", "a_b", "不好"]
    rows = [(i, ", ".join(r.choices(pool, k=r.randint(0, 50)))) for i in range(500)]
    return [*rows, (500, None), (501, ""), (502, "x"), (503, "wörd3 wörd3"), (7, "wörd1 once more"), *((600 + i, rows[3][1]) for i in range(9)), (None, "wörd2 wörd1")]


@pytest.fixture
def small(monkeypatch):
    """Many packs, many parts, few sums at once."""
    for name, value in (("PACK", 3000), ("DOCS", 40), ("ASKED", 2000)):
        monkeypatch.setattr(P, name, value)
    monkeypatch.setattr(V, "SUMS", 700)
    monkeypatch.setattr(V, "PRODUCTS", 50)


def test_weights_of_packs_are_those_of_rows(spark, corpus, small):
    """No gram is a row of the plan."""
    docs = spark.createDataFrame(corpus, DOC).repartition(3)
    whole = docs.where("doc_id is not null")
    got = V.document_weights(whole, ("wörd3",))
    assert "gram" not in got._jdf.queryExecution().analyzed().toString().replace("grams", "")
    shown = lambda df: {r.doc_id: (r.grams, round(r.norm, 9), round(r.total, 9), round(r.top, 9)) for r in df.collect()}
    want = shown(V.tfidf_rows(V.grams(whole, ("wörd3",))))
    assert shown(got) == want and len(want) > 480
    packs = V.packed(whole)
    assert packs.count() > 10 and packs.agg(F.sum("n_docs")).first()[0] == V.with_grams(whole)
    assert shown(V.document_weights(docs, ("wörd3",))).keys() == want.keys()


def test_search_of_packs_is_that_of_rows(spark, corpus, small):
    docs, r = spark.createDataFrame(corpus, DOC).where("doc_id is not null"), random.Random(6)
    asked = [(i, " ".join((t or "").split(", ")[: r.randint(1, 9)])) for i, t in corpus[:40]] + [(1000, "nowhere seen"), (1001, ""), (1002, "WÖRD1"), (1003, corpus[3][1]), (1004, None)]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    shown = lambda df: sorted((x.query_id, x["rank"], x.doc_id, round(x.score, 9)) for x in df.collect())
    for k in (1, 5):
        want = shown(V.search(V.grams(docs, ("wörd3",)), queries, k, ("wörd3",)))
        assert shown(V.search_documents(docs, queries, k, ("wörd3",))) == want and len(want) > 30
    assert V.search_documents(docs.limit(0), queries).collect() == [] == V.search_documents(docs, queries.limit(0)).collect()


def test_equal_hashes_are_told_apart():
    a, b = np.array([5, 5, 1, 5, 1], np.uint64), np.array([2, 1, 7, 2, 7], np.uint16)
    order, begins = P._grouped(a, b)
    assert [sorted(x.tolist()) for x in np.split(order, begins[1:])] == [[2, 4], [1], [0, 3]]
    place, at = P.found(a[[1, 2, 0]], np.array([1, 7, 9], np.uint16), np.array([1, 5, 5], np.uint64), np.array([7, 1, 2], np.uint16))
    assert sorted(zip(place.tolist(), at.tolist())) == [(0, 1), (1, 0)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_an_index_holds_words_and_rounded_weights(spark, tmp_path, corpus, small, monkeypatch, kind):
    """Parts held a row a gram; weights of blocks only bound, in several rounds, and ids of any type."""
    for name, value in (("ROUND", 2000), ("TASK", 2000), ("HOT", 30), ("BLOCK", 8)):
        monkeypatch.setattr(I, name, value)
    docs = spark.createDataFrame(corpus, DOC).where("doc_id is not null and text <> 'wörd1 once more'").withColumn("doc_id", F.col("doc_id").cast(kind))
    queries = spark.createDataFrame([(i, (t or "")[:60]) for i, t in corpus[:20]], "query_id long, text string")
    index = I.Index(spark, f"file://{tmp_path}/i").append(docs)
    counts, shown = V.grams(docs), lambda df: sorted((x.query_id, x["rank"], str(x.doc_id), round(x.score, 9)) for x in df.collect())
    assert shown(index.search(queries, 3)) == shown(V.search(counts, queries, 3)) != []
    assert "gram" not in spark.read.parquet(str(tmp_path / "i/counts/0")).columns
    held = index._table("blocks").select("gram", F.explode(F.arrays_zip("docs", "weights")).alias("p")).select("gram", F.col("p.docs").alias("doc_id"), F.col("p.weights").alias("bound"))
    both = V.tfidf(counts).join(held, ["gram", "doc_id"], "full")
    assert both.where(f"not coalesce(bound >= weight and bound * {1 - I.ROUGH} <= weight, false)").count() == 0
