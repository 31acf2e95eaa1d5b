import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import lexicons as L
from causeway.operators import chunk, cluster, gates, graph, retrieve
from causeway.plans import hooks, maps


def counter(*words):
    """An embedder that counts words; a function within one travels to the workers whole."""
    return lambda texts: [[t.lower().count(w) + 0.0 for w in words] for t in texts]


embed = counter("fish", "water", "price")


@pytest.fixture(scope="module")
def passages(spark):
    texts = ["Overfishing reduces fish biomass.", "Warm water increases coral bleaching.", "Fuel price increases fishing cost."]
    rows = [(i, t, f"s{i}", "forum", None if i else "http://x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "vec_id long, text string, source string, source_type string, url string").withColumn("embedding", hooks.embedder(embed)("text"))


def test_vectors_have_unit_length(spark):
    rows = spark.createDataFrame([("fish fish water",), (None,)], "t string").select(hooks.embedder(embed)("t").alias("v")).collect()
    assert sorted(round(float(np.linalg.norm(r.v)), 5) for r in rows) == [0.0, 1.0]


def test_questions_to_maps(spark, passages):
    asked = spark.createDataFrame([(1, "What of overfishing and fish biomass?"), (2, "hello please"), (3, None), (4, "What of warm water?")], "query_id long, question string")
    found = {r.query_id: r for r in maps.ask(asked, passages, embed, k=1).collect()}
    assert [found[i].error for i in (1, 2, 3, 4)] == [None, maps.NO_MEANING, maps.NO_TEXT, None]
    assert found[1].sources == ["s0"] and found[4].sources == ["s1"]
    assert [(e.cause, e.effect, e.polarity) for e in found[1].edges if e.effect == "Fish Biomass"] == [("Overfishing", "Fish Biomass", "-")]
    assert "Overfishing decreases Fish Biomass" in found[1].answer and found[1].negative_edges >= 1
    assert found[2].edges is None and found[2].relation_length == 0 and found[2].answer is None


def test_a_brought_answer_feeds_the_map(spark, passages):
    asked = spark.createDataFrame([(1, "What does pollution do?")], "query_id long, question string")
    (row,) = maps.ask(asked, passages, embed, lambda q, c: "Pollution reduces water quality." if "source type: forum" in c else "", k=3).collect()
    assert row.answer == "Pollution reduces water quality."
    assert ("Water Quality", "-") in [(e.effect, e.polarity) for e in row.edges]


def test_context_and_bundle(spark):
    rows = spark.createDataFrame([(1, 1, "a", "forum", "u", "x" * 2000), (1, 2, None, None, None, "y")], "query_id int, rank int, source string, source_type string, url string, text string")
    assert retrieve.context(rows).first().context == "[1] a  (source type: forum)\nURL: u\n" + "x" * 1100 + "\n\n---\n\n[2] Unknown Source\ny"
    assert retrieve.passages(rows).first().passages == "x" * 2000 + "\n\ny"
    assert spark.range(1).select(retrieve.bundle(F.lit("q"), F.lit("a"), F.lit("")).alias("t")).first().t == "Question: q\n\nAnswer:\na\n\nContext:"


def test_upload_response(spark):
    files = spark.createDataFrame([("a.txt", "txt", "Overfishing reduces fish biomass.", None), ("b.bin", "bin", None, "unsupported type")], "name string, ending string, text string, error string")
    cells = "map_key string, source string, target string, weight double"
    (row,) = maps.upload_response(files, spark.createDataFrame([], cells)).collect()
    assert (row.files_processed, row.files_skipped) == (["a.txt"], ["b.bin"]) and row.negative_edges >= 1 and "1 uploaded file(s)" in row.answer
    (row,) = maps.upload_response(files, spark.createDataFrame([("m.csv", "A", "B", 0.5), ("m.csv", "B", "A", 0.0)], cells)).collect()
    assert [(e.cause, e.effect) for e in row.edges] == [("A", "B")] and row.answer.endswith("1 uploaded matrix.")


def test_sql_functions(spark):
    hooks.register(spark, embed, lambda q, c: q + c)
    text = ("word " * 150 + "\n\n") * 3
    want = [(r.chunk_index, r.text) for r in chunk.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_index").collect()]
    assert [tuple(r) for r in spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("texts") or spark.sql("SELECT c.* FROM texts, LATERAL chunk_text(t) c ORDER BY chunk_index").collect()] == want and len(want) > 1
    row = spark.sql("SELECT ratio('abcd', 'bcde') AS r, ratio(NULL, 'a') AS n, embed('fish') AS v, answer('q', 'c') AS a").first()
    assert (row.r, row.n, row.v, row.a) == (0.75, None, [1.0, 0.0, 0.0], "qc")


def test_similar_members_over_many_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 2), [float(x) for x in rng.normal(size=4)], i % 5 != 0) for i in range(120)] + [(200, 0, None, True), (201, 0, [0.0] * 4, True)]
    df = spark.createDataFrame(rows, "vec_id long, cluster int, embedding array<double>, kept boolean")
    cos = lambda x, y: float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))
    good = [r for r in rows if r[3] and r[2] and any(r[2])]
    want = {(x[0], y[0]): cos(x[2], y[2]) for x in good for y in good if x[1] == y[1] and x[0] < y[0] and cos(x[2], y[2]) >= 0.5}
    for tile in (8, 1024):
        monkeypatch.setattr(cluster, "TILE", tile)
        found = [((r.a, r.b), r.similarity) for r in cluster.similar_within(df, 0.5).collect()]
        assert len(found) == len(want) and dict(found) == pytest.approx(want)


def test_representatives(spark):
    rows = spark.createDataFrame([("m", "a", 0, 0.5), ("m", "b", 0, 1.0), ("m", "d", 1, 0.2), ("m", "c", 1, 0.2)], "map_key string, concept string, module int, importance double")
    assert sorted((r.module, r.concept) for r in graph.representatives(rows).collect()) == [(0, "b"), (1, "c")]


def test_relevance_by_default_lists(spark):
    rows = spark.createDataFrame([(1, "Red snapper season"), (2, "Red snapper gear, for sale"), (3, "gardening")], "id int, text string")
    assert len(L.RELEVANCE) == len(set(L.RELEVANCE)) and [r.id for r in gates.relevant(rows).collect()] == [1]
