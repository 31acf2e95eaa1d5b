import numpy as np
import pyarrow as pa
import pytest

from causeway.operators import retrieve as V
from causeway.operators import scores as S


def in_order(q, v):
    total = 0.0
    for a, b in zip(q, v):  # sum() of Python adds with a compensation
        total += a * b
    return total


def plain(queries, vectors, k):
    """The rule itself, a pair at a time."""
    out = []
    for name, q in queries:
        found = [(-in_order(q, v), i) for i, v in vectors if i != name]
        out += [(name, nth + 1, i, -s) for nth, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def many():
    r = np.random.default_rng(5)
    points = r.normal(size=(700, 8)).astype(np.float32).astype(float)
    points[300:520] = points[7]  # many copies: ties go by id, and their scores are equal wherever they lie
    points[600:] = np.round(points[600:])
    return [(int(i), p.tolist()) for i, p in enumerate(points)]


@pytest.mark.parametrize("bytes_", [V.QUERY_BYTES, 4000])
def test_matrices_choose_what_pairs_do(spark, many, monkeypatch, bytes_):
    for name, value in (("QUERIES", 7), ("VECTORS", 32), ("AGAIN", 50)):
        monkeypatch.setattr(S, name, value)
    monkeypatch.setattr(V, "QUERY_BYTES", bytes_)
    asked = many[::20]
    df = spark.createDataFrame(many, "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    for k in (1, 9, 800):
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in V.nearest(queries, df, k).collect()) == plain(asked, many, k)
    found = V.nearest(queries, df, 4)
    assert "MapInArrow" in (shown := found._jdf.queryExecution().toString()) or "CoGroupedArrow" in shown or "FlatMapCoGroupsInArrow" in shown


def test_blocks_keep_the_best_of_each_query(many):
    ids = pa.array([i for i, _ in many])
    points, asked = np.array([p for _, p in many]), list(range(0, 700, 50))
    best = S.Best(ids.take(pa.array(asked)), points[asked], 5)
    best.room = 40
    for at in range(0, 700, 60):
        rows = pa.table({"name": ids.slice(at, 60), "vec_id": ids.slice(at, 60), "ok": pa.array([True] * len(ids.slice(at, 60)))})
        best.add(rows, points[at : at + 60])
    got = best.rows().to_pylist()
    assert sorted((asked[x["q"]], x["vec_id"], x["score"]) for x in got) == sorted((q, i, s) for q, _, i, s in plain([many[i] for i in asked], many, 5))


def test_odd_vectors_rank_as_before(spark):
    """Nulls last, NaN first, other lengths null, as the pairs' own order has them."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [1.0]), (5, None), (6, [0.5, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(6, [1.0, 0.0]), (9, None), (None, [1.0, 0.0])], "query_id long, q array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in V.nearest(queries, df, 9).collect())
    assert got == [(6, 1, 3), (6, 2, 1), (6, 3, 2), (6, 4, 4), (9, 1, 1), (9, 2, 2), (9, 3, 3), (9, 4, 4), (9, 5, 6)]


def test_bundles_take_their_passages_from_matrices(spark, many):
    from causeway.plans import maps

    df = spark.createDataFrame([(i, p, f"passage {i}") for i, p in many], "vec_id long, embedding array<double>, text string")
    asked = [many[7], many[333]]
    queries = spark.createDataFrame([(i, p, f"q{i}") for i, p in asked], "query_id long, q array<double>, question string")
    chunks = maps.question_chunks(queries, df, 3)
    assert "MapInArrow" in chunks._jdf.queryExecution().toString()
    want = {q: [i for n, _, i, _ in plain(asked, many, 3) if n == q] for q, _ in asked}
    assert {r.map_key: r.text for r in chunks.collect()} == {q: f"Question: q{q}\n\nAnswer:\n\n\nContext:\n" + "\n\n".join(f"passage {i}" for i in found) for q, found in want.items()}


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e9])
def test_single_precision_only_chooses(scale):
    """Scores that differ far below single precision rank by doubles, of vectors too long for it and of tiny ones too."""
    r = np.random.default_rng(9)
    points = scale * (r.normal(size=8) + 1e-9 * r.normal(size=(400, 8)))
    many = list(enumerate(points.tolist()))
    ids, asked = pa.array(range(400)), [3, 77, 250]
    best = S.Best(ids.take(pa.array(asked)), points[asked], 5)
    assert (best.single is None) == (scale == 1e9)
    for at in range(0, 400, 90):
        best.add(pa.table({"name": ids.slice(at, 90), "vec_id": ids.slice(at, 90)}), points[at : at + 90])
    got = best.rows().to_pylist()
    assert sorted((asked[x["q"]], x["vec_id"], x["score"]) for x in got) == sorted((q, i, s) for q, _, i, s in plain([many[i] for i in asked], many, 5))


def test_vectors_are_not_read_for_each_partition_of_queries(spark, many):
    """Without a table small enough for Spark's own broadcast, as of large tables, no product of partitions is planned."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for odd in ([], [(9_000, [1.0]), (9_001, None)]):
            df = spark.createDataFrame([*many, *odd], "vec_id long, embedding array<double>")
            found = V.nearest(spark.createDataFrame([*many[::100], *odd], "query_id long, q array<double>"), df, 3)
            assert "CartesianProduct" not in found._jdf.queryExecution().toString() and found.where("query_id < 9000").count() == 21
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
