import numpy as np
import pytest

from causeway.operators import retrieve as V
from causeway.operators import vectors as X

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16)) * 4
    points = np.array([centres[i % 12] + r.normal(size=16) * 0.4 for i in range(1500)])
    points /= np.linalg.norm(points, axis=1)[:, None] / r.uniform(0.9, 1.1, (1500, 1))
    rows = [(i, p.astype(np.float32).tolist(), i % 5) for i, p in enumerate(points)]
    rows += [(2000 + i, rows[i][1], 9) for i in range(40)] + [(3000, [0.0] * 16, 1), (3001, None, 1), (3002, [float("nan")] * 16, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted((x.query_id, x["rank"], x.vec_id, round(x.score, 6)) for x in df.collect())


def test_search_equals_a_scan_and_reads_less(spark, clustered, tmp_path):
    store = X.build(clustered, f"file://{tmp_path}/v", pivots=48, rings=4)
    good = clustered.where("vec_id < 3001")
    queries = good.where("vec_id % 97 = 0 or vec_id = 3000").selectExpr("vec_id as query_id", "embedding as q")
    for k, where in ((1, None), (5, None), (5, "label = 2"), (3000, "label = 9")):
        assert rows(store.search(queries, k, where)) == rows(V.nearest(queries, good, k, where)) != []
    near = queries.where("query_id < 3000")
    share = store.wanted(near, 5).join(spark.read.parquet(f"file://{tmp_path}/v/rings"), ["cell", "ring"]).agg({"n": "sum"}).first()[0] / (near.count() * good.count())
    assert share < 0.35
    plan = store._scored(store.wanted(near.limit(1), 1), "label = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(label,2)" in plan


def test_few_rows_ties_and_odd_queries(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 1)], SCHEMA)
    store = X.build(few, f"file://{tmp_path}/few")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (50, [0.5, 2.0]), (51, None), (52, [1.0])], "query_id long, q array<double>")
    got = rows(store.search(queries, 2))
    assert got == [(1, 1, 2, 1.0), (1, 2, 4, 1.0), (50, 1, 3, 2.0), (50, 2, 1, 0.5)]
    empty = X.build(few.limit(0), f"file://{tmp_path}/none")
    assert empty.search(queries, 2).collect() == []
    with pytest.raises(ValueError, match="own columns"):
        X.build(few.withColumnRenamed("label", "cell"), f"file://{tmp_path}/x")
