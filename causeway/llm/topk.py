"""Exact top-k inner products by norm-bucketed retrieval (after Teflioudi, Gemulla and Mykytiuk, 2015).

Vectors are grouped by length into buckets of bounded size. A query's k-th best score in the longest buckets is its first
threshold. For each bucket the threshold gives a local one on the cosine: above 1 the bucket holds nothing; otherwise
the task takes coordinate pruning where a focus coordinate leaves few vectors, and length pruning (a prefix of the
vectors, longest first) where it does not. Inner products of all that is left are computed exactly.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced

SCALE = 1024
BUCKET_ROWS, QUERY_ROWS = 16_384, 32_768
#: Buckets that give the first thresholds, and the least rows of a bucket: smaller tables are spread over the cores.
SEEDS, LEAST_ROWS = 4, 1024
EXACT = 1 << 53
LONG = (1 << 63) - 1


def scaled(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (floor(1024 * x) of all components as float64 bytes), norm. Null vectors, and null or non-finite components, take no part."""

    def run(batches):
        for batch in sliced(batches, 5000):
            ids, out, norms = [], [], []
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if row is None or any(x is None for x in row):
                    continue
                x = np.array(row, np.float64)
                if np.isfinite(x).all():
                    v = np.floor(SCALE * x)
                    ids.append(i)
                    out.append(v.tobytes())
                    norms.append(float(np.sqrt((v * v).sum())) if len(v) else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm"])

    return df.select(F.col(key).cast("long").alias("vec_id"), vector).where("vec_id is not null").mapInArrow(run, "vec_id long, v binary, norm double")


def _matrix(rows, dims: int = 0) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    found = [np.frombuffer(r, np.float64) for r in rows]
    dims = max([dims, *map(len, found)])
    out = np.zeros((len(found), dims))
    for i, x in enumerate(found):
        out[i, : len(x)] = x
    return out


def _products(v: np.ndarray, q: np.ndarray, exact: bool):
    """Integer inner products of rows of ``v`` with rows of ``q``; whole numbers beyond a long are cut to its range."""
    if exact:
        return (v @ q.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in v], object).reshape(v.shape)
    other = np.array([[int(x) for x in row] for row in q], object).reshape(q.shape)
    return np.array([[max(-LONG - 1, min(LONG, sum(a * b for a, b in zip(x, y)))) for y in other] for x in whole], object).reshape(len(v), len(q)).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search_bucket(ids: np.ndarray, v: np.ndarray, norms: np.ndarray, query_ids: np.ndarray, q: np.ndarray, query_norms: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in one bucket that reach its threshold ``floors`` (-inf: none)."""
    order = np.argsort(-norms, kind="stable")
    ids, v, norms = ids[order], v[order], norms[order]
    top = float(norms[0]) if len(norms) else 0.0
    exact = v.shape[1] * max(1.0, float(np.abs(v).max(initial=0))) * max(1.0, float(np.abs(q).max(initial=0))) < EXACT
    unit = v / np.maximum(norms, 1e-300)[:, None]
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out, by_length = [], []

    def give(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        keep = (ids[at] != query_ids[i]) & (scores >= floors[i])
        at, scores = at[keep], scores[keep]
        for j in _best(ids[at], scores, k):
            out.append((int(query_ids[i]), int(ids[at[j]]), int(scores[j])))

    for i in range(len(q)):
        if floors[i] <= 0 or query_norms[i] <= 0 or not math.isfinite(floors[i]):
            by_length.append((len(ids), i))
            continue
        least = floors[i] / query_norms[i] * (1 - 1e-9)  # vectors shorter than this cannot reach the threshold
        prefix = int(np.searchsorted(-norms, -least, side="right"))
        if not prefix or top < least:
            continue
        t = min(1.0, least / top)
        focus = np.argsort(-np.abs(q[i]))[:3]
        at = None
        for c in focus:  # feasible region of a focus coordinate at the local cosine threshold
            x = q[i, c] / query_norms[i]
            slack = math.sqrt(max(0.0, (1 - t * t) * (1 - x * x))) + 1e-9
            low, high = x * t - slack if x * t - slack > -1 else -2, x * t + slack if x * t + slack < 1 else 2
            if x >= t:
                high = 2.0
            if -x >= t:
                low = -2.0
            if c not in lists:
                by = np.argsort(unit[:, c], kind="stable")
                lists[c] = (by, unit[by, c])
            by, values = lists[c]
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            if b - a < 0.2 * prefix and (at is None or b - a < len(at)):
                at = by[a:b]
        if at is None:
            by_length.append((prefix, i))
        elif len(at):
            at = np.sort(at[at < prefix])
            give(i, at, _products(v[at], q[i : i + 1], exact)[:, 0])
    by_length.sort()
    for start in range(0, len(by_length), 128):
        part = by_length[start : start + 128]
        n, rows = part[-1][0], [i for _, i in part]
        scores = _products(v[:n], q[rows], exact)
        for column, (prefix, i) in enumerate(part):
            give(i, np.arange(prefix), scores[:prefix, column])
    return out


def top_k(df: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding", bucket_rows: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of every row whose id ``every`` divides, the k highest integer inner products.

    All rows but the query's own are candidates; ties go to smaller ids. Vectors of unequal dimensions are compared as if
    the shorter ended in zeros. Null vectors, ids and components take no part; an empty table has no rows; other columns
    are not read. Ids are taken to be distinct: repeated ones are candidates each, but not of each other, and the queries
    among them are one query with their lists together. Tasks hold one bucket and one block of queries, both of bounded
    size (``bucket_rows``, by default from the rows and cores, BUCKET_ROWS at most).
    """
    vectors = materialize(scaled(df, key, vector), "vectors").withColumn("level", F.floor(F.log2(F.col("norm") + 1) * 4).cast("int"))
    counts = {r[0]: (r[1], r[2]) for r in vectors.groupBy("level").agg(F.count("*"), F.max("norm")).collect()}  # some hundred levels at most
    spark = df.sparkSession
    if bucket_rows is None:
        total = sum(n for n, _ in counts.values())
        bucket_rows = max(LEAST_ROWS, min(BUCKET_ROWS, total // (2 * spark.sparkContext.defaultParallelism)))
    splits = {level: -(-n // bucket_rows) for level, (n, _) in counts.items()}
    table = spark.createDataFrame([(level, s) for level, s in splits.items()] or [(0, 1)], "level int, splits int")
    placed = vectors.join(F.broadcast(table), "level").withColumn("split", F.expr("cast(pmod(xxhash64(vec_id), splits) as int)")).drop("splits")
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("qnorm"))
    blocks = max(1, -(-queries.count() // query_rows))
    queries = queries.withColumn("block", F.expr(f"cast(pmod(xxhash64(query_id, 1), {blocks}) as int)"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    out = "query_id long, vec_id long, score long"

    def pruned(keys_of):
        def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
            v, q = _matrix(left["v"]), _matrix(right["q"])
            dims = max(v.shape[1], q.shape[1])
            v, q = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (v, q))
            floors = right["floor"].to_numpy(float) if keys_of else np.full(len(right), -np.inf)
            found = search_bucket(left["vec_id"].to_numpy(np.int64), v, left["norm"].to_numpy(float), right["query_id"].to_numpy(np.int64), q, right["qnorm"].to_numpy(float), floors, k)
            return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

        return run

    by_length = sorted(counts, key=lambda level: -counts[level][1])
    seeds = [(level, part) for level in by_length[:SEEDS] for part in range(splits[level])][:SEEDS]
    chosen = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(part).alias("split")) for level, part in seeds)) if seeds else F.array().cast("array<struct<level:int,split:int>>")
    seed = placed.where(F.array_contains(chosen, F.struct("level", "split"))).withColumn("block", all_blocks)
    asked = queries.crossJoin(F.broadcast(spark.createDataFrame(seeds or [(0, 0)], "level int, split int")))  # SEEDS rows
    first = seed.groupBy("level", "split", "block").cogroup(asked.groupBy("level", "split", "block")).applyInPandas(pruned(False), out)
    nth = first.selectExpr("query_id", "score", "row_number() over (partition by query_id order by score desc) as nth").where(F.col("nth") == k)
    floors = materialize(nth.select("query_id", F.col("score").cast("double").alias("floor")), "floors")
    queries = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    levels = F.from_json(F.lit(json.dumps([{"level": level, "splits": n, "longest": counts[level][1]} for level, n in splits.items()])), "array<struct<level:int,splits:int,longest:double>>")
    reached = F.filter(levels, lambda x: (F.col("floor") <= 0) | (F.col("qnorm") * x["longest"] * (1 + 1e-9) >= F.col("floor")))
    sent = queries.withColumn("x", F.explode(reached)).select("*", F.col("x.level").alias("level"), F.explode(F.sequence(F.lit(0), F.col("x.splits") - 1)).alias("split")).drop("x")
    keys = ["level", "split", "block"]
    found = placed.withColumn("block", all_blocks).groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(pruned(True), out)
    ranked = found.selectExpr("query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.where(F.col("rank") <= k)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""
