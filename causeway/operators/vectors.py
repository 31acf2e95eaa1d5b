"""A stored vector index with exact search (D4, G8, B17 over A3): folders that cannot hold a best vector are not read.

Vectors lie in cells, each by its nearest of some pivots, and in rings of a cell, by their distance from the pivot. For a query
at distance D from a pivot, a vector of a ring with distances low to high is at least d = max(D - high, low - D, 0) away, so its
product with the query is at most (|q|^2 + M^2 - d^2) / 2 where M is the ring's greatest length, and at most
q.pivot + |q| high. A ring is read for a query only if the lesser bound reaches the query's threshold: the k-th best product in
the most promising rings that together hold k vectors. Cells and rings are partition folders, so the others are pruned at
planning, and a filter on stored columns is pushed down to the files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from . import scores as S
from .retrieve import QUERY_BYTES, dot, finite, named

#: Pivots, and rings of a cell: what the driver holds of an index is their product's rows at most.
PIVOTS, RINGS = 64, 8
SLACK = 1e-9


def build(vectors: DataFrame, path: str, pivots: int = PIVOTS, rings: int = RINGS) -> VectorStore:
    """Write ``vectors`` (vec_id, embedding, ...), all of one length, as an index; rows with null or not finite components go.

    Pivots are the vectors with the least hashes of their ids, a bounded sample; every row is stored, whatever the pivots.
    Columns named cell, ring or r are refused.
    """
    spark = vectors.sparkSession
    if {"cell", "ring", "r"} & {c.lower() for c in vectors.columns}:
        raise ValueError("cell, ring and r name the index's own columns")
    good = vectors.where(finite("embedding"))
    chosen = good.select("embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    points = np.array([x[0] for x in chosen], np.float64)
    held = spark.sparkContext.broadcast(points)
    names, at = vectors.columns, vectors.columns.index("embedding")

    def placed(batches):
        for batch in batches:
            flat = batch.column(at)
            rows = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
            far = np.sqrt(np.maximum((rows * rows).sum(1)[:, None] + (held.value * held.value).sum(1) - 2 * rows @ held.value.T, 0))
            cell = far.argmin(1) if far.size else np.zeros(len(flat), np.int64)
            # the distance itself again, without the cancellation of the form above
            r = np.sqrt(((rows - held.value[cell]) ** 2).sum(1)) if far.size else np.zeros(len(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(r)], names=[*names, "cell", "r"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema)
    near = written(good.mapInArrow(placed, f"{schema}, cell int, r double"), "cells")
    cuts = near.groupBy("cell").agg(F.percentile_approx("r", F.array(*(F.lit(i / rings) for i in range(1, rings))), F.lit(1000)).alias("cuts") if rings > 1 else F.array().cast("array<double>").alias("cuts"))
    ringed = near.join(F.broadcast(cuts), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("r")))).drop("cuts")
    ringed = written(ringed, "rings")
    ringed.drop("r").repartitionByRange("cell", "ring", "vec_id").write.mode("overwrite").partitionBy("cell", "ring").parquet(f"{path}/vectors")
    stats = ringed.groupBy("cell", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.max(F.sqrt(dot("embedding", "embedding"))).alias("longest"), F.count("*").alias("n"))
    where = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "cell int, pivot array<double>")
    stats.join(where, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/rings")
    return VectorStore(spark, path, vectors.schema)


class VectorStore:
    """An index that :func:`build` has written; ``schema`` is that of the vectors."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def bounds(self, queries: DataFrame) -> DataFrame:
        """query_id, q, cell, ring, n, bound: the greatest product that a vector of each ring can have with each query."""
        rings = F.broadcast(self.spark.read.parquet(f"{self.path}/rings"))  # PIVOTS x RINGS rows at most
        met = queries.crossJoin(rings).withColumn("qq", dot("q", "q")).withColumn("qp", dot("q", "pivot"))
        met = met.withColumn("away", F.sqrt(F.greatest(F.lit(0.0), F.col("qq") + dot("pivot", "pivot") - 2 * F.col("qp"))))
        least = F.greatest(F.col("away") - F.col("high"), F.col("low") - F.col("away"), F.lit(0.0)) - 1e-6  # distances are rounded
        least = F.greatest(least, F.lit(0.0))
        bound = F.least((F.col("qq") + F.col("longest") * F.col("longest") - least * least) / 2, F.col("qp") + F.sqrt("qq") * F.col("high"), F.sqrt("qq") * F.col("longest"))
        return met.select("query_id", "q", "cell", "ring", "n", (bound + SLACK * (1 + F.sqrt("qq") * F.col("longest"))).alias("bound"))

    def _scored(self, wanted: DataFrame, where: str | None, k: int | None = None) -> DataFrame:
        """query_id, vec_id, score of the vectors in the wanted (query_id, q, cell, ring); other folders are not listed.

        With ``k`` only the best of each task's rows; queries of more than QUERY_BYTES are joined.
        """
        folders = [(r[0], r[1]) for r in wanted.select("cell", "ring").distinct().collect()]  # PIVOTS x RINGS at most
        by_cell: dict[int, list[int]] = {}
        for cell, ring in folders:
            by_cell.setdefault(cell, []).append(ring)
        inside = F.lit(False)
        for cell, rings in sorted(by_cell.items()):
            inside = inside | ((F.col("cell") == cell) & F.col("ring").isin(sorted(rings)))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        rows = self.spark.read.schema(f"{fields}, cell int, ring int").parquet(f"{self.path}/vectors").where(inside)
        rows = rows.where(where) if where else rows
        if k is not None and wanted.select("query_id", F.size("q").alias("n")).distinct().agg(F.coalesce(F.sum(F.col("n") * 8 + 64), F.lit(0))).first()[0] <= QUERY_BYTES:
            return self._best(wanted, rows, k)
        return rows.select("vec_id", "embedding", "cell", "ring").join(wanted.select("query_id", "q", "cell", "ring"), ["cell", "ring"]).where("query_id <> vec_id").select("query_id", "vec_id", dot("embedding", "q").alias("score"))

    def _best(self, wanted: DataFrame, rows: DataFrame, k: int) -> DataFrame:
        """The best ``k`` of each query in a task's rows: all queries that want a folder meet its vectors as matrices."""
        queries, rows, schema = named(wanted.select("query_id", F.col("q").cast("array<double>").alias("q")).distinct(), rows)
        asked = queries.toArrow().combine_chunks()
        if not len(asked):
            return self.spark.createDataFrame([], schema).select("query_id", "vec_id", "score")
        ids = {x: i for i, x in enumerate(asked["query_id"].to_pylist())}
        meant: dict[tuple[int, int], np.ndarray] = {}
        # a row a folder, PIVOTS x RINGS at most, of the queries that want it
        for cell, ring, names in wanted.groupBy("cell", "ring").agg(F.collect_list("query_id")).toLocalIterator():
            meant[cell, ring] = np.array(sorted(ids[x] for x in names), np.int32)
        held = self.spark.sparkContext.broadcast((asked["name"].chunk(0), asked["query_id"].chunk(0), S.matrix(asked["q"]), meant))

        def blocks(batches):
            for batch in batches:
                table, places = pa.Table.from_batches([batch]), np.stack([batch.column(i).to_numpy() for i in (3, 4)], axis=1)
                for cell, ring in np.unique(places, axis=0).tolist() if len(places) else []:
                    here = table.take(pa.array(np.flatnonzero((places == (cell, ring)).all(1))))
                    yield here.select(["name", "vec_id", "ok"]), S.matrix(here["embedding"]), held.value[3].get((cell, ring), np.zeros(0, np.int32))

        def run(batches):
            yield from S.best(*held.value[:3], k, blocks(batches))

        rows = rows.where("name is not null").select("name", "vec_id", F.lit(True).alias("ok"), "cell", "ring", F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(run, schema).select("query_id", "vec_id", "score")

    def wanted(self, queries: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """query_id, q, cell, ring: what a search has to read; the rest cannot hold one of a query's best ``k``."""
        bounds = written(self.bounds(queries), "bounds")
        order = "partition by query_id order by bound desc, cell, ring"
        # one vector more than k: the query's own may be among them
        first = bounds.selectExpr("*", f"sum(n) over ({order} rows between unbounded preceding and 1 preceding) as before").where(F.coalesce(F.col("before"), F.lit(0)) <= k)
        best = self._scored(written(first, "first"), where, k).selectExpr("query_id", "score", "row_number() over (partition by query_id order by score desc) as nth").where(F.col("nth") <= k)
        least = best.where(F.col("nth") == k).select("query_id", F.col("score").alias("least"))
        return bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "q", "cell", "ring")

    def search(self, queries: DataFrame, k: int, where: str | None = None) -> DataFrame:
        """query_id, vec_id, score, rank: the k best other vectors for every query (query_id, q), filtered first; ties by vec_id.

        Queries are a stated set with distinct ids. A query that is null, or of another length, has no result.
        """
        size = self.spark.read.parquet(f"{self.path}/rings").agg(F.max(F.size("pivot"))).first()[0]
        asked = queries.where(finite("q") & (F.size("q") == F.lit(size)) if size else F.lit(False))
        found = self._scored(written(self.wanted(asked, k, where), "wanted"), where, k)
        return found.selectExpr("query_id", "vec_id", "score", "row_number() over (partition by query_id order by score desc, vec_id) as rank").where(F.col("rank") <= k)
