"""Clusters of retrieved passages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieve import dot


def distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def assign(vectors: DataFrame, k: int | None = None, seed: int = 42, threshold: float = 0.7) -> DataFrame:
    """vec_id, embedding, cluster, relationship (1 - distance / largest point-centroid distance), kept.

    ``k`` is by default half the rows, at most three. Centroids are the k means of Spark's own algorithm.
    """
    n = vectors.count()
    k = k or min(3, max(1, n // 2))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double")))))
    return relationship(vectors, centroids(vectors.sparkSession, model), threshold)


def centroids(spark, model) -> DataFrame:
    """cluster, centre of a fitted model (k rows)."""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")


def relationship(vectors: DataFrame, centres: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Nearest centre of each vector and 1 - d / (the largest distance of any vector from any centre)."""
    far = vectors.crossJoin(F.broadcast(centres)).withColumn("d", distance("embedding", "centre"))  # k centres, bounded
    top = far.agg((F.max("d") + 1e-6).alias("top"))
    near = far.groupBy("vec_id").agg(F.min(F.struct("d", "cluster")).alias("m"), F.first("embedding").alias("embedding"))
    return near.crossJoin(F.broadcast(top)).select("vec_id", "embedding", F.col("m.cluster").alias("cluster"), (1 - F.col("m.d") / F.col("top")).alias("relationship")).withColumn("kept", F.col("relationship") >= threshold)


#: Members of a cluster in one tile; two tiles are compared in one task.
TILE = 1024


def similar_within(assigned: DataFrame, threshold: float = 0.7, top: int | None = None) -> DataFrame:
    """Pairs of kept members of a cluster with cosine from ``threshold``, strongest first.

    Members are dealt by hash to tiles of about TILE rows, and every two tiles of a cluster are multiplied in one task: a
    large cluster is spread over all of them, and only pairs above the threshold leave a task. Null vectors have no pairs.
    """
    kept = assigned.where("kept and embedding is not null").select("cluster", "vec_id", "embedding")
    tiles = kept.groupBy("cluster").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = kept.join(tiles, "cluster").selectExpr("*", "cast(pmod(xxhash64(vec_id), tiles) as int) as mine").withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)")))
    rows = rows.selectExpr("cluster", "least(mine, with) as tile", "greatest(mine, with) as other", "mine", "vec_id", "embedding")

    def unit(group: pd.DataFrame) -> np.ndarray:
        x = np.array(group["embedding"].tolist(), np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        same = group["tile"].iloc[0] == group["other"].iloc[0]
        left = group[group["mine"] == group["tile"]]
        right = left if same else group[group["mine"] == group["other"]]
        if left.empty or right.empty:
            return pd.DataFrame({"cluster": [], "a": [], "b": [], "similarity": []})
        cosines = unit(left) @ unit(right).T
        i, j = np.nonzero(cosines >= threshold)
        a, b, s = left["vec_id"].to_numpy()[i], right["vec_id"].to_numpy()[j], cosines[i, j]
        once = a < b if same else a != b
        a, b, s = a[once], b[once], s[once]
        return pd.DataFrame({"cluster": group["cluster"].iloc[0], "a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": s})

    kind = {f.name: f.dataType.simpleString() for f in assigned.schema}
    pairs = rows.groupBy("cluster", "tile", "other").applyInPandas(compare, f"cluster {kind['cluster']}, a {kind['vec_id']}, b {kind['vec_id']}, similarity double")
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(top) if top else pairs


def _name(cluster):
    return F.concat(F.lit("cluster_"), F.col(cluster).cast("string"))


def _member(vec_id):
    return F.concat(F.lit("m_"), F.col(vec_id).cast("string"))


def map_nodes(assigned: DataFrame, passages: DataFrame) -> DataFrame:
    """Id, label, cluster, rag_score and relationship_score of kept members; ``passages`` has vec_id, source, score."""
    nodes = assigned.where("kept").select("vec_id", "cluster", "relationship").join(passages.select("vec_id", "source", "score"), "vec_id")
    return nodes.select(_member("vec_id").alias("id"), F.col("source").alias("label"), _name("cluster").alias("cluster"), F.col("score").alias("rag_score"), F.col("relationship").alias("relationship_score"))


def map_edges(assigned: DataFrame, passages: DataFrame, threshold: float = 0.7, top: int | None = None) -> DataFrame:
    """source_id, target_id, source, target, weight, cluster of similar members; the one nearer to the centre is the source."""
    member = assigned.where("kept").select("vec_id", "relationship").join(passages.select("vec_id", "source"), "vec_id")
    end = lambda c: member.select(F.col("vec_id").alias(c), F.struct((-F.col("relationship")).alias("far"), F.col("vec_id").alias("vec_id"), "source").alias(f"{c}_end"))
    pairs = similar_within(assigned, threshold, top).join(end("a"), "a").join(end("b"), "b").withColumns({"s": F.least("a_end", "b_end"), "t": F.greatest("a_end", "b_end")})
    return pairs.select(_member("s.vec_id").alias("source_id"), _member("t.vec_id").alias("target_id"), F.col("s.source").alias("source"), F.col("t.source").alias("target"), F.col("similarity").alias("weight"), _name("cluster").alias("cluster"))


def summaries(assigned: DataFrame, passages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Cluster, size, primary_topic (of the member nearest to the centre) and relation_lines of clusters with kept members."""
    kept = assigned.where("kept").select("vec_id", "cluster", "relationship").join(passages.select("vec_id", "text"), "vec_id")
    found = kept.groupBy("cluster").agg(F.count("*").alias("size"), F.min_by("text", F.struct((-F.col("relationship")).alias("far"), "vec_id")).alias("text"))
    out = found.select(_name("cluster").alias("cluster"), "size", T.topic_label("text").alias("primary_topic"))
    if edges is None:
        return out.withColumn("relation_lines", F.lit(0).cast("long"))
    lines = edges.groupBy("cluster").agg(F.count("*").alias("relation_lines"))
    return out.join(lines, "cluster", "left").withColumn("relation_lines", F.coalesce("relation_lines", F.lit(0)))


# The colours of the clusters, and of others.
CLUSTER_COLOURS = {"cluster_0": "#056F73", "cluster_1": "#27A798", "cluster_2": "#013056", "cluster_3": "#F4F7F6"}
OTHER_COLOUR = "#056F73"
# End of the fixed values.


def points(assigned: DataFrame, passages: DataFrame, places: DataFrame) -> DataFrame:
    """Id, x, y, text, source, cluster, color, relationship_score of kept members; ``places`` (vec_id, x, y) as from :func:`project`."""
    rows = assigned.where("kept").select("vec_id", _name("cluster").alias("cluster")).join(passages.select("vec_id", "text", "source", "score"), "vec_id").join(places.select("vec_id", "x", "y"), "vec_id")
    colour = F.coalesce(F.create_map(*[F.lit(v) for pair in CLUSTER_COLOURS.items() for v in pair])[F.col("cluster")], F.lit(OTHER_COLOUR))
    text = F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 100), F.lit("..."))
    return rows.select(_member("vec_id").alias("id"), "x", "y", text.alias("text"), "source", "cluster", colour.alias("color"), F.col("score").alias("relationship_score"))


def lines(edges: DataFrame, points_: DataFrame) -> DataFrame:
    """x0, y0, x1, y1, weight, source, target, cluster of the edges both of whose ends are points."""
    one = points_.select(F.col("id").alias("source_id"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    two = points_.select(F.col("id").alias("target_id"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return edges.join(one, "source_id").join(two, "target_id").select("x0", "y0", "x1", "y1", "weight", "source", "target", "cluster")


def tallies(assigned: DataFrame) -> DataFrame:
    """Members and kept members by cluster."""
    return assigned.groupBy("cluster").agg(F.count("*").alias("members"), F.count_if("kept").alias("kept"))


def proximity(centres: DataFrame) -> DataFrame:
    """1 - distance / (2 |c_i|) of every ordered pair of centres."""
    one = centres.select(F.col("cluster").alias("i"), F.col("centre").alias("ci"))
    two = centres.select(F.col("cluster").alias("j"), F.col("centre").alias("cj"))
    return one.crossJoin(F.broadcast(two)).where("i <> j").select("i", "j", (1 - distance("ci", "cj") / (2 * F.sqrt(dot("ci", "ci")) + 1e-6)).alias("proximity"))  # k centres, bounded


def project(vectors: DataFrame) -> DataFrame:
    """vec_id, x, y on the first two principal components."""
    data = vectors.withColumn("features", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
    found = PCA(k=2, inputCol="features", outputCol="xy").fit(data).transform(data).withColumn("xy", vector_to_array("xy"))
    return found.select("vec_id", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))
