"""Signed weighted graphs: matrices, node and graph figures, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import CATEGORY_RULES, COLOURS, THEME_RULES


def nodes_of(edges: DataFrame) -> DataFrame:
    """map_key, concept, idx: the distinct endpoints in lexical order."""
    ends = edges.select("map_key", F.col("source").alias("concept")).unionByName(edges.select("map_key", F.col("target").alias("concept"))).distinct()
    return ends.selectExpr("map_key", "concept", "row_number() over (partition by map_key order by concept) - 1 as idx")


def matrix_cells(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """map_key, i, j, weight of the adjacency matrix, non-zero cells only; of repeated pairs the last counts."""
    nodes = nodes_of(edges) if nodes is None else nodes
    last = edges.groupBy("map_key", "source", "target").agg(F.max_by("weight", "seen").alias("weight")) if "seen" in edges.columns else edges.groupBy("map_key", "source", "target").agg(F.max("weight").alias("weight"))
    i = nodes.select("map_key", F.col("concept").alias("source"), F.col("idx").alias("i"))
    j = nodes.select("map_key", F.col("concept").alias("target"), F.col("idx").alias("j"))
    return last.join(i, ["map_key", "source"]).join(j, ["map_key", "target"]).select("map_key", "i", "j", "source", "target", "weight")


def dense_matrix(edges: DataFrame) -> DataFrame:
    """map_key, concepts, matrix (array of rows): for maps of at most some hundred concepts."""
    nodes = nodes_of(edges)
    cells = matrix_cells(edges, nodes)
    names = nodes.groupBy("map_key").agg(F.array_sort(F.collect_list("concept")).alias("concepts"))
    packed = cells.groupBy("map_key").agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * 1_000_000 + F.col("j")).alias("k"), "weight"))).alias("cells"))
    at = F.sequence(F.lit(0), F.size("concepts") - 1)
    row = F.transform(at, lambda i: F.transform(at, lambda j: F.coalesce(F.try_element_at("cells", (i * 1_000_000 + j).cast("long")), F.lit(0.0))))
    return names.join(packed, "map_key").select("map_key", "concepts", row.alias("matrix"))


def node_strength(edges: DataFrame) -> DataFrame:
    """In, out and total strength and degree of every node, and its role."""
    w = F.abs("weight")
    ends = edges.select("map_key", F.col("source").alias("concept"), w.alias("o"), F.lit(0.0).alias("i"), F.lit(1).alias("od"), F.lit(0).alias("id"))
    ends = ends.unionByName(edges.select("map_key", F.col("target").alias("concept"), F.lit(0.0).alias("o"), w.alias("i"), F.lit(0).alias("od"), F.lit(1).alias("id")))
    sums = ends.groupBy("map_key", "concept").agg(F.sum("o").alias("out_strength"), F.sum("i").alias("in_strength"), F.sum("od").alias("out_degree"), F.sum("id").alias("in_degree"))
    o, i = F.col("out_strength"), F.col("in_strength")
    role = F.when((o == 0) & (i == 0), "Isolated").when((i < 1e-9) | (o > 0) & (o / (i + 1e-9) > 2.5), "Transmitter").when((o < 1e-9) | (i > 0) & (i / (o + 1e-9) > 2.5), "Receiver").otherwise("Ordinary")
    return sums.withColumn("total_strength", o + i).withColumn("role", role)


def strongest_nodes(edges: DataFrame, n: int = 5) -> DataFrame:
    """map_key, concept, total_strength, rank of the ``n`` strongest concepts of each map; ties go by name."""
    nodes = node_strength(edges).withColumn("total_strength", T.rounded("total_strength", 6))
    return nodes.selectExpr("map_key", "concept", "total_strength", "row_number() over (partition by map_key order by total_strength desc, concept) as rank").where(F.col("rank") <= n)


def representatives(central: DataFrame) -> DataFrame:
    """map_key, module, concept (the most important of the module, the first by name on ties), from rows with module and importance."""
    return central.groupBy("map_key", "module").agg(F.min_by("concept", F.struct((-F.col("importance")).alias("i"), "concept")).alias("concept"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, average degree 2m/n and density m/(n(n-1)) of each map."""
    n = nodes_of(edges).groupBy("map_key").agg(F.count("*").alias("num_nodes"))
    m = edges.select("map_key", "source", "target").distinct().groupBy("map_key").agg(F.count("*").alias("num_edges"))
    return m.join(n, "map_key").select("map_key", "num_nodes", "num_edges", (2 * F.col("num_edges") / F.col("num_nodes")).alias("average_degree"), F.when(F.col("num_nodes") > 1, F.col("num_edges") / (F.col("num_nodes") * (F.col("num_nodes") - 1))).otherwise(0.0).alias("density"))


def edge_tallies(edges: DataFrame) -> DataFrame:
    """Edges by map, type and sign."""
    return edges.groupBy("map_key", "edge_type", F.when(F.col("weight") >= 0, "+").otherwise("-").alias("sign")).agg(F.count("*").alias("n"))


def theme_rollup(edges: DataFrame, rules=THEME_RULES, threshold: float = 0.5) -> DataFrame:
    """Endpoints by theme, weights summed; self-loops and sums within the threshold go."""
    t = lambda c: F.when(F.col(c) == "", "").otherwise(T.first_rule(c, rules, F.col(c)))
    moved = edges.select("map_key", t("source").alias("source"), t("target").alias("target"), "weight").where("source <> '' and target <> '' and source <> target")
    sums = moved.groupBy("map_key", "source", "target").agg(F.sum("weight").alias("weight")).where(F.abs("weight") > threshold)
    return sums.withColumn("polarity", F.when(F.col("weight") >= 0, "positive").otherwise("negative"))


def node_lookup(nodes: DataFrame, name: str = "concept", categories=CATEGORY_RULES, themes=THEME_RULES, colours=COLOURS) -> DataFrame:
    """``nodes`` with category, theme and colour."""
    category = F.when(F.col(name) == "", "Other").otherwise(T.first_rule(name, categories, F.lit("Other")))
    theme = F.when(F.col(name) == "", "").otherwise(T.first_rule(name, themes, F.col(name)))
    chain = F.create_map(*(F.lit(x) for pair in colours.items() for x in pair))
    return nodes.withColumn("category", category).withColumn("theme", theme).withColumn("colour", F.element_at(chain, F.col("category")))


def consolidate(edges: DataFrame, key: str = "map_key") -> DataFrame:
    """The cell sums of many maps over the union of their labels; nothing is clamped."""
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.countDistinct(key).alias("maps")).where("weight <> 0")


def from_matrix(cells: DataFrame) -> DataFrame:
    """Edges of an uploaded matrix (map_key, source, target, weight): off-diagonal, non-zero, confidence 0.95."""
    w = F.coalesce("weight", F.lit(0.0))
    return cells.where((F.col("source") != F.col("target")) & (w != 0)).select(
        "map_key", "source", "target", w.alias("weight"), F.when(w > 0, "positive").otherwise("negative").alias("polarity"), F.lit(0.95).alias("confidence"),
        F.lit("loaded from uploaded adjacency matrix").alias("evidence"), F.lit(None).cast("string").alias("evidence_doc_id"), F.lit("matrix").alias("edge_type"), F.lit(1).alias("hops"), F.concat_ws(".", F.lit("m"), "source", "target").alias("seen"),
    )


def two_step_reach(edges: DataFrame) -> DataFrame:
    """Nodes reached in one or two steps from each node of each map, with the fewest steps."""
    one = edges.select("map_key", "source", "target").distinct()
    two = one.join(one.select("map_key", F.col("source").alias("target"), F.col("target").alias("far")), ["map_key", "target"]).select("map_key", "source", F.col("far").alias("target"), F.lit(2).alias("steps"))
    return one.withColumn("steps", F.lit(1)).unionByName(two).where("source <> target").groupBy("map_key", "source", "target").agg(F.min("steps").alias("steps"))
