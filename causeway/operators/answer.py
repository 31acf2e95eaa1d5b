"""Answers and responses from edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_results(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """C4: map_key, result (1, 2, ...), cause, effect, polarity sign and rounded weight of ranked edges."""
    rows = edges.select("map_key", F.col("rank").alias("result"), F.col("source").alias("cause"), F.col("target").alias("effect"), F.when(F.col("weight") >= 0, "+").otherwise("-").alias("polarity"), F.round(F.abs("weight"), 2).alias("weight"))
    return rows.where(F.col("result") <= limit) if limit else rows


def edges_meta(edges: DataFrame) -> DataFrame:
    """One struct a map with its edges' attributes in rank order, rounded to 3 places."""
    item = F.struct("rank", "source", "target", F.round("weight", 3).alias("weight"), "polarity", F.round("confidence", 3).alias("confidence"), "edge_type", "hops", "evidence", "evidence_doc_id")
    return edges.groupBy("map_key").agg(F.array_sort(F.collect_list(item)).alias("edges_meta"))


def build_answer(maps: DataFrame, edges: DataFrame, effects: DataFrame | None = None, n: int = 8) -> DataFrame:
    """map_key, answer: the ``n`` strongest relations and, if simulated, the ``n`` strongest effects, in fixed sentences."""
    line = F.concat(F.lit("- "), "source", F.when(F.col("weight") >= 0, " increases ").otherwise(" decreases "), "target", F.lit(" (weight="), F.col("weight").cast("string"), F.lit(", confidence="), F.col("confidence").cast("string"), F.lit(")"))
    best = edges.selectExpr("*", "row_number() over (partition by map_key order by abs(weight) desc, source, target) as nth").where(F.col("nth") <= n)
    said = best.groupBy("map_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    out = maps.select("map_key", "query").join(said, "map_key", "left")
    text = F.concat(F.lit("Query: "), "query", F.lit("\n"), F.coalesce(F.concat(F.lit("Main causal relations found from retrieved evidence:\n"), "lines"), F.lit("No explicit causal edges were extracted. The retrieved evidence was still indexed and converted into a concept list for manual review.")))
    if effects is None:
        return out.select("map_key", text.alias("answer"))
    top = effects.selectExpr("*", "row_number() over (partition by map_key order by abs(value) desc, concept) as nth").where(F.col("nth") <= n)
    felt = top.groupBy("map_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat(F.lit("- "), "concept", F.lit(": "), F.col("value").cast("string")).alias("line")))), lambda x: x["line"]), "\n").alias("felt"))
    return out.join(felt, "map_key", "left").select("map_key", F.concat(text, F.coalesce(F.concat(F.lit("\nScenario propagation result:\n"), "felt"), F.lit(""))).alias("answer"))


def response(edges: DataFrame, max_edges: int = 10) -> DataFrame:
    """K8: counts of signs, polarity warnings and edge types of each map's ranked edges."""
    shown = edges.where(F.col("rank") <= max_edges)
    sums = shown.groupBy("map_key").agg(F.count_if(F.col("weight") >= 0).alias("positive_edges"), F.count_if(F.col("weight") < 0).alias("negative_edges"), F.count("*").alias("relation_length"), F.array_sort(F.collect_set("edge_type")).alias("edge_types"))
    none = F.array().cast("array<string>")
    warn = lambda c, what: F.when(F.col(c) == 0, F.array(F.lit(f"The map has no {what} relations: check whether the text has none or the extraction missed them."))).otherwise(none)
    return sums.withColumn("max_edges", F.lit(max_edges)).withColumn("warnings", F.concat(warn("negative_edges", "negative"), warn("positive_edges", "positive")))
