"""Writers of corpora, documents, graphs and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from .readers import FIELDS


def corpus(chunks: DataFrame, path: str, model: str = "") -> None:
    """The chunk table, and one JSON row with its counts and model."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    back = chunks.sparkSession.read.parquet(f"{path}/chunks")
    back.agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents")).withColumn("model", F.lit(model)).coalesce(1).write.mode("overwrite").json(f"{path}/config")


def rendered(documents: DataFrame) -> DataFrame:
    """K2: Document_ID, value: a header of the filled fields above each document's text."""
    head = F.concat_ws("\n", *(F.when(F.trim(F.col(f)) != "", F.concat(F.lit(f"{f}: "), f)) for f in FIELDS))
    return documents.select("Document_ID", F.concat(head, F.lit("\n" + "=" * 60 + "\n"), "text").alias("value"), F.to_json(F.struct(*FIELDS)).alias("metadata"))


def thread_text(threads: DataFrame) -> DataFrame:
    """K3: thread_id, value: a thread's posts (array of post_id, author, date, body) in blocks, empty bodies marked."""
    post = lambda p: F.concat(F.lit("--- "), F.coalesce(p["author"], F.lit("")), F.lit(" | "), F.coalesce(p["date"], F.lit("")), F.lit(" ---\n"), F.coalesce(F.nullif(F.trim(p["body"]), F.lit("")), F.lit("[empty body]")))
    return threads.select("thread_id", F.concat(F.lit("# "), "title", F.lit("\n"), "url", F.lit("\n\n"), F.array_join(F.transform("posts", post), "\n\n")).alias("value"))


def metadata_csv(metadata: DataFrame, path: str) -> None:
    """K4: the seven fields as CSV, everything quoted, sorted by id."""
    metadata.select(*FIELDS).orderBy("Document_ID").write.mode("overwrite").option("quoteAll", True).csv(path, header=True)


def matrix_csv(edges: DataFrame, path: str, places: int = 3) -> None:
    """One adjacency CSV a map: a row a concept, rounded cells, labels quoted; partitioned by map."""
    cells = F.transform("row", lambda x: F.replace(F.format_number(x, places), F.lit(",")))
    rows = G.dense_matrix(edges).select("map_key", "concepts", F.posexplode("matrix").alias("i", "row"))
    line = F.concat_ws(",", F.concat(F.lit('"'), F.regexp_replace(F.get("concepts", F.col("i")), '"', '""'), F.lit('"')), F.array_join(cells, ","))
    head = G.dense_matrix(edges).select("map_key", F.lit(-1).alias("i"), F.concat(F.lit('"",'), F.array_join(F.transform("concepts", lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))), ",")).alias("value"))
    rows.select("map_key", "i", line.alias("value")).unionByName(head).repartition("map_key").sortWithinPartitions("map_key", "i").select("map_key", "value").write.mode("overwrite").partitionBy("map_key").text(path)


def gexf_rows(edges: DataFrame) -> DataFrame:
    """K5: map_key, place, value: the lines of a GEXF graph."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    nodes = G.nodes_of(edges).select("map_key", F.lit(1).alias("part"), F.col("idx").cast("long").alias("n"), F.format_string('<node id="%s" label="%s"/>', safe(F.col("concept")), safe(F.col("concept"))).alias("value"))
    arcs = edges.selectExpr("*", "row_number() over (partition by map_key order by source, target) as n").select("map_key", F.lit(3).alias("part"), F.col("n").cast("long").alias("n"), F.format_string('<edge id="%d" source="%s" target="%s" weight="%s"/>', F.col("n"), safe(F.col("source")), safe(F.col("target")), F.col("weight").cast("string")).alias("value"))
    fixed = [(0, '<?xml version="1.0" encoding="UTF-8"?><gexf version="1.2"><graph defaultedgetype="directed"><nodes>'), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>")]
    frame = edges.select("map_key").distinct().withColumn("f", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(v).alias("value")) for p, v in fixed)))).select("map_key", "f.part", F.lit(0).cast("long").alias("n"), "f.value")
    return nodes.unionByName(arcs).unionByName(frame).selectExpr("map_key", "part", "n", "value")


def network(edges: DataFrame, path: str) -> None:
    """K5: edges as JSON and CSV, node figures as CSV, GEXF and adjacency matrices, each partitioned by map."""
    edges.write.mode("overwrite").json(f"{path}/edges_json")
    edges.select("map_key", "source", "target", F.round("weight", 3).alias("weight"), "polarity").write.mode("overwrite").option("header", True).csv(f"{path}/edges_csv")
    G.node_strength(edges).write.mode("overwrite").option("header", True).csv(f"{path}/nodes_csv")
    gexf_rows(edges).repartition("map_key").sortWithinPartitions("map_key", "part", "n").select("map_key", "value").write.mode("overwrite").partitionBy("map_key").text(f"{path}/gexf")
    matrix_csv(edges, f"{path}/matrix_csv")


def summary(df: DataFrame, path: str, column: str = "outcome") -> None:
    """The counts of a run as one JSON row."""
    df.groupBy(column).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "count")))).alias("counts"), F.sum("count").alias("total")).coalesce(1).write.mode("overwrite").json(path)
