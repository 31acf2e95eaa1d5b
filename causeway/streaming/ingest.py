"""Resumable ingestion: a file stream that takes each document once (section 2.10, A25, B18).

The checkpoint is the crawl state: seen ids and read files survive a stop, and a run takes what is there and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import gates, relations
from ..shared import finished_folders, written


def documents(spark: SparkSession, path: str, schema: StructType, key: str = "doc_id", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files under ``path``, each key once."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).dropDuplicates([key])


def run(stream: DataFrame, out: str, checkpoint: str, transform=None):
    """Take all that is there (availableNow), write it as Parquet, and stop; a later call goes on where this one ended."""
    rows = transform(stream) if transform else stream
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def hits(stream: DataFrame, policy, gulf, exclude=()) -> DataFrame:
    """The gates on a stream: documents with their keyword hits."""
    return gates.with_hits(stream, policy, gulf, exclude).where((F.size("policy_hits") > 0) & (F.size("gulf_hits") > 0))


def merge_edges(stream: DataFrame, table: str, checkpoint: str, find=relations.mentions, compact_every: int = 16) -> None:
    """Merge the mentions of a stream of chunks into a table of edges, each batch once; :func:`edges` reads it.

    A batch writes what it adds, the sums and distinct sentences of its edges, to a folder of its number; a batch that is
    repeated after a failure replaces its own. Every ``compact_every`` batches all folders so far are added up to a base, from
    which readers go on, so what a read adds up stays bounded by the edges and the last batches. Mentions of an edge are
    summed where they are found before they meet, so a common edge is no hot spot.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = written(find(batch), "mentions")
        relations.partial_sums(rows).write.mode("overwrite").parquet(f"{table}/sums/{number}")
        relations.said_rows(rows).write.mode("overwrite").parquet(f"{table}/said/{number}")
        if (number + 1) % compact_every == 0:
            sums, said = _state(spark, table, number)
            said.write.mode("overwrite").parquet(f"{table}/base-said/{number}")
            sums.write.mode("overwrite").parquet(f"{table}/base-sums/{number}")  # last: a base without sums is not there

    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _state(spark: SparkSession, table: str, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Sums and sentences of all finished batches (up to a number): the last base before it and the batches since."""
    numbers = [n for n in finished_folders(spark, f"{table}/said") if upto is None or n <= upto]
    base = max((n for n in finished_folders(spark, f"{table}/base-sums") if upto is None or n < upto), default=None)
    after = [n for n in numbers if base is None or n > base]

    def read(name: str) -> DataFrame:
        paths = [f"{table}/{name}/{n}" for n in after] + ([f"{table}/base-{name}/{base}"] if base is not None else [])
        if not paths:
            raise ValueError(f"no batch has been merged into {table}")
        return spark.read.parquet(*paths)

    said = read("said").groupBy("map_key", "source", "target", "evidence").agg(F.min("at").alias("at"))
    return relations.added_sums(read("sums")), said


def edges(spark: SparkSession, table: str, evidence_limit: int | None = None) -> DataFrame:
    """The merged edges (E1, E3) of all batches that :func:`merge_edges` has finished."""
    return relations.edges_of(*_state(spark, table), evidence_limit)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; the same on a stream (with a watermark) and on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", F.round("total", 2).alias("total"))
