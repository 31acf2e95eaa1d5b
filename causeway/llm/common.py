"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import counted  # noqa: F401
from ..shared import written as materialize  # noqa: F401  the operators' name for it


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark's reader resolves the path, wherever it is stored."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a record batch that Spark hands to Python; long texts make large batches.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows a record batch to ARROW_ROWS, so a batch of long texts fits in a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def whole_text(col="text"):
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` has it (letter case apart, as Spark resolves)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


class BoundedCache(dict):
    """A dict that computes missing values and holds two generations of ``limit`` entries at most.

    At ``limit`` the entries become the old generation; those still in use come back, the rest goes at the next turn.
    A worker's memory stays bounded, and frequent keys stay known.
    """

    def __init__(self, make, limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def sliced(batches, rows: int = 1000):
    """Smaller record batches: long rows (texts, media) of many rows are never expanded at once."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:  # workers serve many tasks: what this one took goes back
        pa.default_memory_pool().release_unused()
