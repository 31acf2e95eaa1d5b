"""The folder that all executors share, and cutting lineage there."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHECKPOINTS = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can read.

    Only a session on one machine (tests) that names none gets a temporary folder; on a cluster that would be read by no
    other machine, so it is an error.
    """
    found = spark.conf.get(CHECKPOINTS, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINTS} to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="causeway-")
        spark.conf.set(CHECKPOINTS, found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/causeway/{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends there.

    A lost executor costs only the tasks that were running on it. ``codec`` compresses it other than the session does.
    """
    path = f"{session_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tag: str, which: Column | None = None) -> tuple[DataFrame, int]:
    """``written``, and how many of the rows meet ``which`` (all, by default), counted while they are written.

    A task that runs again may count twice: the number is 0 exactly if there are none, and else no less than they are.
    """
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1) if which is None else F.when(which, 1)).alias("n")), tag)
    n = seen.get.get("n")
    return out, (out if which is None else out.where(which)).count() if n is None else n  # an empty plan observes nothing


def finished_folders(spark: SparkSession, root: str, mark: str = "_SUCCESS") -> list[int]:
    """The numbers n, in order, of the folders ``root/n`` that hold ``mark``: what a failure left half-written is not among them."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(root)):
        return []
    return sorted(int(s.getPath().getName()) for s in files.listStatus(path(root)) if s.getPath().getName().isdigit() and files.exists(path(s.getPath(), mark)))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of results that nothing refers to any more; it does so where the driver's JVM collects its heap."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(1)  # the files go in the background


def discard(spark: SparkSession) -> bool:
    """Delete the tables that this application has written; results that read them have to be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
