"""Sharding by extendible hashing, with DataFrame and SQL functions only.

A directory is indexed by the leading bits of a 60-bit hash of the key. A bucket that holds more than
``limit_bytes`` splits on its next bit; the others keep their depth. A shard is a leaf bucket, named by its bits.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, materialize, whole_text

BITS = 60


def hash_bits(key):
    """60 leading bits of the key's md5, as a long; null hashes as the empty string."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def _leaves(cells: DataFrame, low: int, high: int, limit_bytes: int) -> DataFrame:
    """Per cell (its hash range, bytes) the smallest depth in low..high at which its bucket fits, or null.

    A bucket with one hash alone cannot split and is a leaf at any size.
    """
    up = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("bucket", F.expr(f"shiftright(h_min, {BITS} - depth)"))
    fit = up.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.min("h_min").alias("h_min"), F.max("h_max").alias("h_max")).where((F.col("bytes") <= limit_bytes) | (F.col("h_min") == F.col("h_max")))
    return up.select("cell", "depth", "bucket").join(fit.select("depth", "bucket"), ["depth", "bucket"], "left_semi").groupBy("cell").agg(F.min("depth").alias("depth"))


def directory(sizes: DataFrame, limit_bytes: int, spread: int = 4) -> tuple[DataFrame, int]:
    """The directory of ``sizes`` (h, bytes): rows (cell, depth, deep) and the bits of a cell.

    One pass sums bytes in cells of about limit/2**spread; bucket sizes at every smaller depth are sums of those.
    Cells that do not fit at full directory depth are resolved from their own hashes (``deep``: cell is a hash).
    """
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = min(BITS, max(1, math.ceil(math.log2(max(2, total / max(1, limit_bytes)))) + spread))
    cells = materialize(
        sizes.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("h_min"), F.max("h").alias("h_max")),
        "shard-cells",
    )
    flat = materialize(cells.select("cell").join(_leaves(cells, 0, bits, limit_bytes), "cell", "left"), "shard-directory")
    deep = flat.where(F.col("depth").isNull()).select("cell")
    hashes = sizes.withColumn("cell", F.shiftright("h", BITS - bits)).join(deep, "cell", "left_semi").groupBy("h").agg(F.sum("bytes").alias("bytes"))
    hashes = hashes.select(F.col("h").alias("cell"), "bytes", F.col("h").alias("h_min"), F.col("h").alias("h_max"))
    below = _leaves(hashes, bits + 1, BITS, limit_bytes) if bits < BITS else hashes.select("cell", F.lit(BITS).alias("depth"))
    return flat.where("depth is not null").select("cell", "depth", F.lit(False).alias("deep")).unionByName(below.select("cell", "depth", F.lit(True).alias("deep"))), bits


def shard(df: DataFrame, limit_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``shard_id`` (bits; '' is the only shard), ``depth``, ``n_bytes`` of every row of ``df``.

    A null key counts as the empty string and a null text as empty. Rows of one key share a shard; a key that alone
    exceeds the limit has a shard to itself. Repeated rows count as often as they come. Empty input gives no rows. Other
    columns are not read, so their names may clash with anything, and so may the key's.
    """
    rows = df.select(F.col(key).alias("_key"), hash_bits(key).alias("h"), F.octet_length(whole_text(text)).cast("long").alias("bytes"))
    rows = materialize(rows, "shard-sizes")
    leaves, bits = directory(rows.select("h", "bytes"), limit_bytes)
    leaves = materialize(leaves, "shard-leaves")
    rows = rows.withColumn("cell", F.shiftright("h", BITS - bits))
    found = rows.join(leaves.where("not deep").select("cell", F.col("depth").alias("d0")), "cell", "left")
    found = found.join(leaves.where("deep").select(F.col("cell").alias("h"), F.col("depth").alias("d1")), "h", "left").withColumn("depth", F.coalesce("d0", "d1").cast("int"))
    bits_text = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0")
    return found.select(F.col("_key").alias(key), F.substring(bits_text, F.lit(1), F.col("depth")).alias("shard_id"), "depth", F.col("bytes").alias("n_bytes"))


def write_shards(df: DataFrame, path: str, limit_bytes: int, key: str = "doc_id", text: str = "text") -> None:
    """Write ``df`` as Parquet folders ``shard_id=<bits>``, each of at most ``limit_bytes`` of text (a larger single key apart)."""
    (own,) = fresh_names(df, "_key")
    placed = shard(df, limit_bytes, key, text).select(F.col(key).alias(own), F.concat(F.lit("b"), "shard_id").alias("shard_id")).distinct()
    df.drop("shard_id").join(placed, F.col(key).eqNullSafe(F.col(own))).drop(own).repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def shard_sql(limit_bytes: int) -> str:
    """The same directory in SQL: the least depth at which a row's bucket fits."""
    return f"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {BITS // 4}))::BIGINT AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
x AS (SELECT doc_id, h, n_bytes, CAST(depth AS INTEGER) AS depth, h >> CAST({BITS} - depth AS BIGINT) AS bucket FROM d, range(0, {BITS} + 1) t(depth)),
b AS (SELECT depth, bucket FROM x GROUP BY depth, bucket HAVING sum(n_bytes) <= {limit_bytes} OR min(h) = max(h)),
l AS (SELECT doc_id, h, n_bytes, min(depth) AS depth FROM x JOIN b USING (depth, bucket) GROUP BY doc_id, h, n_bytes)
SELECT doc_id, substr(lpad(bin(h), {BITS}, '0'), 1, depth) AS shard_id, depth, n_bytes FROM l"""
