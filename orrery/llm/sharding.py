"""Operator 6: sharding by extendible hashing. DataFrame functions only.

A document's key is a 64-bit hash; a shard is a prefix of its bits. Starting from one bucket, a bucket over the byte
limit splits on its next bit and the others stay, so a shard's depth follows its bytes and the directory of all
prefixes of the greatest depth points each document to its shard.

Only (key, bytes) are aggregated, once, to prefixes of a depth at which an average bucket holds a small part of a
shard; all shallower buckets are sums of these. A prefix still over the limit is looked at again, 8 bits deeper, until
it fits or all its bytes have one key. Rows of one key over the limit (a very long document, or one id repeated many
times) cannot be told apart by any bit: they are cut by a running sum of bytes, from range partitions and their sums, and a single document
above the limit has a shard of its own, marked as oversized.

Cases: null texts have 0 bytes; null ids share one key; repeated rows are placed each; an empty table gives an
empty result; extra columns are kept by write_shards and ignored by shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import materialize

SHARD_BYTES = 8 << 20
FINER_BITS = 4
STEP_BITS = 8


def prefix(key: Column, depth) -> Column:
    """The first depth bits of a 64-bit key, as a number."""
    return F.when(F.lit(depth) == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", key, F.lit(64) - F.lit(depth)))


def directory(keys: DataFrame, limit: int) -> DataFrame:
    """(fine_depth, fine, depth, bits, bytes): for each fine prefix the shard that it belongs to. keys: (key, bytes)."""
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    fine = min(60, math.ceil(math.log2(max(1.0, total / limit))) + FINER_BITS)
    start, rows, parts = 0, keys, []
    while True:
        held = materialize(rows.groupBy(prefix(F.col("key"), fine).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count_distinct("key").alias("n_keys")), f"prefixes{fine}")
        depths = F.explode(F.sequence(F.lit(start), F.lit(fine))).alias("depth")
        above = held.select("fine", "bytes", "n_keys", depths).withColumn("bits", F.call_function("shiftright", "fine", (F.lit(fine) - F.col("depth")).cast("int")))
        sums = above.groupBy("depth", "bits").agg(F.sum("bytes").alias("held"), F.sum("n_keys").alias("n")).filter((F.col("held") <= limit) | (F.col("n") == 1) | (F.col("depth") == 64))
        found = above.join(sums, ["depth", "bits"]).groupBy("fine").agg(F.min_by(F.struct("depth", "bits", F.col("held").alias("bytes")), "depth").alias("x"))
        found = materialize(found.select(F.lit(fine).alias("fine_depth"), "fine", "x.*"), f"directory{fine}")
        parts.append(found)
        left = held.join(found.select("fine"), "fine", "left_anti").select(F.col("fine").alias("orrery_fine"))
        if fine >= 64 or left.isEmpty():
            break
        rows = rows.withColumn("orrery_fine", prefix(F.col("key"), fine)).join(left, "orrery_fine", "left_semi").drop("orrery_fine")
        start, fine = fine + 1, min(64, fine + STEP_BITS)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def running_bytes(rows: DataFrame) -> DataFrame:
    """rows with before: the bytes of the rows of the same (depth, bits) that come first, by size and id."""
    order = ["depth", "bits", "n_bytes", "doc_id", "salt"]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    spread = materialize(salted.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()), "ordered")
    own = F.coalesce(F.sum("n_bytes").over(Window.partitionBy("chunk", "depth", "bits").orderBy(*order[2:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a chunk holds a part of one bucket at its ends only, so buckets have few chunks each but for the largest
    sums = spread.groupBy("depth", "bits", "chunk").agg(F.sum("n_bytes").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("depth", "bits").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("depth", "bits", "chunk", before.alias("earlier"))
    return spread.withColumn("before", own).join(sums, ["depth", "bits", "chunk"]).withColumn("before", F.col("before") + F.col("earlier")).drop("salt", "chunk", "earlier")


def keyed(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id").alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows (doc_id, key, n_bytes, ...) with depth, bits, part, shard, shard_bytes and oversized."""
    found = directory(rows.select("key", F.col("n_bytes").alias("bytes")), limit)
    all_rows = None
    for (fine,) in sorted(found.select("fine_depth").distinct().collect()):
        here = found.filter(F.col("fine_depth") == fine).drop("fine_depth").withColumnRenamed("bytes", "shard_bytes")
        some = rows.withColumn("fine", prefix(F.col("key"), fine)).join(here, "fine").drop("fine")
        all_rows = some if all_rows is None else all_rows.unionByName(some)
    if all_rows is None:
        all_rows = rows.limit(0).withColumns({"depth": F.lit(0), "bits": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long")})
    fits = all_rows.filter(F.col("shard_bytes") <= limit).withColumn("part", F.lit(0).cast("long"))
    over = running_bytes(all_rows.filter(F.col("shard_bytes") > limit))
    # parts of half the limit, smaller rows first: with the row that begins before it no part is over the limit unless it is one row
    over = over.withColumn("part", F.greatest(F.ceil((F.col("before") + F.col("n_bytes")) / F.lit(limit / 2)), F.lit(1)).cast("long")).drop("before")
    sums = over.groupBy("depth", "bits", "part").agg(F.sum("n_bytes").alias("part_bytes"))
    over = over.drop("shard_bytes").join(sums, ["depth", "bits", "part"]).withColumnRenamed("part_bytes", "shard_bytes")
    name = F.concat_ws("-", F.lpad(F.col("depth").cast("string"), 2, "0"), F.lpad(F.hex("bits"), 16, "0"), F.col("part").cast("string"))
    return fits.unionByName(over).withColumns({"depth": F.col("depth").cast("int"), "shard": name, "oversized": F.col("shard_bytes") > limit})


def shards(docs: DataFrame, limit: int = SHARD_BYTES, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, depth, bits, part, shard (a name), shard_bytes, oversized."""
    return placed(keyed(docs.select("doc_id", text), text).drop("row"), limit).select("doc_id", "n_bytes", "depth", "bits", "part", "shard", "shard_bytes", "oversized")


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES, text: str = "text") -> None:
    """Writes the rows, one folder for each shard, with all their columns."""
    rows = placed(keyed(docs, text), limit).select("row.*", F.col("shard").alias("orrery_shard"))
    rows.repartition("orrery_shard").write.partitionBy("orrery_shard").parquet(path)
