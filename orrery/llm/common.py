"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.state import discard, materialize, shared_dir  # noqa: F401

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SMALL = 100_000  # rows of a table of ids that is broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(rows: int, per_task: int) -> int:
    return max(1, math.ceil(rows / per_task))


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads the bits of a polynomial hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


ODD = 0x5851F42D4C957F2D


def powers(n: int, base: int = ODD) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Word bounds and 64-bit word hashes of one UTF-8 text."""

    __slots__ = ("data", "start", "end", "hash")

    def __init__(self, data: bytes):
        self.data = data
        raw = np.frombuffer(data, dtype=np.uint8)
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        if len(self.start):
            # sum of byte * ODD**position over each word, made independent of the place by the inverse power
            up, down = _powers(len(raw))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
            h = (total[self.end] - total[self.start]) * down[self.start]
            self.hash = mix64(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def joined(self, keep: np.ndarray | None = None) -> bytes:
        """The words, or those where keep is true, joined by one space."""
        words = WORD.findall(self.data)
        if keep is not None:
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        return b" ".join(words)


_UP = powers(1)
_DOWN = powers(1, pow(ODD, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        if size > 1 << 22:  # a very long text: not kept
            return powers(n), powers(n, pow(ODD, -1, 1 << 64))
        _UP, _DOWN = powers(size), powers(size, pow(ODD, -1, 1 << 64))
    return _UP, _DOWN


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive entries of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix64((total[k:] - total[:-k]) * down[:n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w consecutive entries, by doubling."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    out, have = h, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[w - have : w - have + n])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and variant, which differs between rows that share a doc_id and differ in text, and is 0 for all others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = F.xxhash64("text")
    shared = rows.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).filter("doc_id IS NOT NULL AND x <> y")
    shared = materialize(shared.select(F.col("doc_id").alias("orrery_id")), "shared")
    n = shared.count()
    if n == 0:
        discard(shared)
        return rows.withColumn("variant", F.lit(0).cast("long"))
    joined = rows.join(F.broadcast(shared) if n <= SMALL else shared, F.col("doc_id") == F.col("orrery_id"), "left")
    return joined.select("doc_id", "text", F.when(F.col("orrery_id").isNotNull(), key).otherwise(F.lit(0)).cast("long").alias("variant"))


def settle(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of phases that have ended; it does so when the driver collects garbage.

    Spark's scheduler holds on to the last job until another comes, and with it to its shuffles; so a job of one row comes first.
    """
    import gc

    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()
