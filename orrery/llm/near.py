"""Operator 9: near-duplicate detection with HyperMinHash sketches.

A document's set are its distinct 5-word shingles (A-Z lower-cased). Equal sets form one class, so copies cost no more
than a hash. For each class REGISTERS least hashes are kept as HyperMinHash registers, the leading zeros and 10 bits of
mantissa in 16 bits. BANDS bands of ROWS registers, more below 0.85, propose candidates: a pair at the threshold shares
no band with a probability of (1 - 0.85**5)**25, under one in a million. A pair in a bucket is ruled out by the sizes of its sets
or by the collision-corrected estimate (`floor`: under one in a million at the threshold, too), and is otherwise confirmed on full sets.

A bucket is never expanded into pairs:

1. A star: the class of a bucket that has most mates in all its buckets is its pivot, so a group of near copies has few
   pivots, mostly the same in all buckets. Every class is compared with the best of its pivots by estimate.
2. The classes of buckets that still hold several components are dealt anew, by their rare shingles: with the shingles in
   order of how many of these classes have them, two sets as similar as the threshold share one of the first
   n - ceil(threshold * n) + 1 of each. A shingle that one class alone has fills a place there and makes no bucket, so pages of one
   template that differ in words of their own meet nowhere, however many they are.
3. New buckets that hold several components: the classes outside a bucket's largest component are its outliers.
   Outliers of the same buckets are gathered into blocks of BLOCK classes at most; a class goes once to each block
   that has an outlier in one of its buckets, and is compared there with all outliers of other components. A block
   with many visitors is salted. What moves is a row for each class and block, not for each pair, and only links that
   join components leave a block. Every pair of different components that could be linked has been compared then.

Rows grow with the square of a group only where very many texts below the threshold share their rarest shingles with many
others, each with different ones; then a class visits as many blocks as its buckets' outliers fill.

Cases: null, empty and blank texts have an empty set and link with nothing; with fewer than five words the whole
sequence is the only shingle; rows with a null doc_id are kept and link with nothing; rows that share a doc_id are one
document: each text is compared and all its links count, though a row without shingles stays alone; repeated rows give
repeated results; an empty table gives an empty result; other columns are kept by keep_first and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Words, discard, materialize, mix64, settle, window_hash
from orrery.operators.graph import components

SHINGLE = 5
BANDS = 25
ROWS = 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
PERCENT = 85
MISS = 1e-6  # of pairs at the threshold: by the bands, and by the estimate
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
VISITORS = 1_500
RARE_TEXTS = 256  # whose shingles a task holds at once

SIGNATURES = "doc_id long, text_key long, n_shingles long, hi long, lo long, registers binary"


def band_count(percent: int) -> int:
    """Bands with which a pair at the threshold is missed less than once in a million, BANDS at least."""
    return max(BANDS, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)))


def floor(percent: int, n: int) -> float:
    """The share of n registers below which a pair at the threshold falls less than once in a million."""
    p, below = percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below >= MISS:
            return k / n
    return p


def multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = Words(text.lower())
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return window_hash(words.hash, n) ^ np.uint64(n)
    return np.unique(window_hash(words.hash, SHINGLE))


def registers(found: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each multiplier the least hash, as leading zeros and mantissa."""
    least = np.full(len(times), ~np.uint64(0), np.uint64)
    for at in range(0, len(found), 512):
        h = found[at : at + 512, None] * times[None, :]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, h.min(0), out=least)
    value = np.maximum(least >> np.uint64(1), np.uint64(1)).astype(np.float64)
    zeros = 63 - np.floor(np.log2(value)).astype(np.int64)
    shift = 64 - MANTISSA - np.minimum(zeros, 63 - MANTISSA)
    mantissa = (value / 2.0 ** (shift - 1)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return ((np.minimum(zeros, 63) << MANTISSA) | mantissa).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, n: float, m: float) -> float:
    """Jaccard similarity of sets of n and m from their registers, without the share that agrees by chance."""
    chance = 0.72 * 2.0**-MANTISSA * n * m / (n + m) ** 2
    return max(0.0, ((a == b).mean() - chance) / (1 - chance))


def signatures(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        times = multipliers(n_bands * ROWS)
        for batch in batches:
            out = []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles((text or "").encode("utf-8", "replace"))
                hi, lo = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64).tolist()
                out.append((doc, key, len(found), hi, lo, registers(found, times).tobytes() if len(found) else None))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 5, pa.binary()), strict=True)], names=["doc_id", "text_key", "n_shingles", "hi", "lo", "registers"])

    return keyed(docs).mapInArrow(run, SIGNATURES)


def keyed(docs: DataFrame) -> DataFrame:
    """text_key tells texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def bands(classes: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """(key, node, n) for every band of a class; key holds the band's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys = [xxhash.xxh3_64_intdigest(r[k * 2 * ROWS : (k + 1) * 2 * ROWS], seed=k) for r in batch.column(2).to_pylist() for k in range(n_bands)]
            node, n = (np.repeat(batch.column(k).to_numpy(), n_bands) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(node), pa.array(n)], names=["key", "node", "n"])

    return classes.select("node", "n", "registers").mapInArrow(run, "key long, node long, n long")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that estimates do not rule out, with the estimate e."""
    n_registers = band_count(percent) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = floor(percent, n_registers)
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            got = [estimate(np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16), i, j) for p, q, i, j in zip(x, y, n, m, strict=True)]
            ok = [k for k, e in enumerate(got) if e >= low - 1e-3]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in ok], pa.int64()), pa.array([b[k] for k in ok], pa.int64()), pa.array([got[k] for k in ok], pa.float64())], names=["a", "b", "e"])

    left, right = (classes.select(F.col("node").alias(c), F.col("registers").alias(f"r{c}"), F.col("n").alias(f"n{c}")) for c in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return both.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long, e double")


class Block:
    """Some classes, and the shingles that they hold, each with its holders."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.labels: list[int] = []
        self.sets: list[np.ndarray] = []
        self.registers: list[np.ndarray] = []

    def add(self, node: int, label: int, text: str, registers: bytes) -> None:
        self.nodes.append(node)
        self.labels.append(label)
        self.sets.append(shingles(text.encode("utf-8", "replace")))
        self.registers.append(np.frombuffer(registers, np.uint16))

    def close(self) -> None:
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(self.sets))
        held = np.concatenate(self.sets)
        order = np.argsort(held, kind="stable")
        self.held, self.holder = held[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
        self.registers = np.stack(self.registers)
        self.sets = []

    def plausible(self, n: int, registers: np.ndarray, percent: int, low: float) -> np.ndarray:
        """Whom sizes and estimates leave for a set of n."""
        m = self.sizes
        near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        if near.any():
            chance = 0.72 * 2.0**-MANTISSA * n * m / (n + m) ** 2
            near &= ((self.registers == registers).mean(1) - chance) / (1 - chance) >= low
        return near

    def common(self, found: np.ndarray) -> np.ndarray:
        """With each class, how many of found it holds."""
        first, last = np.searchsorted(self.held, found, "left"), np.searchsorted(self.held, found, "right")
        n = last - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.holder[at], minlength=len(self.nodes))


def compared(members: DataFrame, visitors: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different labels, of visitors a with members b of the same block. members: block, node, label; visitors too."""
    n_registers = band_count(percent) * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = floor(percent, n_registers) - 1e-3
        here, block, parent = None, Block(), {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        for batch in batches:
            out = []
            for key, salt, member, node, label, n, registers, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (key, salt):
                    here, block, parent, is_open = (key, salt), Block(), {}, True
                if member:
                    block.add(node, label, text, registers)
                    continue
                if is_open:
                    block.close()
                    is_open = False
                other = block.plausible(n, np.frombuffer(registers, np.uint16), percent, low)
                if other.any():
                    mine = root(label)
                    other &= np.fromiter((root(x) != mine for x in block.labels), bool, len(other))
                if not other.any():
                    continue
                common = block.common(shingles(text.encode("utf-8", "replace")))
                for k in np.flatnonzero(other & (100 * common >= percent * (n + block.sizes - common))).tolist():
                    if (x := root(block.labels[k])) != (y := root(label)):
                        parent[max(x, y)] = min(x, y)
                        out.append((node, block.nodes[k]))
            cols = list(zip(*out, strict=True)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    parts = visitors.groupBy("block").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    come = visitors.join(parts, "block").select("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("member"), "node", "label")
    stay = members.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(True).alias("member"), "node", "label")
    rows = come.unionByName(stay).join(texts.select("node", "n", "registers", "text"), "node")
    rows = rows.repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("member").desc())
    return rows.select("block", "salt", "member", "node", "label", "n", "registers", "text").mapInArrow(run, "a long, b long")


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after edges, whose ends are first replaced by their labels."""
    ends = [labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")) for k in "ab"]
    found = components(edges.join(ends[0], "a").join(ends[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    found = found.select(F.col("node").alias("label"), "component")
    return materialize(labels.join(found, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component"), "labels")


def mixed(here: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels."""
    crowd = here.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    return here.join(crowd, "key", "left_semi")


def rare(here: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(key, node, label, n): the classes of here by the rare shingles of which linked ones share one. A shingle's rows are counted before
    they meet and its joins can be split; a class's shingles meet in one row, which is no longer than its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RARE_TEXTS):
                part = batch.slice(at, RARE_TEXTS)
                found = [shingles(t.encode("utf-8", "replace")) for t in part.column(1).to_pylist()]
                node = np.repeat(part.column(0).to_numpy(), np.fromiter(map(len, found), np.int64, len(found)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["node", "key"])

    nodes = here.select("node", "label", "n").distinct()
    every = materialize(texts.select("node", "text").join(nodes.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, "node long, key long"), "shingles")
    shared = every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    known = every.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("known")).join(nodes, "node")
    # those of this class alone are its rarest
    places = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100 - 1e-9) + 1 - (F.col("n") - F.size("known"))
    keys = known.filter(places > 0).select(F.explode(F.slice("known", F.lit(1), places.cast("int"))).alias("x"), "node", "label", "n")
    out = materialize(mixed(keys.select("x.key", "node", "label", "n")), "rare")
    discard(every)
    return out


def star(here: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of classes with the best pivot of their buckets."""
    pivots = here.groupBy("key").agg(F.max(F.struct("mates", "node", "label", "n")).alias("p"))
    near = 100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")
    pairs = here.join(pivots, "key").filter((F.col("label") != F.col("p.label")) & near).select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
    best = estimated(pairs, texts, percent).groupBy("a").agg(F.max(F.struct("e", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    # before any link a class is its own label
    visitors = best.select(F.col("b").alias("block"), F.col("a").alias("node"), F.col("a").alias("label"))
    members = best.select(F.col("b").alias("block")).distinct().select("block", F.col("block").alias("node"), F.col("block").alias("label"))
    return compared(members, visitors, texts, percent)


def outliers(here: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of outliers (block, node, label), the visitors (block, node, label) of each, and the state that these are read from."""
    sizes = here.groupBy("key", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("main")).select("key", F.col("main.label").alias("main"))
    out = here.join(main, "key").filter("label <> main").select("key", "node", "label", "n")
    out = materialize(out, "out")
    crowd = out.groupBy("key").agg(F.count("*").alias("c"))
    # outliers gather at the bucket with most of them, or at one that their buckets' outliers gather at
    home = out.join(crowd, "key").groupBy("node").agg(F.max(F.struct("c", "key")).alias("x"))
    joint = out.join(home, "node").groupBy("key").agg(F.max("x").alias("x"))
    home = out.join(joint, "key").groupBy("node", "label", "n").agg(F.max("x").alias("x")).select("node", "label", "n", F.col("x.key").alias("home"))
    blocks = home.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = home.join(blocks, "home").select(F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"), "node", "label")
    members = materialize(members, "outliers")
    asked = out.select("key", "node").join(members.select("node", "block"), "node").select("key", "block").distinct()
    return members, here.join(asked, "key").select("block", "node", "label").distinct(), out


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and the component_id of classes (hi, lo) that are linked with another."""
    spark = docs.sparkSession
    n_bands = band_count(percent)
    signed = materialize(signatures(docs, n_bands), "signatures")
    full = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    heads = full.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.count("*").alias("copies"))
    classes = materialize(heads.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "first.doc_id", "first.text_key", "n", "registers", "copies"), "classes")
    every = bands(classes, n_bands)
    crowded = every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    mates = materialize(every.join(crowded, "key").select("key", "node", "c"), "mates")
    settle(spark)
    some = classes.join(mates.groupBy("node").agg(F.sum("c").alias("mates")), "node")
    texts = materialize(keyed(docs).join(some, ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "n", "mates", "registers", "text"), "texts")
    settle(spark)

    labels = texts.select("node", F.col("node").alias("label"), "mates", "n")
    found = materialize(star(mates.join(labels, "node"), texts, percent), "links")
    settle(spark)
    labels = relabelled(labels, found)
    here = materialize(mixed(mates.join(labels, "node")), "mixed")
    discard(found, mates)
    settle(spark)
    crowds, here = here, rare(here, texts, percent)
    discard(crowds)
    settle(spark)
    members, visitors, out = outliers(here)
    found = materialize(compared(members, visitors, texts, percent), "links")
    discard(here, members, out, texts)
    settle(spark)

    # rows that share a doc_id are one document
    shared = full.groupBy("doc_id").agg(F.min("hi").alias("x"), F.max("hi").alias("y")).filter("x <> y").select("doc_id")
    several = full.join(shared, "doc_id", "left_semi").select("doc_id", "hi", "lo").distinct().join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select("doc_id", "node")
    several = materialize(several, "several")
    same = several.join(several.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")
    nodes = labels.select("node", "label").unionByName(several.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
    last = relabelled(nodes, found.unionByName(same))
    own = classes.select("node", "hi", "lo", "doc_id", "copies")
    least = last.join(own, "node").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    heads = own.join(last.join(least, "label"), "node", "left").filter("copies > 1 OR component_id < doc_id").select("hi", "lo", F.coalesce("component_id", "doc_id").alias("component_id"))
    heads = materialize(heads, "components")
    discard(labels, found, several, last, classes)
    settle(spark)
    return signed, heads


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    signed, heads = links(docs, percent)
    joined = signed.select("doc_id", "n_shingles", "hi", "lo").join(heads, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a smaller doc_id in their component, with their own columns."""
    gone = near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias("orrery_id")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("orrery_id"), "left_anti")
