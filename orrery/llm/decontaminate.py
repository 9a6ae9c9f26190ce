"""Operator 4: benchmark decontamination with SimHash windows. DataFrame functions only.

A window is as many consecutive words of a document (A-Z lower-cased) as a benchmark item has. Two windows are alike if
their weighted Jaccard similarity on 5-word shingles is at least SIMILARITY; a shingle weighs ln(1 + items / items
that have it), in a window too, and ln(1 + items) if none has.

Places. A window that shares no shingle with any item has similarity 0, so every shingle of every document is looked up
in the items' first, and each hit names the place at which the item would begin, moved into the text if that is before
it or too near its end. A window whose begin lies outside the begins that its own hits name can be moved towards them
without losing a hit; and since an alike window has at most a quarter as many other shingles as the item has, the
begins of its hits follow each other within a quarter of the item's length. All places in such gaps are tried as well, so every
alike window, or one at least as like beside it, gets a 64-bit SimHash fingerprint over its words.

Candidates. Two fingerprints within RADIUS bits are within RADIUS // BLOCKS bits in one of BLOCKS blocks at least, so
the items' index holds each block with all its variants within that distance, by item size, and a window looks up its
blocks as they are. That finds every item of the window's size within RADIUS. These are compared exactly.

The rest. Fingerprints of alike windows lie further apart than RADIUS now and then, about three times in a hundred where a
passage breaks off just above SIMILARITY. An alike window has so much of an item's weight that it has one of the item's
heaviest shingles that weigh more than 1 - SIMILARITY of it; documents and items that share one of these, and that share
as much weight as an alike window has, are compared exactly too, at all their windows, unless they are already found.

The items are broadcast while they have at most BROADCAST_SHINGLES shingles and joined by a shuffle beyond that. Hits
are aggregated per document and place before texts move, and texts move once, by doc_id.

Cases: null, empty and short texts have no hit; items of fewer than five words count their whole sequence as their one
shingle; null or blank items are never found; rows with a null doc_id are not judged and stay; repeated rows, items and
ties give one pair each; rows that share a doc_id are judged together; very long texts are cut into windows like others; empty tables give an
empty result; other columns are kept by keep_clean and ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 14
BLOCKS = 5
BROADCAST_SHINGLES = 1_000_000
#: Sums of weights in another order may differ by this much.
ROUNDING = 1e-12


def words(text: Column) -> Column:
    """64-bit hashes of the words, A-Z lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.transform(F.filter(F.split(F.translate(text, upper, upper.lower()), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(of: Column, size: int | Column) -> Column:
    """Hashes of the runs of size words, in order."""
    n = F.size(of) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(of, i, size)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(column: str) -> Column:
    """64-bit SimHash of an array of hashes: each bit is what most of them have there. Four bits are counted in one long."""
    lanes = sum(1 << 16 * k for k in range(4))
    sums = f"aggregate({column}, 0L, (s, w) -> s + (shiftrightunsigned(w, k) & {lanes}L))"
    bits = " | ".join(f"IF(2 * (shiftrightunsigned(s, {16 * k}) & 65535L) > size({column}), shiftleft(1L, k + {16 * k}), 0L)" for k in range(4))
    return F.expr(f"aggregate(transform(sequence(0, 15), k -> named_struct('k', k, 's', {sums})), 0L, (f, x) -> f | aggregate(array(x), 0L, (z, y) -> {bits.replace('(s,', '(y.s,').replace(', k +', ', y.k +')}))")


def cuts() -> list[tuple[int, int]]:
    return [(k * 64 // BLOCKS, (k + 1) * 64 // BLOCKS) for k in range(BLOCKS)]


def blocks(column: str) -> Column:
    """The blocks of a fingerprint, with their numbers."""
    return F.array(*[F.expr(f"{k << 32}L | (shiftrightunsigned({column}, {a}) & {(1 << (b - a)) - 1}L)") for k, (a, b) in enumerate(cuts())])


def _flip(own: Column):
    return lambda mask: own.bitwiseXOR(mask.cast("long"))


def placed(of: Column, size: int) -> Column:
    """Shingles with their size and place."""
    return F.transform(shingles(of, size), lambda h, at: F.struct(F.lit(size).alias("size"), at.alias("at"), h.alias("h")))


def around(column: str) -> Column:
    """The blocks and all that differ from them in RADIUS // BLOCKS bits at most."""
    found = []
    for block, (a, b) in zip(range(BLOCKS), cuts(), strict=True):
        masks = {0}
        for _ in range(RADIUS // BLOCKS):
            masks |= {m | 1 << k for m in masks for k in range(b - a)}
        own = blocks(column)[block]
        found.append(F.transform(F.array(*map(F.lit, sorted(masks))), _flip(own)))
    return F.concat(*found)


def prepared(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """Distinct items with their words, shingle size, shingles, total weight and fingerprints; the shingles of items (item, h) with
    their weights w; and the weight of a shingle that no item has."""
    items = benchmark.select("item_id", words(F.col("text")).alias("item_words")).filter(F.size("item_words") > 0).dropDuplicates(["item_id", "item_words"])
    items = items.withColumn("size", F.least(F.lit(SHINGLE), F.size("item_words"))).withColumn("places", shingles(F.col("item_words"), F.col("size")))
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    total = items.count()
    weights = items.select(F.explode(F.array_distinct("places")).alias("h"), "item_id").distinct().groupBy("h").agg(F.log1p(F.lit(total) / F.count("*")).alias("w"))
    own = materialize(items.select("item", F.explode(F.array_distinct("places")).alias("h")).join(weights, "h"), "item-shingles")
    known = items.join(own.groupBy("item").agg(F.sum("w").alias("item_weight")), "item").withColumn("fp", fingerprint("item_words"))
    return materialize(known, "known"), own, math.log1p(total)


def hits_of(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_doc, size, at, h): the places of documents whose shingle an item has; rows: doc_id, words."""
    known = items.select("size", F.explode("places").alias("h")).distinct()
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [SHINGLE]
    each = F.flatten(F.array(*[placed(F.col("words"), k) for k in sizes]))
    return rows.select("doc_id", F.size("words").alias("n_doc"), F.explode(each).alias("x")).select("doc_id", "n_doc", "x.*").join(known, ["h", "size"])


def begins_of(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(id, begins): places and sizes of the windows to look at in each document."""
    marks = items.select(F.size("item_words").alias("n"), "size", F.posexplode("places").alias("item_at", "h")).distinct()
    if marks.count() <= BROADCAST_SHINGLES:
        marks = F.broadcast(marks)
    hits = hits.join(marks, ["h", "size"])
    begins = hits.select("doc_id", "n", F.greatest(F.least(F.col("at") - F.col("item_at"), F.col("n_doc") - F.col("n")), F.lit(0)).alias("begin"))
    begins = begins.groupBy("doc_id", "n").agg(F.array_sort(F.collect_set("begin")).alias("b"))
    after = lambda i: F.coalesce(F.get("b", i + 1), F.lit(-1))
    filled = F.flatten(F.transform("b", lambda x, i: F.sequence(x, F.when((after(i) > x) & (4 * (after(i) - x) <= F.col("n")), after(i) - 1).otherwise(x))))
    return begins.select(F.col("doc_id").alias("id"), F.transform(filled, lambda x: F.struct(x.alias("begin"), F.col("n").alias("n"))).alias("x")).groupBy("id").agg(F.flatten(F.collect_list("x")).alias("begins"))


def likely(hits: DataFrame, items: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, item): documents with at least as much of an item's weight as an alike window has."""
    known = own.join(items.select("item", "item_weight"), "item")
    before = F.sum("w").over(Window.partitionBy("item").orderBy(F.col("w").desc(), "h")) - F.col("w")
    heavy = known.withColumn("before", before).filter(F.col("before") <= (1 - similarity + ROUNDING) * F.col("item_weight")).select("item", "h")
    here = hits.select("doc_id", "h").distinct()
    pairs = here.join(heavy, "h").select("doc_id", "item").distinct()
    shared = pairs.join(known, "item").join(here, ["doc_id", "h"]).groupBy("doc_id", "item").agg(F.sum("w").alias("both"), F.first("item_weight").alias("item_weight"))
    return shared.filter(F.col("both") >= (similarity - ROUNDING) * F.col("item_weight")).select("doc_id", "item")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (doc_id, item_id) with the best window's place, its distance in bits and its similarity."""
    items, item_shingles, unseen = prepared(benchmark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    hits = materialize(hits_of(rows.select("doc_id", words(F.col("text")).alias("words")), items), "hits")
    found = begins_of(hits, items)
    windows = rows.join(found, F.col("doc_id") == F.col("id")).select("doc_id", words(F.col("text")).alias("words"), "begins")
    windows = windows.select("doc_id", F.explode(F.transform("begins", lambda x: F.struct(x["begin"].alias("begin"), x["n"].alias("n"), F.slice("words", x["begin"] + 1, x["n"]).alias("window")))).alias("x"))
    windows = materialize(windows.select("doc_id", "x.*").filter(F.size("window") == F.col("n")).withColumn("seen", fingerprint("window")), "windows")
    index = items.select("item", F.size("item_words").alias("n"), "fp", F.explode(around("fp")).alias("block"))
    bits = F.bit_count(F.col("seen").bitwiseXOR(F.col("fp")))
    close = windows.withColumn("block", F.explode(blocks("seen"))).join(index, ["n", "block"]).withColumn("distance", bits).filter(F.col("distance") <= RADIUS)
    close = close.select("doc_id", "begin", "n", "window", "distance", "item").distinct()
    few = item_shingles.count() <= BROADCAST_SHINGLES
    weights, mine = item_shingles.select("h", "w").distinct(), item_shingles.select("item", "h", F.col("w").alias("mine"))

    def alike(close: DataFrame) -> DataFrame:
        """The windows of close whose similarity with their item is large enough."""
        # of each window's shingles the weight among all items, and whether the item has it
        pair = ["doc_id", "item_id", "item", "begin", "n", "distance", "seen", "item_weight"]
        close = close.join(items.select("item", "item_id", "size", "item_weight"), "item")
        each = close.withColumn("seen", F.xxhash64("window")).select(*pair, F.explode(F.array_distinct(shingles(F.col("window"), F.col("size")))).alias("h"))
        each = each.join(F.broadcast(weights) if few else weights, "h", "left").join(F.broadcast(mine) if few else mine, ["item", "h"], "left")
        sums = each.groupBy(*pair).agg(F.sum(F.coalesce("w", F.lit(unseen))).alias("window_weight"), F.coalesce(F.sum("mine"), F.lit(0.0)).alias("both"))
        value = F.col("both") / (F.col("item_weight") + F.col("window_weight") - F.col("both"))
        return sums.select("doc_id", "item_id", "item", F.col("begin").alias("word_at"), F.col("n").alias("n_words"), "distance", value.alias("similarity")).filter(F.col("similarity") >= similarity - ROUNDING)

    judged = materialize(alike(close), "judged")
    rest = likely(hits, items, item_shingles, similarity).join(judged.select("doc_id", "item"), ["doc_id", "item"], "left_anti")
    far = rest.join(items.select("item", F.size("item_words").alias("n"), "fp"), "item").join(windows, ["doc_id", "n"]).withColumn("distance", bits)
    far = alike(far.select("doc_id", "begin", "n", "window", "distance", "item").distinct())
    best = judged.unionByName(far).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("word_at", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("word_at"))).alias("x"))
    out = materialize(best.select("doc_id", "item_id", "x.*"), "leaks")
    discard(items, item_shingles, hits, windows, judged)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("orrery_id")).distinct()
    return docs.join(found, docs["doc_id"] == F.col("orrery_id"), "left_anti")
