"""Operator 8: suffix-array dedup with a run-length index.

A string is LENGTH bytes within one document. Each string holds the least hash of its GRAM-byte grams, its minimiser.
A first pass counts the places of minimisers over the corpus; those that stand in one place only cannot be part of a
repeated string. Runs of consecutive strings around the others are cut out and sent, each distinct one once from a
task, to the bucket of the minimiser, where equal strings meet.

A bucket keeps its distinct cuts, apart by a byte that UTF-8 does not have, with their earliest place and indexes them: a suffix order by prefix doubling,
of which its Burrows-Wheeler transform as runs and the two suffixes that meet at each run's head, the samples, are kept. Only there are
lengths of matches compared byte by byte; when the text is streamed, every other matching statistic is one
less than its left neighbour's, and its neighbour in suffix order one place on. Neighbours that match LENGTH bytes or more are one string, and get the
earliest place of it. Cuts with something to remove leave the bucket as runs keyed by a 128-bit hash; an equi-join with
the places of cuts, which Spark can split, gives each document its removed bytes. What a task holds is bounded by the
distinct cuts of a bucket, so copies of a passage never gather.

Cases: null texts are empty; empty and short texts lose nothing; rows with a null doc_id are kept as they are and
remove nothing; rows that share a doc_id and a text get the same spans and don't remove each other; in rows that share
a doc_id and differ in text a string is earlier if it starts at a smaller place; an empty table gives an empty result; other columns are ignored. What is kept need not be whole UTF-8 characters.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize, settle, sha256, shared_dir, sliding_min, tasks_for, told_apart, window_hash

LENGTH = 100
GRAM = 28
BUCKET_BYTES = 2 << 20
FLUSH_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20

BLOBS = "bucket int, blob binary"
PLACES = "hi long, lo long, doc_id long, variant long, start int"
CUTS = f"{BLOBS}, {PLACES}"
FOUND = "hi long, lo long, at array<int>, n array<int>, first_doc array<long>, shift array<int>"


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    k = 0
    while k < len(texts):
        stop, size = k, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) < CHUNK_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        yield k, stop
        k = stop


def minimisers(texts: list[bytes], length: int, gram: int):
    """Of the texts, joined by one byte: sizes, starts, gram hashes, and each string's minimiser and whether it lies in one text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
    grams = window_hash(raw, gram)
    whole = np.zeros(max(0, len(raw) - length + 1), bool)
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if n >= length:
            whole[a : a + n - length + 1] = True
    return sizes, starts, grams, sliding_min(grams, length - gram + 1), whole


def minimiser_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, n): places of minimisers, summed within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = length - gram + 1
        for batch in batches:
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for k, stop in chunks(texts):
                _, _, grams, least, whole = minimisers(texts[k:stop], length, gram)
                if not whole.any():
                    continue
                # a gram is a minimiser if it is the least of some string, hence the largest of the leasts around it
                most = ~np.where(whole, least, np.uint64(0))
                pad = np.full(w - 1, ~np.uint64(0), np.uint64)
                around = ~sliding_min(np.concatenate((pad, most, pad)), w)
                keys, n = np.unique(grams[: len(around)][around == grams[: len(around)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, n long")


def string_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, doc_id, variant, start, n): runs of n consecutive strings with one minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variants = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            for k, stop in chunks(texts):
                _, starts, _, least, whole = minimisers(texts[k:stop], length, gram)
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                key = least[at]
                head = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1))))
                n = np.diff(np.concatenate((head, [len(at)])))
                own = np.searchsorted(starts, at[head], "right") - 1
                cols = [key[head].view(np.int64), ids[k:stop][own], variants[k:stop][own], (at[head] - starts[own]).astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "doc_id", "variant", "start", "n"])

    return docs.select("doc_id", "text", "variant").mapInArrow(run, "key long, doc_id long, variant long, start int, n int")


def cuts(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """CUTS of rows (doc_id, variant, text, runs): blobs of distinct cuts for the buckets, and every place of a cut."""

    def blob(held: dict[bytes, list[int]]) -> bytes:
        import zstandard

        places = np.array(list(held.values()), np.int64)
        sizes = np.fromiter(map(len, held), np.int32, len(held))
        return zstandard.ZstdCompressor(level=3).compress(np.array([len(held)], np.int64).tobytes() + places.tobytes() + sizes.tobytes() + b"".join(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[int, dict[bytes, list[int]]] = {}
        size = 0
        names = ["bucket", "blob", "hi", "lo", "doc_id", "variant", "start"]

        def flush() -> pa.RecordBatch:
            none = [None] * len(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), pa.array([blob(x) for x in held.values()], pa.binary()), *[pa.array(none, t) for t in (*[pa.int64()] * 4, pa.int32())]], names=names
            )
            held.clear()
            return out

        for batch in batches:
            digests, doc_ids, variants, starts = [], [], [], []
            for doc, variant, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text.encode("utf-8", "replace")
                for x in runs:
                    start, cut = x["start"], text[x["start"] : x["start"] + x["n"] + length - 1]
                    here = held.setdefault((x["key"] & 0x7FFFFFFFFFFFFFFF) % buckets, {})
                    seen = here.get(cut)
                    if seen is None:
                        here[cut] = [doc, start, doc, start]
                        size += len(cut)
                    elif (doc, start) < (seen[0], seen[1]):
                        seen[:2] = doc, start
                    elif (doc, start) > (seen[2], seen[3]):
                        seen[2:] = doc, start
                    digests.append(xxhash.xxh3_128_digest(cut))
                    doc_ids.append(doc)
                    variants.append(variant)
                    starts.append(start)
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
            pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            none = [None] * len(starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(none, pa.int32()), pa.array(none, pa.binary()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(doc_ids, pa.int64()), pa.array(variants, pa.int64()), pa.array(starts, pa.int32())], names=names
            )
        if held:
            yield flush()

    return rows.select("doc_id", "variant", "text", "runs").mapInArrow(run, CUTS)


def materialize_parts(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blobs and the places of cuts, written in one pass into two folders."""
    spark = made.sparkSession
    path = f"{shared_dir(spark)}/orrery-cuts-{uuid.uuid4().hex}"
    made.withColumn("kind", F.when(F.col("bucket").isNull(), "places").otherwise("blobs")).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    out = []
    for kind, schema in (("blobs", BLOBS), ("places", PLACES)):
        # an empty result has no folder for a kind
        part = spark.read.schema(f"{schema}, kind string").parquet(path).filter(F.col("kind") == kind).drop("kind")
        part.orrery_path = f"{path}/kind={kind}"
        out.append(part)
    return out[0], out[1]


def suffix_order(raw: np.ndarray) -> np.ndarray:
    """The full suffix order of raw by prefix doubling from 8 bytes; only what is still tied is sorted again."""
    n = len(raw)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    ranked = key[order]
    # a suffix of under 8 bytes ties with one that goes on with zero bytes; it is shorter and found out by what follows
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots = tied(head)
    h = 8
    while len(slots):
        at = order[slots]
        follows = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        short = at + h >= n
        follows[short] = -(at[short] + 1)  # the later a suffix starts, the shorter and so the smaller it is
        pair = (rank[at] << 32) + (follows + (n + 1))  # both are below 2**31
        both = np.argsort(pair)
        at, pair = at[both], pair[both]
        order[slots] = at
        new = np.concatenate(([True], pair[1:] != pair[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate((first, [len(slots)])))
        slots = slots[np.repeat(size > 1, size)]
        h *= 2
    return order


def tied(head: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(head)
    size = np.diff(np.concatenate((first, [len(head)])))
    return np.flatnonzero(np.repeat(size > 1, size))


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with the ends of its runs as samples.

    The suffix order is only a step of the building: what stays is, by place in the text, the suffix at each run's head and the one above it,
    which ends the run before. Both what a suffix matches and which one stands above it are streamed from there: within a run the suffix that begins
    a byte later has the neighbour that begins a byte later.
    """

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        order = suffix_order(raw)
        before = np.where(order > 0, raw[order - 1].astype(np.int16), -1)
        head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.symbols, self.lengths = before[head], np.diff(np.append(head, len(raw)))
        sampled, above = order[head], np.where(head > 0, order[head - 1], -1)
        by_place = np.argsort(sampled)
        self.sampled, self.above = sampled[by_place], above[by_place]

    def matching(self) -> np.ndarray:
        """For every place the length that it matches its neighbour above in suffix order."""
        n = len(self.raw)
        at, other = self.sampled[self.above >= 0], self.above[self.above >= 0]
        length = np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        padded = np.concatenate((self.raw, np.zeros(8, np.uint8))).astype(np.uint8)
        eight = np.zeros(n + 1, np.uint64)
        for k in range(8):
            eight[:n] |= padded[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        while len(alive):
            i, j = at[alive] + length[alive], other[alive] + length[alive]
            room = np.minimum(n - i, n - j)
            differ = eight[np.minimum(i, n)] ^ eight[np.minimum(j, n)]
            equal = np.where(differ == 0, 8, 0)
            odd = np.flatnonzero(differ)
            low = differ[odd] & (~differ[odd] + np.uint64(1))
            equal[odd] = np.log2(low.astype(np.float64)).astype(np.int64) // 8
            equal = np.minimum(equal, np.maximum(room, 0))
            length[alive] += equal
            alive = alive[(equal == 8) & (length[alive] < n)]
        # streamed: a place that is no sample matches one byte less than the place before it
        reach = np.full(n, -1, np.int64)
        reach[at] = at + length
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)

    def neighbour(self, places: np.ndarray) -> np.ndarray:
        """For each place the one above it in suffix order, -1 for the first."""
        run = np.searchsorted(self.sampled, places, "right") - 1
        return np.where(self.above[run] < 0, -1, self.above[run] + places - self.sampled[run])


#: Stands between cuts: no byte of UTF-8, so no match of whole strings runs over it.
APART = b"\xff"


def first_places(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int):
    """For every string of length bytes in the cuts, in order: its cut, its place there, and the earliest document and start of it."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    base = np.cumsum(sizes + 1) - sizes - 1
    index = RunIndex(np.frombuffer(APART.join(strings), np.uint8))
    have = sizes - length + 1
    owner = np.repeat(np.arange(len(strings)), have)
    place = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
    mine = base[owner] + place
    # document and start in one number, so that the least is the earliest
    known, rank = np.unique(docs, return_inverse=True)
    first = np.full(len(index.raw), np.iinfo(np.int64).max)
    first[mine] = (rank[owner] << 32) + starts[owner] + place
    # equal strings are neighbours in suffix order: each links to the one above it, and all find the first of their stretch by doubling
    same = np.flatnonzero(index.matching() >= length)
    top = np.arange(len(index.raw))
    top[same] = index.neighbour(same)
    open_ = same
    while len(open_):
        up = top[top[open_]]
        moved = up != top[open_]
        top[open_] = up
        open_ = open_[moved]
    np.minimum.at(first, top[same], first[same])
    found = first[top[mine]]
    return owner, place, known[found >> 32], found & 0xFFFFFFFF


def earliest(blobs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for blob in batch.column(0):
                raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                places = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4).tolist()
                at = 8 + 36 * n
                for place, size in zip(places, np.frombuffer(raw, np.int32, n, 8 + 32 * n).tolist(), strict=True):
                    cut = raw[at : at + size]
                    at += size
                    seen = held.get(cut)
                    if seen is None:
                        held[cut] = place
                    else:
                        seen[:2] = min(seen[:2], place[:2])
                        seen[2:] = max(seen[2:], place[2:])
        if not held:
            return
        strings, places = list(held), np.array(list(held.values()), np.int64)
        del held
        owner, place, first_doc, first_start = first_places(strings, places[:, 0], places[:, 1], length)
        shift = first_start - place
        head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (first_doc[1:] != first_doc[:-1]) | (shift[1:] != shift[:-1]))))
        n = np.diff(np.concatenate((head, [len(owner)])))
        last_doc, last_start = places[owner[head], 2], places[owner[head], 3]
        use = (first_doc[head] < last_doc) | ((first_doc[head] == last_doc) & (shift[head] < last_start))
        head, n = head[use], n[use]
        if not len(head):
            return
        own = owner[head]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(strings[k]) for k in own[new].tolist()), np.int64).reshape(-1, 2)
        offsets = pa.array(np.concatenate((new, [len(own)])).astype(np.int32))
        cols = ((place[head].astype(np.int32), pa.int32()), (n.astype(np.int32), pa.int32()), (first_doc[head], pa.int64()), (shift[head].astype(np.int32), pa.int32()))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in cols]
        yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), *lists], names=["hi", "lo", "at", "n", "first_doc", "shift"])

    return blobs.mapInArrow(run, FOUND)


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, variant, spans) of rows (doc_id, text, variant): byte ranges [a, b) of each text that start earlier too; texts without any are left out."""
    spark = docs.sparkSession
    rows = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    shared = materialize(minimiser_counts(rows, length, gram).groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key"), "keys")
    settle(spark)
    hit = string_runs(rows, length, gram).join(shared, "key", "left_semi")
    runs = materialize(hit.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("key", "start", "n")).alias("runs")), "runs")
    discard(shared)
    settle(spark)
    total = runs.agg(F.coalesce(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["n"] + (length - 1))), F.lit(0)).alias("b")).first()["b"]
    tasks = max(tasks_for(total, BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blobs, places = materialize_parts(cuts(rows.join(runs, ["doc_id", "variant"]), 4 * tasks, length))
    discard(runs)
    settle(spark)
    found = materialize(earliest(blobs.repartition(tasks, "bucket").select("blob"), length), "first")
    discard(blobs)
    settle(spark)
    earlier = F.filter(F.arrays_zip("at", "n", "first_doc", "shift"), lambda x: (x["first_doc"] < F.col("doc_id")) | ((x["first_doc"] == F.col("doc_id")) & (x["shift"] < F.col("start"))))
    marked = places.join(found, ["hi", "lo"]).select("doc_id", "variant", "start", earlier.alias("runs")).filter(F.size("runs") > 0)
    each = F.transform("runs", lambda x: F.struct((F.col("start") + x["at"]).alias("a"), (F.col("start") + x["at"] + x["n"] + (length - 1)).alias("b")))
    return marked.select("doc_id", "variant", each.alias("spans")).groupBy("doc_id", "variant").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            flat, offsets = batch.column(2).values, batch.column(2).offsets.to_numpy()
            a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                data = (text or "").encode("utf-8", "replace")
                kept, n_spans = data, 0
                if offsets[k + 1] > offsets[k]:
                    at = slice(offsets[k], offsets[k + 1])
                    marks = np.zeros(len(data) + 1, np.int64)
                    np.add.at(marks, np.minimum(a[at], len(data)), 1)
                    np.add.at(marks, np.minimum(b[at], len(data)), -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    n_spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
                out.append((doc, len(data), len(data) - len(kept), n_spans, sha256(kept), kept))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = told_apart(docs)
    found = spans(rows, length, gram)
    empty = F.array().cast("array<struct<a:int,b:int>>")
    joined = rows.join(found, ["doc_id", "variant"], "left").select("doc_id", "text", F.coalesce("spans", empty).alias("spans"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
