"""Operator 2: substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Consecutive windows with the same minimiser (the least hash of
their GRAM-word grams) form a super-k-mer, which travels as one packed string to the bucket of its minimiser: equal
windows have equal minimisers, so they meet there. A task packs equal strings once, with the least and largest
doc_id that it has seen them in, and a bucket again keeps every distinct string once, so the copies of a passage never
gather: what a bucket holds is bounded by its distinct strings. There all windows are sorted by hash, equal ones are
confirmed byte by byte, and each run of windows gets the least doc_id that its words start in.

Only runs that can remove something leave the bucket, keyed by the string's 128-bit hash. A second pass over the texts
yields (string, doc_id, place) and an equi-join, which Spark can split for a frequent string, brings each document
the windows that start in a smaller doc_id. Texts are shuffled once, by doc_id, to meet their removed words.

Cases: null, empty and short texts have no window and lose nothing; rows with a null doc_id are kept as they are and
remove nothing; rows that share a doc_id don't remove each other's words, each text loses its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Words, materialize, sha256, sliding_min, tasks_for, told_apart, window_hash

WINDOW = 50
GRAM = 4
BUCKET_BYTES = 8 << 20
EXPANSION = 3.2
FLUSH_BYTES = 6 << 20
CHUNK_BYTES = 1 << 20
LEVEL = 3

FOUND = "hi long, lo long, at array<int>, n array<int>, first array<long>"
PLACES = "hi long, lo long, doc_id long, variant long, start int"


def super_kmers(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[bytes, Words, np.ndarray, np.ndarray, np.ndarray] | None:
    """The text with single spaces, its words, and first window, last window and minimiser of each super-k-mer."""
    text = b" ".join(text.split())
    if text.count(b" ") < window - 1:
        return None
    words = Words(text)
    least = sliding_min(window_hash(words.hash, gram), window - gram + 1)
    cut = np.flatnonzero(least[1:] != least[:-1])
    return text, words, np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(least) - 1])), least


def strings_of(text: bytes, window: int, gram: int) -> Iterator[tuple[int, bytes, int]]:
    """Start, packed string and minimiser of each super-k-mer."""
    found = super_kmers(text, window, gram)
    if found:
        text, words, first, last, least = found
        a, b = words.start[first].tolist(), words.end[last + window - 1].tolist()
        for start, x, y, key in zip(first.tolist(), a, b, least[first].tolist(), strict=True):
            yield start, text[x:y], key


def packed(docs: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """(bucket, blob): the distinct super-k-mers that a task has for a bucket, compressed together."""

    def blob(held: dict[bytes, list[int]]) -> bytes:
        import zstandard

        bounds = np.array(list(held.values()), np.int64)
        sizes = np.fromiter(map(len, held), np.int32, len(held))
        head = np.array([len(held)], np.int64)
        return zstandard.ZstdCompressor(level=LEVEL).compress(head.tobytes() + bounds.tobytes() + sizes.tobytes() + b"".join(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[bytes, list[int]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([blob(x) for x in held.values()], pa.binary())], names=["bucket", "blob"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text.encode("utf-8", "replace")
                for _, string, key in strings_of(text, window, gram):
                    here = held.setdefault(key % buckets, {})
                    seen = here.get(string)
                    if seen is None:
                        here[string] = [doc, doc]
                    elif doc < seen[0]:
                        seen[0] = doc
                    elif doc > seen[1]:
                        seen[1] = doc
                size += len(text)
                if size >= FLUSH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket int, blob binary")


def unpack(blob: bytes) -> Iterator[tuple[bytes, int, int]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    bounds = np.frombuffer(raw, np.int64, 2 * n, 8).tolist()
    sizes = np.frombuffer(raw, np.int32, n, 8 + 16 * n).tolist()
    at = 8 + 20 * n
    for k, size in enumerate(sizes):
        yield raw[at : at + size], bounds[2 * k], bounds[2 * k + 1]
        at += size


def first_starts(strings: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the strings: its string, its place there, the least of docs over the strings with that window."""
    hashes, owners, places, spots, stops = [], [], [], [], []
    k = base = 0
    while k < len(strings):
        stop, size = k, 0
        while stop < len(strings) and (size == 0 or size + len(strings[stop]) < CHUNK_BYTES):
            size += len(strings[stop]) + 1
            stop += 1
        words = Words(b" ".join(strings[k:stop]))
        counts = np.array([s.count(b" ") + 1 for s in strings[k:stop]])
        have = counts - window + 1
        own = np.repeat(np.arange(k, stop), have)
        place = np.arange(have.sum()) - np.repeat(np.cumsum(have) - have, have)
        at = np.repeat(np.cumsum(counts) - counts, have) + place
        hashes.append(window_hash(words.hash, window)[at])
        owners.append(own)
        places.append(place)
        spots.append(words.start[at] + base)
        stops.append(words.end[at + window - 1] + base)
        base += len(words.data) + 1
        k = stop
    if not hashes:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    key, owner, place, a, b = map(np.concatenate, (hashes, owners, places, spots, stops))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    size = np.diff(np.concatenate((head, [len(order)])))
    least = np.minimum.reduceat(docs[owner[order]], head)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(least, size)
    confirm(b" ".join(strings), order, head, size, a, b, docs[owner], first)
    return owner, place, first


def confirm(text: bytes, order, head, size, a, b, doc, first) -> None:
    """Compares windows of equal hash byte by byte with the first of them; those of unequal words are told apart."""
    raw = np.frombuffer(text, np.uint8)
    many = np.flatnonzero(size > 1)
    group = np.repeat(many, size[many])
    member = order[np.repeat(head[many], size[many]) + np.arange(len(group)) - np.repeat(np.cumsum(size[many]) - size[many], size[many])]
    model = order[head[group]]
    wrong = set(group[(b - a)[member] != (b - a)[model]].tolist())
    lengths = (b - a)[member]
    for lo in range(0, len(member), 3_000):
        m, r, n, g = member[lo : lo + 3_000], model[lo : lo + 3_000], lengths[lo : lo + 3_000], group[lo : lo + 3_000]
        fine = (b - a)[r] == n
        m, r, n, g = m[fine], r[fine], n[fine], g[fine]
        if not len(m):
            continue
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        same = np.logical_and.reduceat(raw[np.repeat(a[m], n) + step] == raw[np.repeat(a[r], n) + step], np.cumsum(n) - n)
        wrong |= set(g[~same].tolist())
    for g in wrong:
        of: dict[bytes, list[int]] = {}
        for i in order[head[g] : head[g] + size[g]].tolist():
            of.setdefault(text[a[i] : b[i]], []).append(i)
        for same in of.values():
            first[same] = doc[same].min()


def counted(blobs: DataFrame, window: int) -> DataFrame:
    """FOUND: of each string the runs of windows that start in a doc_id smaller than the largest that has the string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[bytes, list[int]] = {}
        for batch in batches:
            for blob in batch.column(0):
                for string, low, high in unpack(blob.as_py()):
                    seen = held.get(string)
                    if seen is None:
                        held[string] = [low, high]
                    else:
                        seen[0], seen[1] = min(seen[0], low), max(seen[1], high)
        if not held:
            return
        strings, bounds = list(held), np.array(list(held.values()), np.int64)
        del held
        owner, place, first = first_starts(strings, bounds[:, 0], window)
        edge = np.concatenate(([True], (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])))
        at = np.flatnonzero(edge)
        n = np.diff(np.concatenate((at, [len(owner)])))
        use = first[at] < bounds[owner[at], 1]
        at, n = at[use], n[use]
        if not len(at):
            return
        own = owner[at]
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ids = [xxhash.xxh3_128_digest(strings[k]) for k in own[new].tolist()]
        ids = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
        offsets = pa.array(np.concatenate((new, [len(own)])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((place[at].astype(np.int32), pa.int32()), (n.astype(np.int32), pa.int32()), (first[at], pa.int64()))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]), *lists], names=["hi", "lo", "at", "n", "first"])

    return blobs.mapInArrow(run, FOUND)


def places(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, doc_ids, variants, starts = [], [], [], []
            for doc, text, variant in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, string, _ in strings_of(text.encode("utf-8", "replace"), window, gram):
                    ids.append(xxhash.xxh3_128_digest(string))
                    doc_ids.append(doc)
                    variants.append(variant)
                    starts.append(start)
            pairs = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(doc_ids, pa.int64()), pa.array(variants, pa.int64()), pa.array(starts, pa.int32())], names=["hi", "lo", "doc_id", "variant", "start"])

    return docs.select("doc_id", "text", "variant").mapInArrow(run, PLACES)


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, variant, spans) of rows (doc_id, text, variant): the runs of words [a, b) of each text that a smaller doc_id has too; texts without any are left out."""
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    tasks = max(tasks_for(int(total * EXPANSION), BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blobs = packed(rows.select("doc_id", "text"), 4 * tasks, window, gram).repartition(tasks, "bucket").select("blob")
    found = materialize(counted(blobs, window), "windows")
    runs = F.filter(F.arrays_zip("at", "n", "first"), lambda x: x["first"] < F.col("doc_id"))
    hit = places(rows, window, gram).join(found, ["hi", "lo"]).select("doc_id", "variant", "start", runs.alias("runs")).filter(F.size("runs") > 0)
    each = F.transform("runs", lambda x: F.struct((F.col("start") + x["at"]).alias("a"), (F.col("start") + x["at"] + x["n"] + (window - 1)).alias("b")))
    return hit.select("doc_id", "variant", each.alias("spans")).groupBy("doc_id", "variant").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and kept, the words that are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            offsets, flat = None, None
            spans_of = batch.column(2)
            flat = spans_of.values
            offsets = spans_of.offsets.to_numpy()
            a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                words = (text or "").encode("utf-8", "replace").split()
                n = len(words)
                if offsets[k + 1] > offsets[k]:
                    at = slice(offsets[k], offsets[k + 1])
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, np.minimum(a[at], n), 1)
                    np.add.at(marks, np.minimum(b[at], n), -1)
                    gone = np.cumsum(marks[:-1]) > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), sha256(kept), kept.decode()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    rows = told_apart(docs)
    joined = rows.join(spans(rows, window, gram), ["doc_id", "variant"], "left")
    empty = F.array().cast("array<struct<a:int,b:int>>")
    return joined.select("doc_id", "text", F.coalesce("spans", empty).alias("spans")).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
