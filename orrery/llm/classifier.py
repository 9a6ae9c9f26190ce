"""Operator 13: a quality classifier on random-indexing word vectors.

Words are runs of letters (A-Z, a-z and all beyond ASCII), of digits (each counts as 0) and of other characters that are not
blank; a word that equals one of the two before it counts as the word AGAIN. Words are hashed into WORDS places. Each place
has a fixed index vector, SIGNS places of DIMS with +1 or -1; its context vector is the sum of the index vectors of the
words up to REACH before and after it, over all documents. The mean context is taken off and the rest made of unit length.
A document's features are the mean of its words' vectors, the mean with rare words weighing more, and the logged number of words.

A network of two layers (numpy) learns from up to SAMPLE labelled rows of each class, with weights that restore the classes' shares;
a fifth of them is held back to fit the temperature by which its output is divided, so that scores are probabilities.

Contexts are counted in tasks as one matrix of WORDS x DIMS, handed on in BLOCKS compressed pieces that Spark brings together by block
and a task sums as they come: the size of the table is fixed, whatever the corpus holds. Scoring is one pass without a
shuffle. The driver gets the table, and the features of the sample. Texts are read in pieces of up to PIECE bytes, cut
at a blank if there is one; contexts end there.

Cases: null and empty texts have the features of no word, and a score; a null or other label than 0 and 1, and a null
doc_id, are never learned from; a doc_id with both labels counts as 0; of texts that share a doc_id the one with
the smallest hash is learned from; without labels of both classes every score is the smoothed share of label 1;
repeated rows give repeated results and count in the contexts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import _powers, mix64

WORDS = 1 << 14
DIMS = 64
SIGNS = 4
REACH = 2
BLOCKS = 64
PIECE = 1 << 20
SAMPLE = 4_000
HIDDEN = 32
EPOCHS = 30
BATCH = 128
RATE = 3e-3
DECAY = 1e-4
#: A word of this share of all words weighs half in the second mean.
RARE = 1e-3
THRESHOLD = 0.3
AGAIN = WORDS - 1

KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
LIKE = np.arange(1, 257, dtype=np.uint64)
LIKE[48:58] = 49


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def places(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each word of texts that are joined by a blank and begin at starts, and the number of its text."""
    raw = np.frombuffer(data, np.uint8)
    kind = KIND[raw]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
    begin = edge[kind[edge] > 0]
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.append(edge, len(raw))[np.searchsorted(edge, begin) + 1]
    up, down = _powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LIKE[raw] * up[: len(raw)], dtype=np.uint64)))
    word = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    text = np.searchsorted(starts, begin, "right") - 1
    found = (word % np.uint64(AGAIN)).astype(np.int64)
    for k in (1, 2):
        found[k:][(word[k:] == word[:-k]) & (text[k:] == text[:-k])] = AGAIN
    return found, text


def pieces(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts, or parts of long ones, joined by blanks up to PIECE bytes: the bytes, where each begins, and its number."""
    held, size = [], 0
    for number, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        at = 0
        while at < len(data):
            end = len(data) if len(data) - at <= PIECE else data.rfind(b" ", at, at + PIECE) + 1 or at + PIECE
            if size + end - at > PIECE and held:
                yield joined(held)
                held, size = [], 0
            held.append((number, data[at:end]))
            size += end - at + 1
            at = end
    if held:
        yield joined(held)


def joined(held: list[tuple[int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray]:
    sizes = np.array([len(d) + 1 for _, d in held])
    return b" ".join(d for _, d in held), np.cumsum(sizes) - sizes, np.array([k for k, _ in held])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(WORDS, SIGNS) places of different quarters of an index vector, and their signs."""
    seeds = mix64(np.arange(1, WORDS * SIGNS + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)).reshape(WORDS, SIGNS)
    part = DIMS // SIGNS
    at = (seeds % np.uint64(part)).astype(np.int64) + np.arange(SIGNS) * part
    return at, np.where(seeds >> np.uint64(63), 1.0, -1.0)


class Contexts:
    """Sums of index vectors around each word, and how often it comes."""

    def __init__(self) -> None:
        self.at, self.sign = index_vectors()
        self.sums = np.zeros((WORDS, DIMS + 1), np.int64)

    def add(self, word: np.ndarray, text: np.ndarray) -> None:
        self.sums[:, DIMS] += np.bincount(word, minlength=WORDS)
        for d in range(1, REACH + 1):
            same = np.flatnonzero(text[d:] == text[:-d])
            for a, b in ((word[same], word[same + d]), (word[same + d], word[same])):
                cells = (a[:, None] * DIMS + self.at[b]).ravel()
                self.sums[:, :DIMS] += np.bincount(cells, self.sign[b].ravel(), WORDS * DIMS).astype(np.int64).reshape(WORDS, DIMS)


def contexts(docs: DataFrame) -> np.ndarray:
    """(WORDS, DIMS + 1) sums over all documents."""
    step = WORDS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contexts()
        for batch in batches:
            for data, starts, _ in pieces(batch.column(0).to_pylist()):
                found.add(*places(data, starts))
        full = [k for k in range(BLOCKS) if found.sums[k * step : (k + 1) * step].any()]
        packed = [zlib.compress(found.sums[k * step : (k + 1) * step].tobytes(), 1) for k in full]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(packed, pa.binary())], names=["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
                totals[block] = totals[block] + one if block in totals else one
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], names=["block", "sums"])

    parts = docs.select("text").mapInArrow(count, "block int, sums binary")
    out = np.zeros((WORDS, DIMS + 1), np.int64)
    # BLOCKS rows
    for r in parts.repartition("block").mapInArrow(add, "block int, sums binary").collect():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["sums"], np.int64).reshape(step, DIMS + 1)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """(WORDS, 2 * DIMS + 2): of each place the unit vector, the same times its weight in the second mean, the weight, and 1."""
    n = sums[:, DIMS].astype(np.float64)
    total = max(n.sum(), 1.0)
    apart = sums[:, :DIMS] - n[:, None] * (sums[:, :DIMS].sum(0) / total)
    apart /= np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-9)
    weight = (RARE / (RARE + n / total))[:, None]
    return np.column_stack([apart, apart * weight, weight, np.ones(WORDS)]).astype(np.float32)


def features(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: both means and the logged number of words."""
    sums = np.zeros((len(texts), 2 * DIMS + 2))
    for data, starts, number in pieces(texts):
        word, text = places(data, starts)
        if not len(word):
            continue
        pair, times = np.unique(text * WORDS + word, return_counts=True)
        text = pair // WORDS
        first = np.flatnonzero(np.diff(text, prepend=-1))
        np.add.at(sums, number[text[first]], np.add.reduceat(vectors[pair % WORDS] * times[:, None].astype(np.float32), first))
    n, w = sums[:, -1:], sums[:, -2:-1]
    return np.column_stack([sums[:, :DIMS] / np.maximum(n, 1), sums[:, DIMS : 2 * DIMS] / np.maximum(w, 1e-9), np.log1p(n)])


@dataclass
class Network:
    """tanh units over scaled features, a logit, and a temperature; without weights, the logit of the share."""

    share: float
    scale: tuple[np.ndarray, np.ndarray] | None = None
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), np.log(self.share / (1 - self.share)))
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.scale[0]) / self.scale[1] @ w1 + b1) @ w2[:, 0] + b2[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


def loss(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * np.logaddexp(0, np.where(y == 1, -logits, logits))).sum() / weight.sum())


def train(x: np.ndarray, y: np.ndarray, share: float, seed: int = 1) -> Network:
    """share: of label 1 among all labelled rows; rows of either class weigh so that the sample has it, too."""
    model = Network(share)
    if len(np.unique(y)) < 2:
        return model
    r = np.random.default_rng(seed)
    rest = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[~rest])) < 2:
        rest[:] = False
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    model.scale = x[~rest].mean(0), x[~rest].std(0) + 1e-3
    z, t, u = (x[~rest] - model.scale[0]) / model.scale[1], y[~rest], weight[~rest]
    d = x.shape[1]
    layers = [r.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    mean, square, step = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    for _ in range(EPOCHS):
        order = r.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            hidden = np.tanh(z[rows] @ layers[0] + layers[1])
            out = (hidden @ layers[2])[:, 0] + layers[3][0]
            error = (u[rows] * (1 / (1 + np.exp(-np.clip(out, -500, 500))) - t[rows]) / len(rows))[:, None]
            back = (error @ layers[2].T) * (1 - hidden**2)
            step += 1
            for k, g in enumerate((z[rows].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ error + DECAY * layers[2], error.sum(0))):
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                layers[k] = layers[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    if rest.any():
        logits = model.logits(x[rest])
        model.temperature = min(np.exp(np.linspace(-2, 3, 101)), key=lambda k: loss(logits / k, y[rest], weight[rest]))
    return model


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.network.scores(features(texts, self.vectors))


def chosen(labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """Up to sample doc_ids of each class with their places in the draw, and the sizes of the classes."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = known.select(F.col("doc_id").alias("orrery_id"), "y", F.xxhash64("doc_id").alias("place"))
    parts = [drawn.filter(F.col("y") == y).orderBy("place", "orrery_id").limit(sample) for y in (0, 1)]
    return parts[0].unionByName(parts[1]), counts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Contexts from all documents, the network from up to sample labelled ones of each class that are not held out."""
    vectors = word_vectors(contexts(docs))
    known, counts = chosen(labels, sample)
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) < 2:
        return Model(vectors, Network(share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(4).to_pylist(), vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "y", "place", "key", "x"])

    # 2 x sample ids
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("orrery_id"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "y", "place", F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, y int, place long, key long, x binary")
    got = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.first("place").alias("place"), F.min_by("x", "key").alias("x")).collect()
    got.sort(key=lambda r: (r["place"], r["doc_id"]))
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), 2 * DIMS + 1)
    return Model(vectors, train(x, np.array([r["y"] for r in got]), share))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep, and the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(model.score(batch.column(last).to_pylist()), pa.float64())], names=[*keep, "score"])

    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("orrery_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "score double"])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return scored(rows, fit(docs, labels, sample), ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
