"""Operator 3: language identification by nearest centroid.

Letters, lower-cased, with every run of other characters as one blank, are cut into 2- and 3-grams that are hashed
into DIMS places. A text's vector is its logged counts times the inverse document frequency, of unit length. Each
language has several centroids (spherical k-means over a bounded sample of labelled rows); a text goes to the
language of the centroid with the largest cosine, and is rejected where that cosine lies further below the
centroid's usual cosine, for texts of that many n-grams, than a fitted margin allows: SLACK times what all but QUANTILE
of the sample's texts reach that are nearest to their own language. Junk and mislabelled texts are fewer than that, so they don't set it. Every language with a label is learned, however many there are.

The sample holds about SAMPLE rows of each language, taken by a hash of doc_id and text, so it does not depend on the
order or the number of files; rows that are alike in both count once. Prediction reads whole texts and nothing but the text.

Cases: a null text, an empty text and a text without a letter are `und` with score 0 and are rejected; a null lang or
doc_id is never learned from; with no labelled row at all every text is `und`; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize

DIMS = 1 << 14
CENTROIDS = 4
SAMPLE = 600
ROUNDS = 12
MEMBERS = 0.03
QUANTILE = 0.005
SLACK = 0.7
UNDECIDED = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


class Grams:
    """Places and counts of a text's n-grams."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        if not self.known[raw].all():
            for c in np.unique(raw[~self.known[raw]]).tolist():
                self.letter[c], self.known[c] = chr(c).isalpha(), True
        letters = self.letter[raw]
        if not letters.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keep = letters.copy()
        keep[1:] |= letters[:-1]  # the first of every run of other characters
        c = np.where(letters, raw, 32)[keep].astype(np.uint64)
        c = np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))
        two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] * np.uint64(0x165667B19E3779F9) + c[2:] * np.uint64(0x27D4EB2F165667C5)
        counts = np.bincount((np.concatenate((two, three)) >> np.uint64(50)).astype(np.int64), minlength=DIMS)
        at = np.flatnonzero(counts)
        return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # (n, DIMS), unit rows
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    usual: np.ndarray  # (3,) polynomial in log n-grams: the cosine that labelled texts of that size have
    margin: float = 0.0  # share of the usual cosine below which a text is rejected

    def nearest(self, at: np.ndarray, counts: np.ndarray) -> tuple[int, float]:
        v = np.log1p(counts) * self.idf[at]
        cosines = self.centroids[:, at] @ (v / np.linalg.norm(v)).astype(np.float32)
        best = int(cosines.argmax())
        return best, float(min(1.0, max(0.0, cosines[best])))

    def expected(self, counts: np.ndarray) -> float:
        return float(np.polyval(self.usual, np.log(counts.sum())))

    def predict(self, at: np.ndarray, counts: np.ndarray) -> tuple[str, float, bool]:
        if not len(at) or not len(self.owner):
            return UNDECIDED, 0.0, True
        best, score = self.nearest(at, counts)
        return self.languages[self.owner[best]], score, score < self.expected(counts) * self.margin


def spherical(x: np.ndarray, k: int) -> np.ndarray:
    """k-means by cosine. The first centres come from halving the largest cluster along its widest direction, at its middle where a half
    would be tiny; centres that end with under MEMBERS of the rows, as a few mislabelled ones make them, are dropped."""
    near = np.zeros(len(x), int)
    for j in range(1, min(k, len(x))):
        most = np.flatnonzero(near == np.bincount(near).argmax())
        apart = x[most] - x[most].mean(0)
        along = apart[np.linalg.norm(apart, axis=1).argmax()]
        for _ in range(ROUNDS):
            along = apart.T @ (apart @ along)
            along /= max(np.linalg.norm(along), 1e-9)
        place = apart @ along
        high = place > 0
        if min(high.sum(), (~high).sum()) < MEMBERS * len(x):
            high = place > np.median(place)
        near[most[high]] = j
    for _ in range(ROUNDS):
        sums = np.vstack([x[near == j].sum(0) for j in np.unique(near)])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        near = (x @ centres.T).argmax(1)
    held = np.bincount(near, minlength=len(centres))
    return centres[held >= min(MEMBERS * len(x), held.max())]


def fit(docs: DataFrame, every: bool = False) -> Model:
    """Learns from text and lang of labelled rows, about SAMPLE of each language; unless every, of those that are not held out.

    The sample stays on the executors: document frequencies are summed there, a group makes the centroids of one
    language, and the usual cosine and the margin are aggregates. The driver gets DIMS counts and the centroids.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("doc_id").isNotNull() if every else ~held_out(F.col("doc_id"))))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text"), 0.02).alias("n")).collect()}
    none = Model([], np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.ones(DIMS), np.zeros(1))
    if not counts:
        return none
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, SAMPLE / counts[lang]))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(place < share[F.col("lang")]).dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            got = [grams(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([g[k] for g in got], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *cols], names=["doc_id", "lang", "at", "n"])

    found = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, "doc_id long, lang string, at array<int>, n array<int>")
    found = materialize(found.filter(F.size("at") > 0), "grams")
    total = found.count()
    if not total:
        return none
    seen = np.zeros(DIMS)
    for r in found.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("n")).collect():
        seen[r["at"]] = r["n"]
    idf = np.log((1 + total) / (1 + seen)) + 1

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        # only the places that the language's sample has
        used = np.unique(group["at"].combine_chunks().flatten().to_numpy())
        x = np.zeros((len(group), len(used)), np.float32)
        for row, at, n in zip(x, group["at"], group["n"], strict=True):
            at = at.values.to_numpy()
            row[np.searchsorted(used, at)] = np.log1p(n.values.to_numpy()) * idf[at]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = spherical(x, CENTROIDS)
        centres = np.zeros((len(found), DIMS), np.float32)
        centres[:, used] = found
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(centres), pa.string()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    made = sorted((r["lang"], bytes(r["centre"])) for r in found.groupBy("lang").applyInArrow(learn, "lang string, centre binary").collect())
    model = Model(languages, np.stack([np.frombuffer(c, np.float32) for _, c in made]), np.array([languages.index(x) for x, _ in made]), idf, np.zeros(1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = ([np.asarray(x.values) for x in batch.column(k)] for k in (0, 1))
            size = [float(np.log(x.sum())) for x in n]
            near = [model.nearest(p, x) for p, x in zip(at, n, strict=True)]
            own = [model.languages[model.owner[best]] == lang for (best, _), lang in zip(near, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.float64()), pa.array([y for _, y in near], pa.float64()), pa.array(own, pa.bool_())], names=["x", "y", "own"])

    sizes = materialize(found.select("at", "n", "lang").mapInArrow(measure, "x double, y double, own boolean").filter("own"), "cosines")
    sums = sizes.agg(*[F.sum(F.pow("x", F.lit(k))).alias(f"x{k}") for k in range(5)], *[F.sum(F.pow("x", F.lit(k)) * F.col("y")).alias(f"y{k}") for k in range(3)], F.count_distinct("x").alias("sizes")).first()
    if sums["sizes"] > 10:
        model.usual = np.linalg.lstsq([[sums[f"x{j + k}"] for k in (2, 1, 0)] for j in range(3)], [sums[f"y{j}"] for j in range(3)], rcond=None)[0]
        x = F.col("x")
        usual = float(model.usual[0]) * x * x + float(model.usual[1]) * x + float(model.usual[2])
        model.margin = SLACK * sizes.agg(F.percentile_approx(F.col("y") / usual, QUANTILE, 10_000).alias("q")).first()["q"]
    discard(found, sizes)
    return model


def identify(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns keep, then the language, its score and whether it is rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            last = batch.num_columns - 1
            got = [model.predict(*grams(t)) if t else (UNDECIDED, 0.0, True) for t in batch.column(last).to_pylist()]
            lang, score, rejected = zip(*got, strict=True) if got else ((), (), ())
            cols = [batch.column(i) for i in range(last)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, *names])

    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("orrery_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "{} string, {} double, {} boolean".format(*names)])
    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    rows = docs.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    return identify(rows, fit(docs), ["doc_id", "held_out"])


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is identified, with their own columns. Nothing is measured here, so no labelled rows are held out."""
    found = identify(docs, fit(docs, every=True), docs.columns, ("orrery_lang", "orrery_score", "orrery_rejected"))
    return found.filter(~F.col("orrery_rejected")).select(*docs.columns)
