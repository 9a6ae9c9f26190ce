"""Operators 11 to 13 against plain Python versions, and their odd cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import classifier, clusters, middles

VECTORS = "vec_id long, embedding array<double>, cluster string, distance int"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# --- 11 ---


def by_all_centroids(rows, k, rounds, dims):
    """One vector after the other against every centroid, in Python integers."""
    kept = [(i, [int(np.floor(min(max(64.0 * x, -(10.0**18)), 10.0**18))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    ids = sorted((x for x in kept), key=lambda x: (x[0] is None, sha(f"1:{x[0]}"), x[1]))
    centres = [v for _, v in ids[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c for j, c in enumerate(centres)]
    last = [(i, *nearest(v)) for i, v in kept]
    top = (1 << 63) - 1
    inertia = defaultdict(int)
    for _, d, j in last:
        inertia[j] += min(d, top)
    return sorted((str(i), j, min(d, top), min(inertia[j], top), min(sum(inertia.values()), top), sha(",".join(map(str, centres[j])))) for i, d, j in last)


def clustered(df, **kind):
    return sorted((str(x.vec_id), x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in clusters.cluster(df, **kind).collect())


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_clusters(spark, spread):
    """Unit vectors, and vectors of very different norms; ids repeated, rows repeated, and components on a coarse grid, so that distances tie."""
    r = np.random.default_rng(5)
    rows = []
    for k in range(300):
        v = np.round(r.normal(size=8) * np.exp(spread * r.normal()), 1)
        rows.append((k - k % 7 * (k % 50 == 0), v.tolist()))
    rows += rows[:20] + [(None, [0.5] * 8), (None, None), (900, [1.0] * 7), (901, [1.0] * 9), (902, [None] + [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, []), (906, [0.0] * 8)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], VECTORS).repartition(3)
    assert clustered(df, k=6, rounds=3, dims=8) == by_all_centroids(rows, 6, 3, 8)


def test_clusters_of_huge_and_few_vectors(spark):
    """Components beyond what doubles hold exactly, and beyond longs; fewer vectors than centroids; none."""
    rows = [(1, [1e300, -1e300]), (2, [3e14, 5.0]), (3, [3e14, 5.03]), (4, [7.0, 3e9]), (5, [7.0, 3e9 + 1]), (6, [-1e-9, 0.0])]
    df = spark.createDataFrame([(*x, None, None) for x in rows], VECTORS)
    assert clustered(df, k=3, rounds=2, dims=2) == by_all_centroids(rows, 3, 2, 2)
    assert clustered(df, k=99, rounds=2, dims=2) == by_all_centroids(rows, 99, 2, 2)
    assert clusters.cluster(df.filter("vec_id > 9"), dims=2).count() == 0


def test_annuli_leave_centroids_out_and_keep_ties():
    r = np.random.default_rng(8)
    centres = [[int(x) for x in r.integers(-9, 9, 4) * 4**k] for k in range(6) for _ in range(5)]
    centres += centres[:3]  # equal ones: the first counts
    x = np.concatenate([r.integers(-9, 9, (200, 4)) * 4**k for k in range(6)])
    annuli = clusters.Annuli(centres)
    number, distance = annuli.nearest(x)
    every = ((x[:, None] - np.array(centres)[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (number == every.argmin(1)).all()
    assert annuli.compared < 0.6 * every.size


# --- 12 ---


def by_hand(doc, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_middles(spark):
    """Odd characters, line ends, pieces of sentinels, sentinels themselves, one character, empty and null texts, a very long text, repeated ids."""
    r = random.Random(3)
    odd = ["", None, "a", "😀", "é\n😀\r\n x", "<P", "P>", "<", "<<S", "S><M", "<P>", "a<M>b", "<S><P>", "< P>", "\x00a\x00", "$1 \\1 (.*) |", "<P<S<M" * 20, "é" * 30]
    texts = odd * 20 + ["".join(r.choice("<>PSM ab😀\n") for _ in range(r.randrange(40))) for _ in range(400)] + ["wörd😀 " * 60_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, "again"), (7, "again"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, units int, h string")
    got = middles.divided(df).withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: str(x)
    assert sorted(((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got), key=key) == sorted(((d, *by_hand(d, t)) for d, t in rows), key=key)
    assert all(x.back == x.text for x in got)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert middles.divided(df.filter("doc_id > 9999")).count() == 0


# --- 13 ---


def words_of(text: str) -> list[bytes]:
    """Words as the docstring has them, with AGAIN for those that equal one of the two before."""
    words = re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\t-\r ]+", text.encode())
    words = [re.sub(rb"[0-9]", b"0", w) for w in words]
    return [b"AGAIN" if w in words[max(0, k - 2) : k] else w for k, w in enumerate(words)]


def test_contexts(spark):
    """Sums of index vectors, by a dictionary of words; equal in one partition and in many."""
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "bb", "Bb", "c1", "22", "99", "é!!", "x-y", "|", "a a"]) for _ in range(r.randrange(30))) for _ in range(80)] + [None, "", "\n \t", "1"]
    at, sign = classifier.index_vectors()
    place = {b"AGAIN": classifier.AGAIN}
    for w in {w for t in texts for w in words_of(t or "")} - {b"AGAIN"}:
        place[w] = int(classifier.places(w, np.zeros(1, int))[0][0])
    assert len(set(place.values())) == len(place)
    want = np.zeros((classifier.WORDS, classifier.DIMS + 1), np.int64)
    for t in texts:
        words = [place[w] for w in words_of(t or "")]
        for k, w in enumerate(words):
            want[w, -1] += 1
            for o in words[max(0, k - classifier.REACH) : k] + words[k + 1 : k + 1 + classifier.REACH]:
                want[w, at[o]] += sign[o].astype(int)
    for n in (1, 5):
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(n)
        assert (classifier.contexts(df) == want).all()


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(classifier, "PIECE", 64)
    texts = ["word " * 50, "x" * 200, None, "", "a b", "é" * 40]
    got = defaultdict(bytes)
    for data, starts, number in classifier.pieces(texts):
        assert len(data) <= 64
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data) + 1])):
            got[number[k]] += data[a : b - 1]
    assert [got[k].decode() for k in range(len(texts))] == [t or "" for t in texts]
    vectors = classifier.word_vectors(np.ones((classifier.WORDS, classifier.DIMS + 1), np.int64))
    x = classifier.features(texts, vectors)
    assert x.shape == (len(texts), 2 * classifier.DIMS + 1) and np.isfinite(x).all() and (x[[2, 3]] == 0).all() and np.isclose(np.expm1(x[0, -1]), 50)


@pytest.fixture(scope="module")
def labelled(spark):
    """Good prose; bad texts repeat words, shout or hold a list. A tenth has no label."""
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice(["an", "the", "or", "is", "on", "re"]) for _ in range(r.randrange(1, 4))) for _ in range(n)) + "."
    docs, labels = [], []
    for k in range(1500):
        t, bad = prose(r.randrange(10, 120)), k % 6 == 0
        if bad:
            t = r.choice([lambda t: " ".join(w for w in t.split() for _ in range(9)), lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | ")])(t)
        docs.append((k, t, "xx", "s", len(t)))
        if k % 10:
            labels.append((k, int(not bad), 0))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, score long"


def test_held_out_accuracy_and_calibration(spark, labelled):
    docs, labels = labelled
    df, known = spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in classifier.classify(df, known).collect()}
    assert set(got) == set(range(1500)) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, x in got.items())
    test = [(got[k].score, q) for k, q, _ in labels if got[k].held_out]
    assert len(test) > 200 and np.mean([(s >= 0.3) == (q == 1) for s, q in test]) > 0.98
    assert abs(np.mean([s for s, _ in test]) - np.mean([q for _, q in test])) < 0.05
    # labels of held out rows don't matter, nor do rows' order and partitions
    flipped = spark.createDataFrame([(k, 1 - q if got[k].held_out else q, 0) for k, q, _ in labels], "doc_id long, quality int, toxic int")
    again = {x.doc_id: x.score for x in classifier.classify(df.orderBy(F.desc("doc_id")).repartition(2), flipped).collect()}
    assert all(abs(again[k] - x.score) < 1e-6 for k, x in got.items())


def test_temperature():
    """Logits that are three times too steep are divided by about three."""
    r = np.random.default_rng(2)
    z = r.normal(0, 2, 20_000)
    y = (r.random(len(z)) < 1 / (1 + np.exp(-z))).astype(int)
    best = min(np.exp(np.linspace(-2, 3, 101)), key=lambda k: classifier.loss(3 * z / k, y, np.ones(len(z))))
    assert 2.7 < best < 3.3
    x = r.normal(size=(3000, 5))
    y = (r.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    m = classifier.train(x, y, 0.5)
    z = r.normal(size=(3000, 5))
    assert np.abs(m.scores(z) - 1 / (1 + np.exp(-2 * z[:, 0]))).mean() < 0.08


def test_quality_on_odd_tables(spark, labelled):
    docs, labels = labelled
    schema = "doc_id long, quality int, toxic int"
    odd = docs[:200] + docs[:3] + [(None, "no id", None, None, None), (2000, None, None, None, None), (2001, "", None, None, None), (2002, "word " * 200_000, None, None, None), (5, "another text of five", None, None, None)]
    df = spark.createDataFrame(odd, DOCS)
    more = labels[:200] + labels[:5] + [(None, 0, 0), (3, None, 0), (4, 7, 0), (6, 0, 0), (6, 1, 0), (99_999, 1, 0)]
    got = classifier.classify(df, spark.createDataFrame(more, schema)).collect()
    assert len(got) == len(odd) and all(0 <= x.score <= 1 for x in got)
    assert [x.held_out for x in got if x.doc_id is None] == [False]
    empty = spark.createDataFrame([], DOCS)
    assert classifier.classify(empty, spark.createDataFrame([], schema)).count() == 0
    for some, share in (([], 0.5), ([(k, 1, 0) for k in (1, 2, 3, 4)], None)):
        scores = {x.score for x in classifier.classify(df, spark.createDataFrame(some, schema)).collect()}
        assert len(scores) == 1 and (share is None or abs(scores.pop() - share) < 1e-9)
    few = classifier.chosen(spark.createDataFrame(labels, schema), 7)[0].groupBy("y").count().collect()
    assert {(x.y, x["count"]) for x in few} == {(0, 7), (1, 7)}
