"""Relative poses of image pairs, robustly: hypotheses from a bounded pool of each pair's matches, everything else over all matches.

A pair's matches never meet in one task. Equal matches of a pair become one that weighs as many, before all else: a draw by their
hash would take all of them or none, and eight of them say less than eight different ones. A pool of about POOL matches of each pair,
drawn by a hash, goes to one row, where samples of eight different ones, the heavier the likelier, make essential matrices that are
scored on the pool; the best few are improved on their inliers there. All matches then
judge these by a join with the table of candidates and a sum of truncated errors. The winner is improved on all its inliers: the 45
different entries of the normal matrix of the linear system are sums, so they are partial aggregates, and a row of them gives the
next matrix. It is kept if its error over all matches is smaller. Last, matches vote for one of the four poses of the matrix.

matches: pair, x1, y1, x2, y2 in camera coordinates (pixels less the principal point, over the focal length).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators.joins import small
from orrery.operators.state import discard, materialize

POOL = 256
HYPOTHESES = 1536
#: Of these the best are improved, with limits on squared errors that many times as wide.
STARTS = 24
WIDER = (16, 9, 4, 2, 1, 1, 1)
CANDIDATES = 3
ROUNDS = 2
SAMPLE = 8
#: Fits at the end, and how far their inliers go: squared, three of a normal distribution's deviations, seen from its median square.
FINISH = 3
DEVIATIONS = (3 * 1.4826) ** 2
#: Errors are told apart, where their median is looked for, by that many steps of their binary logarithm.
STEPS = 64

PLACES = [(i, j) for i in range(9) for j in range(i, 9)]


def essential_of(systems: np.ndarray) -> np.ndarray:
    """(n, 3, 3) nearest essential matrices of (n, 9, 9) normal matrices."""
    e = np.linalg.eigh(systems)[1][:, :, 0].reshape(-1, 3, 3)
    u, s, v = np.linalg.svd(e)
    mean = (s[:, 0] + s[:, 1]) / 2
    scaled = np.stack([mean, mean, np.zeros_like(mean)], 1) / np.maximum(np.sqrt(2) * mean, 1e-300)[:, None]
    return (u * scaled[:, None, :]) @ v


def rows_of(x: np.ndarray) -> np.ndarray:
    """Rows of the linear system: entries of E times x2 (x) x1."""
    a, b = np.column_stack([x[:, :2], np.ones(len(x))]), np.column_stack([x[:, 2:], np.ones(len(x))])
    return (b[:, :, None] * a[:, None, :]).reshape(-1, 9)


def errors(e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(n, m) squared Sampson errors of m matches under n matrices."""
    a, b = np.column_stack([x[:, :2], np.ones(len(x))]), np.column_stack([x[:, 2:], np.ones(len(x))])
    ea, eb = a @ e.transpose(0, 2, 1), b @ e
    r = (b[None] * ea).sum(2)
    return r * r / np.maximum((ea[..., :2] ** 2).sum(2) + (eb[..., :2] ** 2).sum(2), 1e-300)


def candidates_of(x: np.ndarray, limit: float, seed: int, copies: np.ndarray | None = None) -> np.ndarray:
    """The best few essential matrices of a pool of different matches (m, 4), each there so many times, improved on their inliers."""
    copies = np.ones(len(x)) if copies is None else copies
    if copies.sum() < SAMPLE:
        return np.zeros((0, 3, 3))
    r = np.random.default_rng(seed)
    system = rows_of(x)
    size = min(SAMPLE, len(x))
    # the least of exponential waiting times: different matches, drawn by their weights one after the other
    waits = -np.log1p(-r.random((HYPOTHESES, len(x)))) / copies
    chosen = system[waits.argpartition(size - 1, 1)[:, :size]]
    e = essential_of(chosen.transpose(0, 2, 1) @ chosen)
    cost = np.concatenate([np.minimum(errors(part, x), limit) @ copies for part in np.array_split(e, 8)])
    found = []
    for k in np.argsort(cost, kind="stable")[:STARTS]:
        now, best, least = e[k], e[k], cost[k]
        for scale in WIDER:  # a matrix of eight noisy matches is far from its own inliers, so the limit starts wide
            near = errors(now[None], x)[0] < limit * scale
            if copies[near].sum() < SAMPLE:
                break
            now = essential_of(((system[near].T * copies[near]) @ system[near])[None])[0]
            if (sum_ := np.minimum(errors(now[None], x)[0], limit) @ copies) < least:
                best, least = now, sum_
        found.append((least, len(found), best))
    return np.array([best for _, _, best in sorted(found, key=lambda f: f[:2])[:CANDIDATES]])


def poses_of(e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The four (R, t) of an essential matrix."""
    u, _, v = np.linalg.svd(e)
    u, v = (m * np.sign(np.linalg.det(m)) for m in (u, v))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    return [(u @ m @ v, s * u[:, 2]) for m in (w, w.T) for s in (1, -1)]


def _matrix(name: str) -> list[list[Column]]:
    return [[F.get(name, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]


def error() -> Column:
    """Squared Sampson error of a match under the matrix in column e."""
    return c.sampson(_matrix("e"), [F.col("x1"), F.col("y1"), F.lit(1.0)], [F.col("x2"), F.col("y2"), F.lit(1.0)])


def scored(matches: DataFrame, candidates: DataFrame, limit: float) -> DataFrame:
    """(pair, e, cost, n_inliers, n): the candidate of each pair with the least sum of errors cut at the limit."""
    each = matches.join(small(candidates), "pair").withColumn("error", F.coalesce(error(), F.lit(limit)))
    sums = each.groupBy("pair", "k", "e").agg(F.sum(F.least("error", F.lit(limit)) * F.col("copies")).alias("cost"), F.sum(F.when(F.col("error") < limit, F.col("copies")).otherwise(0)).alias("n_inliers"), F.sum("copies").alias("n"))
    return sums.groupBy("pair").agg(F.min_by(F.struct("e", "cost", "n_inliers", "n"), F.struct("cost", "k")).alias("x")).select("pair", "x.*")


def improved(matches: DataFrame, best: DataFrame, limit: float | Column) -> DataFrame:
    """(pair, k, e): the matrix of all inliers of each pair's best one as candidate 1, and the best one itself as 0. limit: the same for all pairs, or of best's columns."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    near = matches.join(small(best.select("pair", "e", limit.alias("limit"))), "pair").filter(error() < F.col("limit"))
    a, b = (F.col("x1"), F.col("y1"), F.lit(1.0)), (F.col("x2"), F.col("y2"), F.lit(1.0))
    row = [b[k // 3] * a[k % 3] for k in range(9)]
    sums = near.groupBy("pair").agg(F.array(*[F.sum(F.col("copies") * row[i] * row[j]) for i, j in PLACES]).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(PLACES))
            system = np.zeros((len(flat), 9, 9))
            for k, (i, j) in enumerate(PLACES):
                system[:, i, j] = system[:, j, i] = flat[:, k]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * len(flat), pa.int32()), pa.array(essential_of(system).reshape(-1, 9).tolist(), pa.list_(pa.float64()))], names=["pair", "k", "e"])

    return sums.mapInArrow(run, "pair long, k int, e array<double>").unionByName(best.select("pair", F.lit(0).alias("k"), "e"))


def typical(matches: DataFrame, candidates: DataFrame, limit: float) -> DataFrame:
    """(pair, e, typical): of each pair's candidates with about as many inliers as any the one whose inliers' median error is least, and that error."""
    each = matches.join(small(candidates), "pair").withColumn("error", error()).filter(F.col("error") < limit)
    # the weighted median, up to a step of the logarithm: steps of a candidate are a few thousand at most, however many its matches are
    steps = each.groupBy("pair", "k", "e", F.ceil(F.log2(F.greatest("error", F.lit(1e-60))) * STEPS).alias("step")).agg(F.sum("copies").alias("m"))
    own = Window.partitionBy("pair", "k")
    steps = steps.withColumn("n", F.sum("m").over(own)).withColumn("so_far", F.sum("m").over(own.orderBy("step")))
    sums = steps.filter(2 * F.col("so_far") >= F.col("n")).groupBy("pair", "k", "e", "n").agg(F.pow(F.lit(2.0), F.min("step") / STEPS).alias("typical"))
    sums = sums.withColumn("few", F.col("n") < 0.9 * F.max("n").over(Window.partitionBy("pair")))
    return sums.groupBy("pair").agg(F.min_by(F.struct("e", "typical"), F.struct("few", "typical", "k")).alias("x")).select("pair", "x.*")


def relative_poses(matches: DataFrame, limit: float, seed: int = 1) -> DataFrame:
    """(pair, n, n_inliers, e, rot, t) of each pair with SAMPLE matches or more: limit is a distance in camera coordinates, e and rot are
    row-major, and a point X of the first camera is rot X + t, up to the length of t, in the second one."""
    limit = limit * limit
    rows = matches.select(F.col("pair").cast("long").alias("pair"), *[F.col(k).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    rows = materialize(rows.groupBy("pair", "x1", "y1", "x2", "y2").agg(F.count("*").alias("copies")), "matches")  # read several times
    place = F.pmod(F.xxhash64("x1", "y1", "x2", "y2", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sizes = rows.groupBy("pair").agg(F.sum("copies").alias("n")).filter(F.col("n") >= SAMPLE)
    # of m equal matches m * POOL / n are taken, rounded up as often as the fraction says
    taken = F.when(F.col("n") <= POOL, F.col("copies")).otherwise(F.floor(F.col("copies") * POOL / F.col("n") + 1 - place)).cast("double")
    drawn = rows.join(small(sizes), "pair").withColumn("taken", taken).filter("taken > 0")
    pools = drawn.groupBy("pair").agg(F.array_sort(F.collect_list(F.array("x1", "y1", "x2", "y2", "taken"))).alias("pool"))

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pools = ((pair, np.array(pool)) for pair, pool in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            found = [(pair, candidates_of(pool[:, :4], limit, (seed, pair & 0xFFFFFFFF), pool[:, 4])) for pair, pool in pools]
            flat = [(pair, k, e.reshape(-1).tolist()) for pair, es in found for k, e in enumerate(es)]
            cols = list(zip(*flat, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["pair", "k", "e"])

    # a pool costs as much as many rows: dealt over all tasks, which adaptive execution would not do for so few bytes
    pools = pools.repartition(int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair")
    best = materialize(scored(rows, materialize(pools.mapInArrow(guess, "pair long, k int, e array<double>"), "candidates"), limit), "best")
    for _ in range(ROUNDS):
        new = materialize(improved(rows, best, limit), "candidates")
        last, best = best, materialize(scored(rows, new, limit), "best")
        discard(last, new)
    # wrong matches within the limit pull at the matrix, so the last fits take inliers only up to some of their own deviations
    close = materialize(typical(rows, best.select("pair", F.lit(0).alias("k"), "e"), limit), "close")
    for _ in range(FINISH):
        new = materialize(improved(rows, close, F.least(F.lit(limit), DEVIATIONS * F.col("typical") + F.lit(1e-30))), "candidates")
        last, close = close, materialize(typical(rows, new, limit), "close")
        discard(last, new)
    last, best = best, materialize(scored(rows, close.select("pair", F.lit(0).alias("k"), "e"), limit), "best")
    discard(last, close)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [(pair, k, rot.reshape(-1).tolist(), t.tolist()) for pair, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (rot, t) in enumerate(poses_of(np.array(e).reshape(3, 3)))]
            cols = list(zip(*flat, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())), strict=True)], names=["pair", "k", "rot", "t"])

    poses = best.select("pair", "e").mapInArrow(split, "pair long, k int, rot array<double>, t array<double>").join(best.select("pair", "e"), "pair")
    voters = rows.join(small(poses), "pair").filter(error() < limit)
    a, b = [F.col("x1"), F.col("y1"), F.lit(1.0)], [F.col("x2"), F.col("y2"), F.lit(1.0)]
    ra, t = c.matvec(_matrix("rot"), a), [F.get("t", F.lit(k)) for k in range(3)]
    # depths of the point in both cameras have the signs of these
    turn = c.cross(b, ra)
    front = (c.dot(c.cross(t, b), turn) > 0) & (c.dot(c.cross(t, ra), turn) > 0)
    votes = voters.groupBy("pair", "k", "rot", "t").agg(F.sum(F.when(front, F.col("copies")).otherwise(0)).alias("votes"))
    pose = votes.groupBy("pair").agg(F.max_by(F.struct("rot", "t"), F.struct("votes", -F.col("k"))).alias("x"))
    return best.join(pose, "pair").select("pair", "n", "n_inliers", "e", "x.rot", "x.t")
