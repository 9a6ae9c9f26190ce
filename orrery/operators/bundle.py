"""Bundle adjustment: Levenberg-Marquardt steps whose points are eliminated and whose cameras are solved for by conjugate gradients.

observations: camera, track, x, y in camera coordinates; cameras: camera, rot (row-major, camera from world), t; points: track, p.
A step linearises every observation once (a row of small blocks). What belongs to a camera or a point alone is summed by it.
The points' 3 x 3 blocks are inverted in their rows and eliminated; the reduced system of the cameras is never formed: its
product with a vector is a join of the observations with the cameras, a sum by track, a join with the tracks and a sum by camera. So a
camera or a track with any share of the observations is a partial aggregation, and the driver sees sums only. A step counts
if the robust cost falls; else its damping grows.

With FEW cameras the observations move once, into a row per track, and are linearised anew in each pass instead of being written: a task
sums the reduced system of the cameras it sees, in blocks by pair of cameras, and these sums are all that is shuffled. The system is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators.rotations import matrix, product, turned_by
from orrery.operators.state import discard, materialize

#: The cameras' system is solved when this share of the squared gradient is left.
ENOUGH = 1e-3
CG_STEPS = 20
DAMPING = 1e-4
UPPER6 = [(i, j) for i in range(6) for j in range(i, 6)]
UPPER3 = [(i, j) for i in range(3) for j in range(i, 3)]
#: Up to so many cameras their reduced system is formed. A track's row then has no more observations than that, unless a camera sees it twice.
FEW = 200
#: So many observations are linearised at once.
AT_ONCE = 1 << 15
HELD = "track long, p array<double>, seen array<struct<camera:int,x:double,y:double>>"
SUMS = "kind int, a int, b int, s array<double>"
LINEAR = "camera long, track long, w array<double>, u array<double>, gc array<double>, v array<double>, gp array<double>, cost double"


def blocks_of(rot: np.ndarray, t: np.ndarray, p: np.ndarray, xy: np.ndarray, huber: float):
    """For n observations: J'J of cameras with points (n, 6, 3), of cameras (n, 6, 6), of points (n, 3, 3), both gradients, and costs. Points behind a camera have no weight and the cost of HUBER's limit."""
    turned = np.einsum("nij,nj->ni", rot, p)
    at = turned + t
    front = at[:, 2] > 1e-6
    z = np.where(front, at[:, 2], 1.0)
    r = at[:, :2] / z[:, None] - xy
    slope = np.zeros((len(z), 2, 3))
    slope[:, 0, 0] = slope[:, 1, 1] = 1 / z
    slope[:, :, 2] = -at[:, :2] / (z * z)[:, None]
    skew = np.zeros((len(z), 3, 3))
    skew[:, 0, 1], skew[:, 0, 2], skew[:, 1, 2] = turned[:, 2], -turned[:, 1], turned[:, 0]
    skew -= skew.transpose(0, 2, 1)
    jc = slope @ np.concatenate([skew, np.broadcast_to(np.eye(3), skew.shape)], 2)
    jp = slope @ rot
    size = np.linalg.norm(r, axis=1)
    weight = np.where(front, np.minimum(1.0, huber / np.maximum(size, 1e-300)), 0.0)
    cost = np.where(front, np.where(size <= huber, size * size / 2, huber * (size - huber / 2)), huber)
    wc, wr = jc * weight[:, None, None], r * weight[:, None]
    return np.einsum("nai,naj->nij", wc, jp), np.einsum("nai,naj->nij", wc, jc), np.einsum("nai,naj->nij", jp * weight[:, None, None], jp), np.einsum("nai,na->ni", jc, wr), np.einsum("nai,na->ni", jp, wr), cost


def linearised(observations: DataFrame, cameras: DataFrame, points: DataFrame, huber: float) -> DataFrame:
    rows = observations.join(cameras, "camera").join(points, "track").select("camera", "track", "rot", "t", "p", F.array("x", "y").alias("xy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            rot, t, p, xy = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for k in range(2, 6))
            w, u, v, gc, gp, cost = blocks_of(rot.reshape(n, 3, 3), t, p, xy, huber)
            flat = [w.reshape(n, 18), u[:, [i for i, _ in UPPER6], [j for _, j in UPPER6]], gc, v[:, [i for i, _ in UPPER3], [j for _, j in UPPER3]], gp]
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64())) for x in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, pa.array(cost)], names=["camera", "track", "w", "u", "gc", "v", "gp", "cost"])

    return rows.mapInArrow(run, LINEAR)


def _sums(name: str, n: int) -> Column:
    return F.array(*[F.sum(F.get(name, F.lit(k))) for k in range(n)]).alias(name)


def _at(name: str, k: int) -> Column:
    return F.get(name, F.lit(k))


def eliminated(lin: DataFrame, damping: float) -> DataFrame:
    """(track, inv, gp): the inverse of each point's damped block."""
    sums = lin.groupBy("track").agg(_sums("v", 6), _sums("gp", 3))
    m = [[_at("v", UPPER3.index((min(i, j), max(i, j)))) * (1 + damping if i == j else 1) + (1e-12 if i == j else 0) for j in range(3)] for i in range(3)]
    cof = [[m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
    det = c.dot(m[0], [cof[k][0] for k in range(3)])
    return sums.withColumn("det", det).select("track", "gp", F.array(*[cof[i][j] / F.col("det") for i in range(3) for j in range(3)]).alias("inv"))


def spread(lin: DataFrame, by_track: DataFrame, vector: str) -> DataFrame:
    """(camera, s): the sum of W z over a camera's observations, for the tracks' vectors z."""
    rows = lin.select("camera", "track", "w").join(by_track.select("track", vector), "track")
    return rows.groupBy("camera").agg(F.array(*[F.sum(c.dot([_at("w", 3 * i + j) for j in range(3)], [_at(vector, j) for j in range(3)])) for i in range(6)]).alias("s"))


def gathered(lin: DataFrame, by_camera: DataFrame, vector: str) -> DataFrame:
    """(track, y): the sum of W' x over a track's observations."""
    rows = lin.select("camera", "track", "w").join(by_camera.select("camera", vector), "camera")
    return rows.groupBy("track").agg(F.array(*[F.sum(c.dot([_at("w", 3 * i + j) for i in range(6)], [_at(vector, i) for i in range(6)])) for j in range(3)]).alias("y"))


def times_inverse(vector: str) -> Column:
    return F.array(*[c.dot([_at("inv", 3 * i + j) for j in range(3)], [_at(vector, j) for j in range(3)]) for i in range(3)])


def steps(lin: DataFrame, damping: float) -> tuple[DataFrame, DataFrame]:
    """(camera, x) and (track, d): the solution of the damped normal equations."""
    tracks = materialize(eliminated(lin, damping), "tracks")
    place = {ij: k for k, ij in enumerate(UPPER6)}
    u = lambda i, j: _at("u", place[min(i, j), max(i, j)]) * (1 + damping if i == j else 1) + (1e-12 if i == j else 0)
    own = lin.groupBy("camera").agg(_sums("u", 21), _sums("gc", 6))
    rhs = own.join(spread(lin, tracks.withColumn("z", times_inverse("gp")), "z"), "camera").select("camera", "u", F.array(*[_at("s", i) - _at("gc", i) for i in range(6)]).alias("r"))
    scaled = lambda name: F.array(*[_at(name, i) / u(i, i) for i in range(6)])
    state = now = materialize(rhs.select("camera", "u", F.array(*[F.lit(0.0)] * 6).alias("x"), "r", scaled("r").alias("p")), "cameras")
    first = 0.0
    for _ in range(CG_STEPS):
        z = gathered(lin, now, "p").join(tracks, "track").select("track", times_inverse("y").alias("z"))
        q = F.array(*[c.dot([u(i, j) for j in range(6)], [_at("p", j) for j in range(6)]) - _at("s", i) for i in range(6)])
        last, state = state, materialize(now.join(spread(lin, z, "z"), "camera").select("camera", "u", "x", "r", "p", q.alias("q")), "gradient")
        discard(last)
        total = lambda a, b, div: F.sum(sum((_at(a, i) * _at(b, i) / (u(i, i) if div else F.lit(1.0)) for i in range(6)), F.lit(0.0)))
        sums = state.agg(total("p", "q", False).alias("pq"), *[total(a, b, True).alias(a + b) for a, b in ("rr", "rq", "qq")]).first()
        if not sums["pq"] or sums["pq"] <= 0:
            now = state
            break
        first = first or sums["rr"]
        alpha = sums["rr"] / sums["pq"]
        after = max(0.0, sums["rr"] - 2 * alpha * sums["rq"] + alpha * alpha * sums["qq"])
        beta = after / sums["rr"]
        r = [_at("r", i) - alpha * _at("q", i) for i in range(6)]
        now = state.select("camera", "u", F.array(*[_at("x", i) + alpha * _at("p", i) for i in range(6)]).alias("x"), F.array(*r).alias("r"), F.array(*[r[i] / u(i, i) + beta * _at("p", i) for i in range(6)]).alias("p"))
        if after < ENOUGH * first:
            break
    cameras = materialize(now.select("camera", "x"), "camera-steps")
    pulled = tracks.join(gathered(lin, cameras, "x"), "track").select("track", "inv", F.array(*[-_at("gp", i) - _at("y", i) for i in range(3)]).alias("y"))
    points = materialize(pulled.select("track", times_inverse("y").alias("d")), "point-steps")
    discard(tracks, state)
    return cameras, points


def moved(cameras: DataFrame, points: DataFrame, by: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    turn = F.array(*sum(turned_by([_at("x", k) for k in range(3)]), []))
    shift = F.array(*[_at("t", k) + F.coalesce(_at("x", 3 + k), F.lit(0.0)) for k in range(3)])
    zero = F.array(*[F.lit(0.0)] * 6)
    rows = cameras.join(by[0], "camera", "left").withColumn("x", F.coalesce("x", zero)).select("camera", "rot", shift.alias("t"), turn.alias("turn"))
    new = rows.select("camera", product(matrix("turn"), matrix("rot")).alias("rot"), "t")
    pts = points.join(by[1], "track", "left").select("track", F.array(*[_at("p", k) + F.coalesce(_at("d", k), F.lit(0.0)) for k in range(3)]).alias("p"))
    return materialize(new, "cameras"), materialize(pts, "points")


def packed(observations: DataFrame, points: DataFrame, cameras: list[int]) -> DataFrame:
    """HELD: a track's point and its observations by the cameras' places in the list. Observations and points move once."""
    places = F.create_map(*[x for k, camera in enumerate(cameras) for x in (F.lit(camera).cast("long"), F.lit(k))])
    rows = observations.select(F.col("track").cast("long").alias("track"), F.try_element_at(places, F.col("camera").cast("long")).alias("camera"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("camera IS NOT NULL")
    seen = rows.repartition("track").groupBy("track").agg(F.collect_list(F.struct("camera", "x", "y")).alias("seen"))
    return seen.join(points.select(F.col("track").cast("long").alias("track"), "p").hint("merge"), "track").select("track", "p", "seen")


def _chunks(batches: Iterator[pa.RecordBatch], n_cameras: int):
    """Of a batch of HELD rows some at a time: track of each observation, where tracks start, cameras, pixels and points."""
    for batch in batches:
        if not batch.num_rows:
            continue
        p, seen = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, 3), batch.column(2)
        size, flat = seen.value_lengths().to_numpy(zero_copy_only=False), seen.flatten()
        camera, xy = flat.field(0).to_numpy(zero_copy_only=False), np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in (1, 2)], 1)
        stop = np.cumsum(size)
        lo = 0
        while lo < len(size):
            begin = stop[lo] - size[lo]
            hi = max(lo + 1, min(int(np.searchsorted(stop, begin + AT_ONCE, "right")), lo + AT_ONCE * 2 // n_cameras))
            some = slice(begin, stop[hi - 1])
            yield batch, slice(lo, hi), np.repeat(np.arange(hi - lo), size[lo:hi]), stop[lo:hi] - size[lo:hi] - begin, camera[some], xy[some], p[lo:hi]
            lo = hi


def _inverses(v: np.ndarray, damping: float) -> np.ndarray:
    m = v.copy()
    d = np.arange(3)
    m[:, d, d] = m[:, d, d] * (1 + damping) + 1e-12
    return np.linalg.inv(m)


def reduced(held: DataFrame, rots: np.ndarray, ts: np.ndarray, damping: float, huber: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The cameras' system with the points eliminated, its right side, and the cost: sums by pair of cameras, made in the tasks."""
    n_c = len(ts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, own, right, total = np.zeros((6 * n_c, 6 * n_c)), np.zeros((n_c, 6, 6)), np.zeros((n_c, 6)), 0.0
        there = np.zeros(n_c, bool)
        for _, _, track, starts, camera, xy, p in _chunks(batches, n_c):
            w, u, v, gc, gp, cost = blocks_of(rots[camera], ts[camera], p[track], xy, huber)
            inv, gp = _inverses(np.add.reduceat(v, starts), damping), np.add.reduceat(gp, starts)
            order = np.argsort(camera, kind="stable")
            first = np.flatnonzero(np.diff(camera[order], prepend=-1))
            names = camera[order][first]
            there[names] = True
            own[names] += np.add.reduceat(u[order], first)
            z = np.einsum("nij,nj->ni", inv, gp)
            right[names] += np.add.reduceat((np.einsum("nij,nj->ni", w, z[track]) - gc)[order], first)
            total += cost.sum()
            # a table of the cameras' six rows by the tracks' three columns
            wide = np.zeros((len(p), n_c, 6, 3))
            at = track * n_c + camera
            if len(np.unique(at)) == len(at):
                wide[track, camera] = w
            else:
                np.add.at(wide, (track, camera), w)
            wide = wide.reshape(len(p), 6 * n_c, 3)
            turned = wide @ inv
            pairs += turned.transpose(1, 0, 2).reshape(6 * n_c, -1) @ wide.transpose(1, 0, 2).reshape(6 * n_c, -1).T
        names = np.flatnonzero(there)
        a, b = (names[k] for k in np.triu_indices(len(names)))
        blocks = pairs.reshape(n_c, 6, n_c, 6).transpose(0, 2, 1, 3)[a, b].reshape(-1, 36)
        sides = np.zeros((len(names), 36))
        sides[:, :6] = right[names]
        costs = np.zeros((1, 36))
        costs[0, 0] = total
        s = np.concatenate([blocks, own[names].reshape(-1, 36), sides, costs])
        kind = np.repeat(np.arange(4, dtype=np.int32), [len(a), len(names), len(names), 1])
        one = [np.concatenate([x, names, names, [0]]).astype(np.int32) for x in (a, b)]
        lists = pa.FixedSizeListArray.from_arrays(pa.array(s.reshape(-1)), 36).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, one), lists], names=["kind", "a", "b", "s"])

    system, right, total = np.zeros((n_c, 6, n_c, 6)), np.zeros((n_c, 6)), 0.0
    for row in held.mapInArrow(run, SUMS).groupBy("kind", "a", "b").agg(_sums("s", 36)).collect():
        s = np.array(row["s"])
        if row["kind"] == 0:
            system[row["a"], :, row["b"]] -= s.reshape(6, 6)
            if row["a"] != row["b"]:
                system[row["b"], :, row["a"]] -= s.reshape(6, 6).T
        elif row["kind"] == 1:
            system[row["a"], :, row["a"]] += s.reshape(6, 6) * (1 + damping * np.eye(6)) + 1e-12 * np.eye(6)
        elif row["kind"] == 2:
            right[row["a"]] = s[:6]
        else:
            total = float(s[0])
    return system.reshape(6 * n_c, 6 * n_c), right.reshape(-1), total


def pulled(held: DataFrame, rots: np.ndarray, ts: np.ndarray, x: np.ndarray, damping: float, huber: float) -> DataFrame:
    """HELD with the points' steps that follow from the cameras' ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, track, starts, camera, xy, p in _chunks(batches, len(ts)):
            w, _, v, _, gp, _ = blocks_of(rots[camera], ts[camera], p[track], xy, huber)
            side = np.add.reduceat(gp + np.einsum("nij,ni->nj", w, x[camera]), starts)
            new = p - np.einsum("nij,nj->ni", _inverses(np.add.reduceat(v, starts), damping), side)
            some = batch.slice(rows.start, rows.stop - rows.start)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(new.reshape(-1)), 3).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([some.column(0), lists, some.column(2)], names=["track", "p", "seen"])

    return held.mapInArrow(run, HELD)


def turns(x: np.ndarray) -> np.ndarray:
    """Rotations (n, 3, 3) of rotation vectors, as turned_by."""
    angle = np.linalg.norm(x, axis=1)[:, None, None]
    k = np.zeros((len(x), 3, 3))
    k[:, 2, 1], k[:, 0, 2], k[:, 1, 0] = x.T
    k -= k.transpose(0, 2, 1)
    safe = np.maximum(angle, 1e-12)
    return np.eye(3) + np.sin(angle) / safe * k + (1 - np.cos(angle)) / safe**2 * (k @ k)


def adjust_few(held: DataFrame, rots: np.ndarray, ts: np.ndarray, rounds: int, huber: float, damping: float) -> tuple[DataFrame, np.ndarray, np.ndarray, list[float]]:
    """The steps of adjust on HELD rows, whose files it deletes when it has better ones."""
    system, right, total = reduced(held, rots, ts, damping, huber)
    costs = [total]
    for turn in range(rounds if np.isfinite(total) else 0):
        x = np.linalg.lstsq(system, right)[0].reshape(-1, 6)
        new_rots, new_ts = turns(x[:, :3]) @ rots, ts + x[:, 3:]
        new = materialize(pulled(held, rots, ts, x, damping, huber), "tracks")
        next_system, next_right, now = reduced(new, new_rots, new_ts, damping / 10, huber)
        if better := now < costs[-1]:
            discard(held)
            held, rots, ts, system, right = new, new_rots, new_ts, next_system, next_right
            costs.append(now)
            damping /= 10
        else:
            discard(new)
            damping *= 10
            if turn + 1 < rounds:
                system, right, _ = reduced(held, rots, ts, damping, huber)
        if better and costs[-2] - costs[-1] < 1e-6 * costs[-2]:
            break
    return held, rots, ts, costs


def _adjust_packed(observations: DataFrame, few: list, points: DataFrame, rounds: int, huber: float, damping: float) -> tuple[DataFrame, DataFrame, list[float]]:
    ids = [row["camera"] for row in few]
    rots, ts = np.array([row["rot"] for row in few]).reshape(-1, 3, 3), np.array([row["t"] for row in few])
    held = materialize(packed(observations, points, ids), "tracks")
    held, rots, ts, costs = adjust_few(held, rots, ts, rounds, huber, damping)
    rows = [(i, rot.reshape(-1).tolist(), t.tolist()) for i, rot, t in zip(ids, rots, ts, strict=True)]
    cameras = observations.sparkSession.createDataFrame(rows, "camera long, rot array<double>, t array<double>")
    new = held.select("track", F.col("p").alias("new")).hint("merge")
    return cameras, points.join(new, "track", "left").select("track", F.coalesce("new", "p").alias("p")), costs


def adjust(observations: DataFrame, cameras: DataFrame, points: DataFrame, rounds: int = 5, huber: float = 0.1, damping: float = DAMPING) -> tuple[DataFrame, DataFrame, list[float]]:
    """Cameras, points and the costs: the first one, and one for each step that lowered it."""
    few = cameras.select(F.col("camera").cast("long").alias("camera"), "rot", "t").filter("camera IS NOT NULL").orderBy("camera").limit(FEW + 1).collect()
    if 0 < len(few) <= FEW:
        return _adjust_packed(observations, few, points, rounds, huber, damping)
    observations = materialize(observations.select(F.col("camera").cast("long").alias("camera"), F.col("track").cast("long").alias("track"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "observations")
    look = partial(linearised, observations, huber=huber)
    lin = materialize(look(cameras, points), "linear")
    cost = lambda rows: rows.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).first()["c"]
    costs, kept = [cost(lin)], []
    for _ in range(rounds):
        by = steps(lin, damping)
        tried = moved(cameras, points, by)
        discard(*by)
        new = materialize(look(*tried), "linear")
        if (now := cost(new)) < costs[-1]:
            discard(lin, *kept)
            (cameras, points), lin, kept = tried, new, tried
            costs.append(now)
            damping /= 10
        else:
            discard(new, *tried)
            damping *= 10
        if len(costs) > 1 and costs[-2] - costs[-1] < 1e-6 * costs[-2] and costs[-1] == now:
            break
    discard(lin, observations)
    return cameras, points, costs
