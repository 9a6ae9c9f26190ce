"""Focal lengths of cameras from the fundamental matrices of their pairs.

edges: a, b, f (row-major, of pixels less the principal points, x_b' f x_a = 0); cameras: camera, focal, the prior. A focal
length is right if diag(fb, fb, 1) f diag(fa, fa, 1) is an essential matrix, so its deviation from one, nine smooth
equations, is the residual. Each camera's logged focal length moves by Gauss-Newton on its own edges' equations,
with Cauchy's weights, all cameras at once and half a step while their neighbours move too. A round is two joins of the edges with the cameras and a sum by camera.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.state import discard, materialize

ROUNDS = 40
STEP = 0.6
#: The scale of Cauchy's weights at first, its fall a round, and at last.
WIDE, FALL, CAUCHY = 0.3, 0.75, 0.01
SETTLED = 1e-4
MOST = 0.3


def residual(f: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """(n, 9) of n matrices (n, 3, 3) and logged focal lengths: 2 E E' E - tr(E E') E, over the 3/2 power of the trace."""
    da, db = (np.stack([np.exp(x), np.exp(x), np.ones_like(x)], 1) for x in (la, lb))
    e = db[:, :, None] * f * da[:, None, :]
    e /= np.maximum(np.linalg.norm(e, axis=(1, 2)), 1e-300)[:, None, None]
    g = e @ e.transpose(0, 2, 1)
    return (2 * g @ e - e).reshape(-1, 9)


def pulls(edges: DataFrame, cameras: DataFrame, cauchy: float = CAUCHY) -> DataFrame:
    """(camera, g, h, error): for both cameras of each edge the gradient and curvature of its logged focal length, and the squared residual."""
    ends = [cameras.select(F.col("camera").alias(k), F.log("focal").alias(f"l{k}")) for k in "ab"]
    rows = edges.join(ends[0], "a").join(ends[1], "b").select("a", "b", "f", "la", "lb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
            la, lb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            r, h = residual(f, la, lb), 1e-5
            slopes = [(residual(f, la + h * (1 - k), lb + h * k) - residual(f, la - h * (1 - k), lb - h * k)) / (2 * h) for k in (0, 1)]
            error = (r * r).sum(1)
            weight = 1 / (1 + error / cauchy**2)
            camera = np.concatenate([batch.column(k).to_numpy() for k in (0, 1)])
            g = np.concatenate([weight * (s * r).sum(1) for s in slopes])
            curve = np.concatenate([weight * (s * s).sum(1) for s in slopes])
            yield pa.RecordBatch.from_arrays([pa.array(camera, pa.int64()), pa.array(g), pa.array(curve), pa.array(np.concatenate([error, error]))], names=["camera", "g", "h", "error"])

    return rows.mapInArrow(run, "camera long, g double, h double, error double")


def calibrate(edges: DataFrame, cameras: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(camera, focal, prior, error): error is the mean squared residual of the camera's edges; a camera without an edge keeps its prior."""
    edges = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "f"), "edges")
    now = materialize(cameras.select(F.col("camera").cast("long").alias("camera"), F.col("focal").cast("double").alias("focal"), F.col("focal").cast("double").alias("prior"), F.lit(None).cast("double").alias("error")), "focals")
    for k in range(rounds):
        cauchy = max(CAUCHY, WIDE * FALL**k)
        sums = pulls(edges, now, cauchy).groupBy("camera").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.avg("error").alias("e"))
        want = F.coalesce(-STEP * F.col("g") / (F.col("h") + 1e-12), F.lit(0.0))
        move = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), want))
        last, now = now, materialize(now.join(sums, "camera", "left").select("camera", (F.col("focal") * F.exp(move)).alias("focal"), "prior", F.col("e").alias("error"), F.abs(move).alias("move")), "focals")
        discard(last)
        if cauchy == CAUCHY and (now.agg(F.max("move").alias("m")).first()["m"] or 0.0) < SETTLED:
            break
    discard(edges)
    return now.drop("move")
