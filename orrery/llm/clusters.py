"""Operator 11: k-means over integer vectors whose assignment is an annulus search.

A vector's components x become floor(SCALE * x). The first centroids are the vectors with the smallest hashes of their
ids. A round assigns every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number) and
moves each centroid that has vectors to the componentwise floor of their mean; all of this is integer arithmetic.

Assignment. The centroids are sorted by norm. The exact distance u to the two centroids next to a vector's norm bounds
the distance to its nearest one, and since | |c| - |x| | <= |c - x|, only centroids with norms in [|x| - u, |x| + u]
can be as near: a binary search finds them, with a slack far above the rounding of a norm, so boundary ties are among
them, and they are compared exactly. Vectors with the same stretch of centroids are compared in one product.

The vectors are written once as integers and read once a round; a task hands on k x (components + 1) sums, Spark adds
them, and the driver holds k centroids and no vector but the first k. Nothing is grouped by cluster, so a cluster may
hold any share of the rows.

Cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; with fewer
vectors than k each is a centroid; a null vec_id is clustered as any other, but starts no centroid as long as there
are others; vectors that share an id start centroids in their own order, repeated rows several equal ones, of which
the first gets the vectors; components beyond 10**18 count as that, and distances and sums beyond a long as the largest
long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import discard, materialize

DIMS = 64
SCALE = 64
K = 16
ROUNDS = 3
FAR = 10.0**18
LONG = (1 << 63) - 1
#: Up to this component distances of up to 2**10 components are exact in doubles.
EXACT = 1 << 20
SLACK = 1e-9


class Annuli:
    """Centroids by norm."""

    def __init__(self, centroids: list[list[int]]):
        wide = max((abs(x) for c in centroids for x in c), default=0) > EXACT
        points = np.array(centroids, dtype=object if wide else np.float64)
        squares = (points * points).sum(1)
        self.number = np.argsort(np.sqrt(squares.astype(np.float64)), kind="stable")
        self.points, self.squares = points[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.wide = wide
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each row's nearest centroid, and the squared distance, both exact."""
        n, k = len(x), len(self.points)
        if self.wide or (n and np.abs(x).max() > EXACT):
            x, points, squares = x.astype(object), self.points.astype(int).astype(object), self.squares.astype(object)
        else:
            x, points, squares = x.astype(np.float64), self.points, self.squares
        own = (x * x).sum(1)
        norm = np.sqrt(own.astype(np.float64))
        at = np.searchsorted(self.norms, norm)
        bound = np.full(n, np.inf)
        for j in (np.maximum(at - 1, 0), np.minimum(at, k - 1)):
            apart = x - points[j]
            bound = np.minimum(bound, (apart * apart).sum(1).astype(np.float64))
        reach = np.sqrt(bound)
        reach += SLACK * (norm + reach + 1)
        first, last = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        cluster, distance = np.zeros(n, np.int64), np.zeros(n, own.dtype)
        stretch = first * (k + 1) + last
        order = np.argsort(stretch, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(stretch[order])) + 1) if n else []:
            a, b = first[rows[0]], last[rows[0]]
            d = own[rows, None] - 2 * (x[rows] @ points[a:b].T) + squares[None, a:b]
            least = d.min(1)
            cluster[rows] = np.where(d == least[:, None], self.number[None, a:b], k).min(1)
            distance[rows] = least
            self.compared += len(rows) * int(b - a)
        return cluster, distance


def whole(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and the integer components of the vectors that are kept."""
    x = F.col("embedding")
    good = (F.size(x) == dims) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    number = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), v.cast("double") * scale))).cast("long"))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def moved(rows: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, sums, counts = Annuli(centroids), np.zeros((len(centroids), dims), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            cluster, _ = annuli.nearest(x)
            wide = len(x) and np.abs(x).max() > EXACT
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].astype(object if wide else np.int64).sum(0).astype(object)
            counts += np.bincount(cluster, minlength=len(centroids))
        full = np.flatnonzero(counts).tolist()
        place = [*range(dims), dims]
        total = [Decimal(int(t)) for c in full for t in (*sums[c], counts[c])]
        cols = [pa.array(np.repeat(full, dims + 1), pa.int32()), pa.array(place * len(full), pa.int32()), pa.array(total, pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(cols, names=["cluster", "place", "total"])

    sums = rows.select("v").mapInArrow(run, "cluster int, place int, total decimal(38,0)").groupBy("cluster", "place").agg(F.sum("total").alias("total"))
    found = {(r["cluster"], r["place"]): int(r["total"]) for r in sums.collect()}
    return [[found[c, p] // found[c, dims] for p in range(dims)] if (c, dims) in found else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    rows = materialize(whole(vectors, dims, scale), "vectors")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [list(r["v"]) for r in rows.select(start.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        discard(rows)
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        centroids = moved(rows, centroids, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batches:
            cluster, distance = annuli.nearest(matrix(batch.column(1), dims))
            far = pa.array([min(int(d), LONG) for d in distance] if distance.dtype == object else distance.astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])

    found = materialize(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    discard(rows)
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole_inertia = min(sum(inertia.values()), LONG)
    told = [(c, min(s, LONG), whole_inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    # k rows at most
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
