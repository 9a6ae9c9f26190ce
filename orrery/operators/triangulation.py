"""Points of tracks from the rays that see them. DataFrame functions only.

Each observation gives two linear equations in the homogeneous point. The ten different entries of the normal matrix of a
track are sums over its observations, so a track of any length is a partial aggregation that can go on later (`merged`) and
never a list. A point follows from a row: by least squares with the last entry set to one, or as the eigenvector
of the least eigenvalue, by Jacobi rotations on the 4 x 4 matrix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = [(i, j) for i in range(4) for j in range(i, 4)]
SWEEPS = 6


def normal_sums(observations: DataFrame) -> DataFrame:
    """(track_id, n, sums) of rows track_id, x, y (camera coordinates), pose (row-major 3 x 4, camera from world) and, if there is one, weight."""
    p = [[F.get("pose", F.lit(4 * i + k)) for k in range(4)] for i in range(3)]
    rows = [[p[i][k] - F.col(x) * p[2][k] for k in range(4)] for i, x in enumerate("xy")]
    w = F.col("weight") * F.col("weight") if "weight" in observations.columns else F.lit(1.0)
    sums = F.array(*[F.sum(w * (rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j])) for i, j in PLACES])
    return observations.groupBy("track_id").agg(F.count("*").alias("n"), sums.alias("sums"))


def merged(*parts: DataFrame) -> DataFrame:
    """The sums of tracks whose observations came in several parts."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("track_id").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(len(PLACES))]).alias("sums"))


def _entry(i: int, j: int) -> Column:
    return F.get("sums", F.lit(PLACES.index((min(i, j), max(i, j)))))


def by_least_squares() -> list[Column]:
    """x, y, z from column sums by Cramer's rule; null where the equations don't fix a point."""
    m = [[_entry(i, j) for j in range(3)] for i in range(3)]
    b = [-_entry(i, 3) for i in range(3)]

    def det(a) -> Column:
        return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

    whole = det(m)
    return [F.when(F.abs(whole) > 1e-12, det([[b[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / whole) for k in range(3)]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def least_eigenvector(matrix: Column, sweeps: int = SWEEPS) -> Column:
    """Of a symmetric 4 x 4 matrix (array of 16), by cyclic Jacobi rotations."""
    places = F.sequence(F.lit(0), F.lit(15))
    eye = F.array(*[F.lit(float(k % 5 == 0)) for k in range(16)])
    turns = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(sweeps) for p in range(4) for q in range(p + 1, 4)])

    def columns(m: Column, x: Column, r: Column) -> Column:
        def cell(k: Column) -> Column:
            j, row = k % 4, k - k % 4
            a, b = F.get(m, row + x["p"]), F.get(m, row + x["q"])
            return F.when(j == x["p"], r["c"] * a - r["s"] * b).when(j == x["q"], r["s"] * a + r["c"] * b).otherwise(F.get(m, k))

        return F.transform(places, cell)

    def rows(m: Column, x: Column, r: Column) -> Column:
        def cell(k: Column) -> Column:
            j, i = k % 4, (k - k % 4) / 4
            a, b = F.get(m, 4 * x["p"] + j), F.get(m, 4 * x["q"] + j)
            return F.when(i == x["p"], r["c"] * a - r["s"] * b).when(i == x["q"], r["s"] * a + r["c"] * b).otherwise(F.get(m, k))

        return F.transform(places, cell)

    def turn(s: Column, x: Column) -> Column:
        pq = F.get(s["a"], 4 * x["p"] + x["q"])
        tau = (F.get(s["a"], 5 * x["q"]) - F.get(s["a"], 5 * x["p"])) / (2 * pq)
        t = F.when(pq == 0, F.lit(0.0)).otherwise(F.when(tau >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)) / (F.abs(tau) + F.sqrt(1 + tau * tau)))
        cosine = let(t, lambda t: F.struct((1 / F.sqrt(1 + t * t)).alias("c"), (t / F.sqrt(1 + t * t)).alias("s")))
        return let(cosine, lambda r: F.struct(let(columns(s["a"], x, r), lambda m: rows(m, x, r)).alias("a"), columns(s["v"], x, r).alias("v")))

    def finish(s: Column) -> Column:
        values = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get(s["a"], 5 * k))
        least = F.array_position(values, F.array_min(values)).cast("int") - 1
        return let(least, lambda k: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(s["v"], 4 * i + k)))

    return F.aggregate(turns, F.struct(matrix.alias("a"), eye.alias("v")), turn, finish)


def by_eigenvector() -> list[Column]:
    """x, y, z from column sums as the eigenvector of the least eigenvalue; null for a point at infinity."""
    h = least_eigenvector(F.array(*[_entry(i, j) for i in range(4) for j in range(4)]))
    point = let(h, lambda v: F.when(F.abs(F.get(v, F.lit(3))) > 1e-12, F.transform(F.slice(v, 1, 3), lambda x: x / F.get(v, F.lit(3)))))
    return [F.get(point, F.lit(k)) for k in range(3)]


def triangulate(observations: DataFrame, least: int = 2, homogeneous: bool = False) -> DataFrame:
    """(track_id, n, x, y, z) of tracks with that many observations."""
    return points_of(normal_sums(observations), least, homogeneous)


def points_of(sums: DataFrame, least: int = 2, homogeneous: bool = False) -> DataFrame:
    return sums.filter(F.col("n") >= least).select("track_id", "n", *[x.alias(k) for k, x in zip("xyz", by_eigenvector() if homogeneous else by_least_squares(), strict=True)])
