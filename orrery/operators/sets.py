"""Set operations: voxels, pairs, repeats and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def voxel_first(points: DataFrame, size: float, seq: str) -> DataFrame:
    """The first point of each voxel in the order of seq."""
    keyed = points.withColumns({f"v{a}": F.floor(F.col(a) / size) for a in "xyz"})
    first = keyed.groupBy("vx", "vy", "vz").agg(F.min_by(F.struct(*points.columns), seq).alias("p"))
    return first.select("vx", "vy", "vz", "p.*")


def adaptive_voxel(points: DataFrame, target: int, seq: str) -> DataFrame:
    """Voxels sized from the mean spacing so that about target points stay; a second pass if a third too many do."""
    n, spread = points.agg(F.count("*"), F.greatest(*[F.max(a) - F.min(a) for a in "xyz"])).first()
    if n <= target:
        return points
    spacing = (spread or 1.0) / max(n, 1) ** (1 / 3)
    size = max(0.5 * spacing, spacing * (n / target) ** (1 / 3))
    out = voxel_first(points, size, seq).select(*points.columns)
    left = out.count()
    if left > 1.3 * target:
        out = voxel_first(points, size * (left / target) ** (1 / 3), seq).select(*points.columns)
    return out


def unordered_first(pairs: DataFrame, seq: str) -> DataFrame:
    """One orientation of each unordered pair: the first in the order of seq."""
    best = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min(F.struct(seq, "a", "b")).alias("x"))
    return best.select("x.a", "x.b")


def symmetrize(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def repeat(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))


def resize(rows: DataFrame, n: int, order: str) -> DataFrame:
    """n rows: the first ones in order, again from the start if there are too few."""
    total = rows.count()
    if not total:
        return rows
    ranked = global_rank(rows, order)
    return repeat(ranked, -(-n // total)).filter(F.col("copy") * total + F.col("place") < n).drop("copy", "place")


def hold_out(rows: DataFrame, order: str, every: int) -> DataFrame:
    """Every so many-th row in order is test, the rest train. Ranks come from range partitions and their sizes, not from one window."""
    ranked = global_rank(rows, order)
    return ranked.withColumn("part", F.when(F.col("place") % every == 0, "test").otherwise("train")).drop("place")


def global_rank(rows: DataFrame, *order: str) -> DataFrame:
    """place: the 0-based rank of each row in order, ties in any order, without a one-task window."""
    from orrery.operators.state import materialize

    spread = materialize(rows.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()))
    within = spread.withColumn("own", F.row_number().over(Window.partitionBy("chunk").orderBy(*order)))
    # one row for each range partition
    sizes = spread.groupBy("chunk").agg(F.count("*").alias("n"))
    before = sizes.select("chunk", F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return within.join(F.broadcast(before), "chunk").withColumn("place", F.col("before") + F.col("own") - 1).drop("chunk", "own", "before")


def mask_union(*masks: DataFrame) -> DataFrame:
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()
