"""Row generators: windows, offsets, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_starts(rows: DataFrame, window: int, spacing: int) -> DataFrame:
    """rows (id, total): starts of overlapping windows, evenly spread and rounded (halves to even)."""
    last = F.col("total") - window
    n = 2 + F.floor((last - 1) / F.lit(float(spacing)))
    k = rows.select("id", last.alias("last"), n.alias("n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    return k.select("id", "k", F.rint(F.col("k") * (F.col("last") / (F.col("n") - 1).cast("double"))).cast("long").alias("start"))
