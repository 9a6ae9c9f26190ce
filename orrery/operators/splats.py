"""Operators around splat training and solvers: densification, resets, residuals and weights."""

from __future__ import annotations

import decimal
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import columns as c


def above(size: float) -> Column:
    """Is the largest scale, rounded to a double, above size? Compared as a logarithm: an exponential may be a digit off, and then a scale of exactly that size falls on either side."""
    with decimal.localcontext(prec=60):
        limit = ((decimal.Decimal(size) + decimal.Decimal(math.nextafter(size, math.inf))) / 2).ln()
        least = float(limit)
        least = least if decimal.Decimal(least) <= limit else math.nextafter(least, -math.inf)
    return F.greatest("s0", "s1", "s2") > least


def largest(column: str = "big") -> Column:
    return F.exp(F.greatest("s0", "s1", "s2")).alias(column)


def densify(rows: DataFrame, gradient: float, size: float, parts: int) -> DataFrame:
    """Large gaussians with a steep gradient are replaced by parts, shrunk by 0.8 * parts; small ones are doubled."""
    k = rows.withColumn("big", largest())
    hot = F.col("grad") >= gradient
    split = hot & above(size)
    keep = k.filter(~split).withColumns({"kind": F.lit("keep"), "copy": F.lit(0)})
    clone = k.filter(hot & ~above(size)).withColumns({"kind": F.lit("clone"), "copy": F.lit(0)})
    shrunk = {s: F.col(s) - F.log(F.lit(0.8 * parts)) for s in ("s0", "s1", "s2")}
    new = k.filter(split).withColumns({"kind": F.lit("split"), "copy": F.explode(F.sequence(F.lit(1), F.lit(parts)))}).withColumns(shrunk)
    return keep.unionByName(clone).unionByName(new)


def refine(rows: DataFrame, pixels: int, gradient: float, size: float) -> DataFrame:
    """Marks what is split or doubled; a split shrinks the parent by 1.6 as well."""
    hot = F.col("grad") * 0.5 * pixels > gradient
    k = rows.withColumn("big", largest()).withColumns({"is_split": hot & above(size), "is_dup": hot & ~above(size)})
    return k.withColumns({s: F.when(F.col("is_split"), F.col(s) - F.log(F.lit(1.6))).otherwise(F.col(s)) for s in ("s0", "s1", "s2")})


def reset_opacity(rows: DataFrame) -> DataFrame:
    """reset: opacity of at most 0.01; clamped: logits of at most that of 0.2."""
    return rows.withColumns({"reset": c.logit(F.least(c.sigmoid(F.col("opacity")), F.lit(0.01))), "clamped": F.least(F.col("opacity"), c.logit(F.lit(0.2)))})


def gradient_statistics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.sum(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)).alias("total"), F.count("*").alias("n"), F.max("radius").alias("radius"))


def solve_pairs(matches: DataFrame, solver=None) -> DataFrame:
    """(pair, n, dx, dy): a solver for the matches of each pair. A solver takes and returns a pandas frame."""

    def shift(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "n": [len(pdf)], "dx": [round(float((pdf["bx"] - pdf["ax"]).mean()), 6)], "dy": [round(float((pdf["by"] - pdf["ay"]).mean()), 6)]})

    return matches.groupBy("pair").applyInPandas(solver or shift, "pair long, n long, dx double, dy double")


def inlier_scores(errors: DataFrame, limit: float) -> DataFrame:
    """(pair, n_inliers, cost): squared errors within the limit, and their sum cut at the limit."""
    return errors.groupBy("pair").agg(F.count_if(F.col("e") <= limit).alias("n_inliers"), F.sum(F.least("e", F.lit(limit))).alias("cost"))


def irls_weights(residuals: DataFrame, sigma: float) -> DataFrame:
    r2 = F.col("r") * F.col("r")
    return residuals.withColumns({"geman": sigma**2 / F.pow(sigma**2 + r2, F.lit(2.0)), "half": F.pow(r2 + F.lit(1e-6), F.lit(-0.75))})


def stratified(edges: DataFrame, most: float = 0.95) -> DataFrame:
    """Should edges between frames with gravity be solved first? Not if nearly all are such."""
    return edges.agg(F.count_if("has_gravity").alias("n_gravity"), F.count("*").alias("n")).withColumn("two_steps", F.col("n_gravity") <= most * F.col("n"))


def constraints(observations: DataFrame, registered: Column, least: int) -> DataFrame:
    long = observations.groupBy("track_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return observations.filter(registered).join(long, "track_id", "left_semi")


def tightening(errors: DataFrame, factors) -> DataFrame:
    """(factor, n): observations within each limit, all from one aggregation."""
    counts = errors.agg(*[F.count_if(F.col("e") < f).alias(str(f)) for f in factors])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(str(f)).alias("n")) for f in factors])).alias("x")).select("x.*")


def unit_ray(u: Column, v: Column, camera) -> list[Column]:
    fx, fy, cx, cy = camera
    x, y = (u - cx) / fx, (v - cy) / fy
    n = F.sqrt(x * x + y * y + 1)
    return [x / n, y / n, 1 / n]


#: Rows of a block that queries meet in info_nce.
LOSS_ROWS = 1 << 14


def info_nce(queries: DataFrame, rows: DataFrame, temperature: float) -> DataFrame:
    """(loss): mean over queries (id, v) of log(sum(exp(s / T))) - s_own / T, s their rounded dot products with all rows (id, v). Null components count as
    nothing. Blocks of queries meet blocks of rows in a grid, as in joins.search: a task holds one block of queries and their sums, rows pass by in batches."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    from orrery.operators.joins import MEET, QUERY_BLOCK

    told = [df.filter(F.exists("v", lambda x: x.isNotNull())).select(F.col("id").cast("long").alias("id"), "v") for df in (queries, rows)]
    held = [df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("most")).first() for df in told]
    most = max(h["most"] for h in held)
    filled = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.coalesce(F.get("v", k), F.lit(0.0)).cast("double"))
    n_q, n_r = (max(1, -(-h["n"] // size)) for h, size in zip(held, (QUERY_BLOCK, LOSS_ROWS), strict=True))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    dealt = lambda n, name: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int").alias(name)
    asked = told[0].select(dealt(n_q, "q"), every(n_r, "r"), F.lit(0).alias("side"), "id", filled.alias("v"))
    given = told[1].select(every(n_q, "q"), dealt(n_r, "r"), F.lit(1).alias("side"), "id", filled.alias("v"))
    # by a number, as Spark would join partitions of few bytes, however many products they are
    both = asked.unionByName(given).repartition(min(4096, 2 * n_q * n_r), "q", "r").sortWithinPartitions("q", "r", "side")

    def sums(key, ids, vectors, total, own):
        there = np.isneginf(own)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total), pa.array(own, mask=there)], names=["i", "total", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            q, r, side = (batch.column(k).to_numpy() for k in range(3))
            ids = batch.column(3).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            vectors = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(n, most)
            edges = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (r[1:] != r[:-1]) | (side[1:] != side[:-1])))).tolist()
            for a, b in zip(edges, [*edges[1:], n], strict=True):
                if cell is None or cell[0] != (q[a], r[a]):
                    if cell is not None:
                        yield sums(*cell)
                    cell = [(q[a], r[a]), ids[:0], vectors[:0], np.zeros(0), np.zeros(0)]
                if side[a] == 0:
                    size = len(cell[1]) + b - a
                    cell[1:] = np.concatenate([cell[1], ids[a:b]]), np.concatenate([cell[2], vectors[a:b]]), np.zeros(size), np.full(size, -np.inf)
                    continue
                for at in range(a, b, MEET):
                    some = slice(at, min(at + MEET, b))
                    s = np.round(cell[2] @ vectors[some].T, 6) / temperature
                    cell[3] += np.exp(s).sum(1)
                    cell[4] = np.maximum(cell[4], np.where(cell[1][:, None] == ids[some][None], s, -np.inf).max(1))
        if cell is not None:
            yield sums(*cell)

    each = both.mapInArrow(run, "i long, total double, own double").groupBy("i").agg(F.ln(F.sum("total")).alias("total"), F.max("own").alias("own"))
    return each.agg(F.avg(F.col("total") - F.col("own")).alias("loss"))