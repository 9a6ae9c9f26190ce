"""Rotation averaging over a graph of relative rotations, by iteratively reweighted least squares.

edges: a, b, rot and w: rot (row-major) turns camera a's frame into b's, so that rot(b) = rot * rot(a). The start is composed along a
maximum spanning tree. Each round takes the edges' residuals to the tangent space, where the update solves a weighted
Laplacian system: first with weights 1 / residual, as for the least sum of angles, then with those of Geman and McClure, which
lets go of wrong edges. The system is solved by conjugate gradients without a matrix: a step is a join of the edges with the
vectors and a sum by node. Vectors are tables; what crosses the driver are a few sums a step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators.graph import breadth_first, chained_poses, maximum_spanning_tree
from orrery.operators.state import discard, materialize

LINEAR_ROUNDS = 8
ROUNDS = 20
STEPS = 30
SIGMA = math.radians(5.0)
EPS = 1e-2
SETTLED = 1e-4
#: A system is solved when what is left of the squared gradient is this share of it.
ENOUGH = 1e-2


def matrix(name: str) -> list[list[Column]]:
    return [[F.get(name, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]


def product(p, q) -> Column:
    """Row-major array of the product."""
    return F.array(*[c.dot(p[i], [q[k][j] for k in range(3)]) for i in range(3) for j in range(3)])


def transposed(name: str) -> Column:
    return F.array(*[F.get(name, F.lit(3 * j + i)) for i in range(3) for j in range(3)])


def turned_by(vector: list[Column]) -> list[list[Column]]:
    """Rotation of a rotation vector."""
    angle = c.norm(vector)
    s = F.when(angle > 1e-12, F.sin(angle) / angle).otherwise(F.lit(1.0))
    h = F.when(angle > 1e-12, (1 - F.cos(angle)) / (angle * angle)).otherwise(F.lit(0.5))
    x, y, z = vector
    skew = [[F.lit(0.0), -z, y], [z, F.lit(0.0), -x], [-y, x, F.lit(0.0)]]
    return [[(1.0 if i == j else 0.0) + s * skew[i][j] + h * (vector[i] * vector[j] - (angle * angle if i == j else 0.0)) for j in range(3)] for i in range(3)]


def residuals(edges: DataFrame, rotations: DataFrame) -> DataFrame:
    """(a, b, w, angle, o0, o1, o2): the rotation vector of rot(b)' * rot * rot(a)."""
    ends = [rotations.select(F.col("node").alias(k), F.col("rot").alias(f"rot_{k}")) for k in "ab"]
    rows = edges.join(ends[0], "a").join(ends[1], "b").select("a", "b", "w", product(matrix("rot"), matrix("rot_a")).alias("m"), transposed("rot_b").alias("back"))
    rows = rows.select("a", "b", "w", product(matrix("back"), matrix("m")).alias("m"))
    m = matrix("m")
    rows = rows.withColumn("angle", F.acos(c.clamp((m[0][0] + m[1][1] + m[2][2] - 1) / 2, -1.0, 1.0)))
    scale = F.when(F.sin("angle") > 1e-9, F.col("angle") / (2 * F.sin("angle"))).otherwise(F.when(F.col("angle") < 1, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select("a", "b", "w", "angle", *[(scale * (m[i][j] - m[j][i])).alias(f"o{k}") for k, (i, j) in enumerate(((2, 1), (0, 2), (1, 0)))])


def solved(edges: DataFrame, steps: int = STEPS) -> DataFrame:
    """(node, x0, x1, x2) with x(b) - x(a) near o in the weighted least squares of edges (a, b, weight, o0, o1, o2), by conjugate gradients with the nodes' weights as preconditioner."""
    o = [F.col(f"o{k}") for k in range(3)]
    both = edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight", *o).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight", *[(-x).alias(f"o{k}") for k, x in enumerate(o)]))
    both = materialize(both, "links")
    zero = [F.lit(0.0).alias(f"x{k}") for k in range(3)]
    now = both.groupBy("node").agg(F.sum("weight").alias("d"), *[F.sum(F.col("weight") * x).alias(f"r{k}") for k, x in enumerate(o)])
    now = now.select("node", "d", *zero, *[F.col(f"r{k}") for k in range(3)], *[(F.col(f"r{k}") / F.col("d")).alias(f"p{k}") for k in range(3)])
    state, first = None, 0.0
    for _ in range(steps):
        # q = L p
        pulled = both.select("node", "other", "weight").join(now.select(F.col("node").alias("other"), "p0", "p1", "p2"), "other").groupBy("node").agg(*[F.sum(F.col("weight") * F.col(f"p{k}")).alias(f"s{k}") for k in range(3)])
        last, state = state, materialize(now.join(pulled, "node").select(*now.columns, *[(F.col("d") * F.col(f"p{k}") - F.col(f"s{k}")).alias(f"q{k}") for k in range(3)]), "gradient")
        if last is not None:
            discard(last)
        dot = lambda x, y: sum((F.col(f"{x}{k}") * F.col(f"{y}{k}") for k in range(3)), F.lit(0.0))
        sums = state.agg(F.sum(dot("p", "q")).alias("pq"), *[F.sum(dot(x, y) / F.col("d")).alias(x + y) for x, y in ("rr", "rq", "qq")]).first()
        if not sums["pq"] or sums["pq"] < 1e-30:
            break
        first = first or sums["rr"]
        alpha = sums["rr"] / sums["pq"]
        # the sum of (r - alpha q)**2 / d
        after = max(0.0, sums["rr"] - 2 * alpha * sums["rq"] + alpha * alpha * sums["qq"])
        beta = after / sums["rr"]
        r = {k: F.col(f"r{k}") - alpha * F.col(f"q{k}") for k in range(3)}
        now = state.select("node", "d", *[(F.col(f"x{k}") + alpha * F.col(f"p{k}")).alias(f"x{k}") for k in range(3)], *[r[k].alias(f"r{k}") for k in range(3)], *[(r[k] / F.col("d") + beta * F.col(f"p{k}")).alias(f"p{k}") for k in range(3)])
        if after < ENOUGH * first:
            break
    out = materialize(now.select("node", "x0", "x1", "x2"), "update")
    discard(both, *([] if state is None else [state]))
    return out


def tree_rotations(edges: DataFrame, root: int) -> DataFrame:
    """(node, rot) from the root along a maximum spanning tree."""
    tree = breadth_first(maximum_spanning_tree(edges.select("a", "b", "w")).select("a", "b"), root)
    both = edges.select(F.col("a").alias("parent"), F.col("b").alias("node"), transposed("rot").alias("rot")).unionByName(edges.select(F.col("b").alias("parent"), F.col("a").alias("node"), "rot"))
    steps = tree.join(both, ["parent", "node"], "left").groupBy("node", "parent", "level").agg(F.min("rot").alias("rot"))
    still = F.array(*[F.lit(0.0)] * 3)
    chained = chained_poses(steps.select("node", "parent", "level", "rot", still.alias("shift"), F.lit(1.0).alias("scale")))
    return chained.select("node", transposed("rot").alias("rot"))


def average(edges: DataFrame, root: int, sigma: float = SIGMA) -> DataFrame:
    """(node, rot) of all nodes that the root reaches; the root's is the identity."""
    edges = materialize(edges.select("a", "b", "w", "rot").filter("a <> b"), "edges")
    now = materialize(tree_rotations(edges, root), "rotations")
    for k in range(LINEAR_ROUNDS + ROUNDS):
        found = residuals(edges, now)
        angle2 = F.col("angle") * F.col("angle")
        weight = 1 / F.sqrt(angle2 + EPS * EPS) if k < LINEAR_ROUNDS else sigma * sigma / F.pow(angle2 + sigma * sigma, F.lit(2.0))
        update = solved(found.select("a", "b", (F.col("w") * weight).alias("weight"), "o0", "o1", "o2"))
        moved = now.join(update, "node").select("node", "rot", F.array(*sum(turned_by([F.col(f"x{k}") for k in range(3)]), [])).alias("turn")).select("node", product(matrix("rot"), matrix("turn")).alias("rot"))
        last, now = now, materialize(moved, "rotations")
        # turning all alike is no change
        ends = update.agg(*[f(f"x{k}").alias(f"{n}{k}") for k in range(3) for n, f in (("low", F.min), ("high", F.max))]).first()
        largest = max((ends[f"high{k}"] or 0.0) - (ends[f"low{k}"] or 0.0) for k in range(3))
        discard(last, update)
        if k >= LINEAR_ROUNDS and largest < SETTLED:
            break
    base = now.filter(F.col("node") == root).select(transposed("rot").alias("back"))
    # one row
    fixed = now.crossJoin(F.broadcast(base)).select("node", product(matrix("rot"), matrix("back")).alias("rot"))
    out = materialize(fixed, "rotations")
    discard(edges, now)
    return out
