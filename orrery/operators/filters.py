"""Filters on points, pairs, tracks, boxes and gaussians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import columns as c


def crop_boxes(boxes: DataFrame, left: float, top: float, width: float, height: float) -> DataFrame:
    """Boxes moved into a crop and clipped to it, with their area; empty ones go, with all their fields."""
    moved = {k: c.clamp(F.col(k) - (left if k[0] == "x" else top), 0.0, width if k[0] == "x" else height) for k in ("x0", "y0", "x1", "y1")}
    return boxes.withColumns(moved).filter("x1 > x0 AND y1 > y0").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def sanitise(points: DataFrame, percentile: float = 99.5, least: int = 10) -> DataFrame:
    """Finite points only; with more than least of these, none further from their centroid than the percentile of distances."""
    ok = points.filter(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    centre = F.broadcast(ok.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"], F.count("*").alias("total")))
    far = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 + (F.col("z") - F.col("mz")) ** 2)
    with_d = ok.crossJoin(centre).withColumn("d", far)
    limit = F.broadcast(with_d.agg(F.percentile("d", F.lit(percentile / 100)).alias("limit")))
    kept = with_d.crossJoin(limit).filter((F.col("total") <= least) | (F.col("d") <= F.col("limit")))
    rgb = [F.least(F.greatest(F.col(k), F.lit(0)), F.lit(255)).alias(k) if k in "rgb" else F.col(k) for k in points.columns]
    return kept.select(*rgb)


def depth_band(points: DataFrame, depth: str = "depth", width: float = 2.5, least: int = 50) -> DataFrame:
    """Points within width interquartile ranges of the median depth, or never seen; all of them if fewer than least would stay."""
    q = points.agg(F.percentile(depth, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    span = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    marked = points.crossJoin(F.broadcast(q)).withColumn("stays", F.col(depth).isNull() | (F.abs(F.col(depth) - F.get("q", F.lit(1))) <= width * span))
    total = F.broadcast(marked.agg(F.count_if("stays").alias("n_stays")))
    return marked.crossJoin(total).filter(F.col("stays") | (F.col("n_stays") < least)).select(*points.columns)


def sequence_distance(pairs: DataFrame, most: int, cyclic: bool = False) -> DataFrame:
    """Pairs (i, j) at most so far apart in their sequence; cyclic: around the largest index too."""
    gap = F.abs(F.col("i") - F.col("j"))
    if not cyclic:
        return pairs.filter(gap <= most)
    n = F.broadcast(pairs.agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("n_indices")))
    return pairs.crossJoin(n).filter(F.least(gap, F.col("n_indices") - gap) <= most).drop("n_indices")


def inlier_count(matches: DataFrame, least: int = 30) -> DataFrame:
    """(a, b, n, is_valid): pairs with fewer inliers than least are not valid."""
    return matches.groupBy("a", "b").agg(F.count_if("inlier").alias("n")).withColumn("is_valid", F.col("n") >= least)


def inlier_ratio(matches: DataFrame, least: float = 0.25) -> DataFrame:
    return matches.groupBy("a", "b").agg((F.count_if("inlier") / F.count("*")).alias("ratio")).withColumn("is_valid", F.col("ratio") >= least)


def rotation_consistency(edges: DataFrame, poses: DataFrame, degrees: float = 10.0) -> DataFrame:
    """Edges between registered nodes; valid if the edge's quaternion is within degrees of that between the poses."""
    pose = lambda s, k: poses.select(F.col("id").alias(k), *[F.col(q).alias(f"{s}{q}") for q in "wxyz"])
    both = edges.join(pose("p", "a"), "a").join(pose("q", "b"), "b")
    p, q, e = ([F.col(f"{s}{k}") for k in "wxyz"] for s in ("p", "q", ""))
    # q p^-1 for unit quaternions
    turn = [
        q[0] * p[0] + q[1] * p[1] + q[2] * p[2] + q[3] * p[3],
        -q[0] * p[1] + q[1] * p[0] - q[2] * p[3] + q[3] * p[2],
        -q[0] * p[2] + q[1] * p[3] + q[2] * p[0] - q[3] * p[1],
        -q[0] * p[3] - q[1] * p[2] + q[2] * p[1] + q[3] * p[0],
    ]
    return both.withColumn("is_valid", c.rotation_angle(turn, e) <= degrees)


def track_filter(observations: DataFrame, stays: Column) -> DataFrame:
    """(track_id, n, n_kept, changed) when observations that don't stay are dropped."""
    return observations.groupBy("track_id").agg(F.count("*").alias("n"), F.count_if(stays).alias("n_kept")).withColumn("changed", F.col("n") != F.col("n_kept"))


def triangulation_angle(rays: DataFrame, degrees: float) -> DataFrame:
    """(track_id, stays): does some pair of a track's unit rays (a, b, c) open by more than degrees?

    Rays of a track are gathered as one array of three doubles each; a track has one ray per image at most."""
    import math

    limit = math.cos(math.radians(degrees))
    one = F.struct("a", "b", "c")
    held = rays.groupBy("track_id").agg(F.collect_list(one).alias("rays"))
    wide = F.exists("rays", lambda p: F.exists("rays", lambda q: p["a"] * q["a"] + p["b"] * q["b"] + p["c"] * q["c"] < limit))
    return held.select("track_id", wide.alias("stays"))


def sane_ratio(value: Column, prior: Column, low: float, high: float) -> Column:
    return (value / prior >= low) & (value / prior <= high)


def prunable(extent: float, screen: float = 20.0) -> Column:
    """Gaussians that are too faint, too large on the screen or too large in space."""
    return (c.sigmoid(F.col("opacity")) < 0.005) | (F.col("radius") > screen) | (F.exp(F.greatest("s0", "s1", "s2")) > 0.1 * extent)


def cullable(huge: bool) -> Column:
    faint = c.sigmoid(F.col("opacity")) < 0.1
    return faint | (F.exp(F.greatest("s0", "s1", "s2")) > 0.5) | (F.col("radius") / 100 > 0.15) if huge else faint


def detections(logits: DataFrame, threshold: float) -> DataFrame:
    """(q, score): queries whose best token passes the threshold."""
    return logits.groupBy("q").agg(F.max(c.sigmoid(F.col("logit"))).alias("score")).filter(F.col("score") > threshold)


def audit_ok(answer: Column) -> Column:
    """An image passes if the answer holds OK anywhere, in either case."""
    return F.upper(answer).contains("OK")


def upload(files: DataFrame, most: int = 50, size: int = 10 << 20) -> DataFrame:
    """The first files (by id) of an allowed kind and size."""
    ok = files.filter((F.col("bytes") <= size) & F.lower("name").rlike("jpeg|jpg|png|webp"))
    return ok.orderBy("id").limit(most)


def sample_groups(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n distinct keys in the order of a hash: the same ones each time."""
    return rows.select(key).distinct().orderBy(c.draw(F.col(key)), key).limit(n)


def depth_consistency(pixels: DataFrame, tol: float = 0.001) -> DataFrame:
    """(point_id, conf): confidence is lowered where a more confident point of a view lies clearly before or behind."""
    best = pixels.groupBy("image_id", "a", "b").agg(F.max("conf").alias("mc"), F.min("depth").alias("md"))
    less = F.col("conf") < F.col("mc")
    low = F.when((F.col("depth") < (1 - tol) * F.col("md")) & less, F.least("conf", F.lit(0.0))).when((F.col("depth") > 1.02 * F.col("md")) & less, F.least("conf", F.lit(0.5))).otherwise(F.col("conf"))
    return pixels.join(best, ["image_id", "a", "b"]).groupBy("point_id").agg(F.min(low).alias("conf"))


def prefix_pairs(pairs: DataFrame, first: str, second: str, both: bool = True, complement: bool = False) -> DataFrame:
    p, q = F.col("i").cast("string").startswith(first), F.col("j").cast("string").startswith(second)
    chosen = p & q if both else p | q
    return pairs.filter(~chosen if complement else chosen)
