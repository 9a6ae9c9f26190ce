"""Aggregations: priors, votes, robust statistics, image and pose metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators.joins import nearest, small


def scalar(df: DataFrame) -> DataFrame:
    """One row of figures, to be met by every row."""
    return F.broadcast(df)


def binned(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of a histogram whose last bin holds its right edge."""
    return F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1).cast("long"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return rows.crossJoin(scalar(ends)).groupBy(binned(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def depth_prior(seen: DataFrame, bins: int = 50) -> DataFrame:
    """Adds prior: a Gaussian around the first most frequent depth bin; 0 if never seen, 1 for all if under ten were."""
    q = seen.agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.count("depth").alias("n_seen"), F.percentile("depth", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    known = seen.filter("depth IS NOT NULL").crossJoin(scalar(q))
    counts = known.groupBy(binned(F.col("depth"), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    mode = counts.groupBy("lo", "hi").agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin")).select((F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("mode"))
    sigma = F.greatest((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 2, 0.05 * F.col("mode"))
    prior = F.when(F.col("n_seen") < 10, 1.0).when(F.col("depth").isNull(), 0.0).otherwise(F.exp(-0.5 * ((F.col("depth") - F.col("mode")) / sigma) ** 2))
    return seen.crossJoin(scalar(q)).join(scalar(mode), F.lit(True), "left").withColumn("prior", prior).select(*seen.columns, "prior")


def hue_bin(bins: int) -> Column:
    return F.least(F.floor(F.col("h") * bins), F.lit(bins - 1).cast("long"))


def hue_histogram(rows: DataFrame, bins: int) -> DataFrame:
    """(bin, share) of weights w over all bins; even shares if nothing weighs."""
    spark = rows.sparkSession
    sums = rows.groupBy(hue_bin(bins).alias("bin")).agg(F.sum("w").alias("w"))
    total = sums.agg(F.sum("w").alias("total"))
    every = spark.range(bins).select(F.col("id").alias("bin"))
    share = F.when(F.coalesce("total", F.lit(0.0)) > 0, F.coalesce("w", F.lit(0.0)) / F.col("total")).otherwise(F.lit(1.0 / bins))
    return every.join(sums, "bin", "left").crossJoin(scalar(total)).select("bin", share.alias("share"))


def colour_prior(points: DataFrame, hist: DataFrame, bins: int) -> DataFrame:
    p = points.withColumn("bin", hue_bin(bins)).join(F.broadcast(hist), "bin")
    value = c.clamp(F.col("share") * F.col("s") + F.when(F.col("s") < 0.15, 0.5 * F.col("v")).otherwise(F.lit(0.0)), 0.0, 1.0) * F.col("quality")
    p = p.withColumn("value", value).groupBy("point_id").agg(F.avg("value").alias("value"))
    top = p.agg(F.max("value").alias("top"))
    return p.crossJoin(scalar(top)).select("point_id", (F.col("value") / F.col("top")).alias("prior"))


def multi_cue_score(views: DataFrame, priors: DataFrame, colours: DataFrame, depth_weight: float = 0.25, colour_weight: float = 0.1) -> DataFrame:
    """(point_id, n, score): mask values weighted by view quality, with the depth and colour priors."""
    mask = views.groupBy("point_id").agg(F.count("*").alias("n"), (F.sum(F.col("value") * F.col("quality")) / F.sum("quality")).alias("mask"))
    score = (1 - depth_weight - colour_weight) * F.col("mask") + depth_weight * F.col("prior") + colour_weight * F.col("colour")
    return mask.join(priors.select("point_id", "prior"), "point_id").join(colours, "point_id").select("point_id", "n", score.alias("score"))


def adaptive_threshold(scores: DataFrame, start: float, step: float, floor: float, least: int, most: int) -> DataFrame:
    """(threshold, n): the first threshold, going down, that at least so many scores reach; the floor if none does; one step up again where too many do."""
    steps = [start - step * k for k in range(int(round((start - floor) / step)) + 1)]
    row = scores.agg(*[F.count_if(F.col("score") >= s).alias(f"n{k}") for k, s in enumerate(steps)]).first()
    k = next((k for k in range(len(steps)) if row[k] >= least), len(steps) - 1)
    if row[k] > most and k:
        k -= 1
    return scores.sparkSession.createDataFrame([(steps[k], row[k])], "threshold double, n long")


def geometry_filter(views: DataFrame, keep: float) -> DataFrame:
    """Points scored by how often they are seen and how little their depth varies; the best share stays."""
    v = F.sqrt(F.greatest(F.sum(F.col("depth") ** 2) / F.count("*") - F.avg("depth") ** 2, F.lit(0.0)))
    k = views.groupBy("point_id").agg(F.count("*").alias("n"), v.alias("sd"))
    m = k.agg(F.max("n").alias("most"), F.percentile("sd", F.lit(0.95)).alias("p95"))
    scored = k.crossJoin(scalar(m)).withColumn("score", 0.6 * F.col("n") / F.col("most") + 0.4 * (1 - F.least("sd", "p95") / F.col("p95")))
    limit = scored.agg(F.percentile("score", F.lit(1 - keep)).alias("limit"))
    return scored.crossJoin(scalar(limit)).filter(F.col("score") >= F.col("limit") - 1e-9).select("point_id", "n", "score")


def multi_label_vote(votes: DataFrame, least: float, background: str = "bg") -> DataFrame:
    """(point_id, label): the label with the largest mean score; ties go to the first label in order."""
    n = votes.groupBy("point_id").agg(F.count("*").alias("n"))
    s = votes.groupBy("point_id", "label").agg(F.sum("score").alias("s")).join(n, "point_id").withColumn("s", F.col("s") / F.col("n"))
    order = F.broadcast(votes.select("label").distinct().withColumn("idx", F.row_number().over(Window.orderBy("label"))))
    best = s.join(order, "label").groupBy("point_id").agg(F.max("s").alias("top"), F.max_by("label", F.struct("s", -F.col("idx"))).alias("label"))
    return best.select("point_id", F.when(F.col("top") >= least, F.col("label")).otherwise(F.lit(background)).alias("label"))


def label_summary(points: DataFrame) -> DataFrame:
    return points.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(k).alias(f"c{k}") for k in "xyz"], *[f(k).alias(f"{k}{i}") for k in "xyz" for i, f in enumerate((F.min, F.max))])


def best_boxes(boxes: DataFrame, frames: DataFrame, least: float) -> DataFrame:
    """(label, frame, box): a frame's own best box above the limit, else the label's best."""
    rank = F.struct("score", -F.col("box"))
    top = boxes.groupBy("label").agg(F.max_by("box", rank).alias("top"))
    own = boxes.filter(F.col("score") > least).groupBy("label", "frame").agg(F.max_by("box", rank).alias("own"))
    return frames.crossJoin(small(top)).join(own, ["label", "frame"], "left").select("label", "frame", F.coalesce("own", "top").alias("box"))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the least."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col(value))).alias(value))


def coverage_outliers(masks: DataFrame, far: float = 0.30, poor: float = 0.5) -> DataFrame:
    m = masks.agg(F.percentile("cov", F.lit(0.5)).alias("med"))
    return masks.crossJoin(scalar(m)).withColumn("outlier", (F.abs(F.col("cov") - F.col("med")) > far) & (F.col("q") < poor))


def ends(edges: DataFrame, name: str, *columns: str) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias(name), *columns)


def end_share(edges: DataFrame, more_than: float) -> DataFrame:
    """(camera, n, is_valid): cameras by the share of their edges, at either end, that are ok."""
    return ends(edges, "camera", "ok").groupBy("camera").agg(F.count("*").alias("n"), (F.avg(F.col("ok").cast("int")) > more_than).alias("is_valid"))


def error_prone(edges: DataFrame, share: float, least: int) -> DataFrame:
    k = ends(edges, "frame", "bad").groupBy("frame").agg(F.count("*").alias("total"), F.count_if("bad").alias("mistakes"))
    return k.withColumn("error_prone", (F.col("mistakes") / F.col("total") >= share) & (F.col("total") >= least))


def upper_median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """The entry at n // 2 of the sorted values, as a discrete percentile of that rank: no list of all values is made."""
    n = rows.filter(F.col(value).isNotNull()).count()
    share = min(1.0, (n // 2 + 0.5) / n) if n else 0.5
    return rows.agg(F.expr(f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY {value})").alias(name))


def median_mad(rows: DataFrame, value: str, floor: float) -> DataFrame:
    med = upper_median(rows, value, "med")
    off = rows.crossJoin(scalar(med)).withColumn("off", F.abs(F.col(value) - F.col("med")))
    return med.crossJoin(upper_median(off, "off", "mad")).withColumn("threshold", F.greatest(F.col("med") - F.col("mad"), F.lit(floor)))


def robust_box(points: DataFrame, low: float, high: float) -> DataFrame:
    """(axis, lo, hi, mid) at ranks floor(p * (n - 1)) and the mean of what lies between these ranks."""
    n = points.count()
    a, b = int(low * (n - 1)), int(high * (n - 1))
    long = points.select(F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).alias("v")) for k in "xyz"])).alias("e")).select("e.*")
    counts = long.groupBy("axis", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("axis").orderBy("v")
    placed = counts.withColumn("stop", F.sum("n").over(w)).withColumn("start", F.col("stop") - F.col("n"))
    inside = F.greatest(F.least("stop", F.lit(b + 1)) - F.greatest("start", F.lit(a)), F.lit(0))
    return placed.groupBy("axis").agg(
        F.min(F.when(F.col("stop") > a, F.col("v"))).alias("lo"), F.min(F.when(F.col("stop") > b, F.col("v"))).alias("hi"), (F.sum(F.col("v") * inside) / F.sum(inside)).alias("mid")
    )


def _distance(to: str = "m") -> Column:
    return F.sqrt(sum(((F.col(k) - F.col(f"{to}{k}")) ** 2 for k in "xyz"), F.lit(0.0)))


def scene_radius(centres: DataFrame) -> DataFrame:
    m = centres.agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
    return centres.crossJoin(scalar(m)).agg((1.1 * F.max(_distance())).alias("radius"))


def centre_and_scale(poses: DataFrame) -> DataFrame:
    m = poses.agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
    moved = poses.crossJoin(scalar(m)).withColumns({k: F.col(k) - F.col(f"m{k}") for k in "xyz"})
    s = moved.agg((1 / F.max(F.greatest(*[F.abs(k) for k in "xyz"]))).alias("s"))
    return moved.crossJoin(scalar(s)).select("image_id", *[(F.col(k) * F.col("s")).alias(k) for k in "xyz"])


def depth_scales(pairs: DataFrame) -> DataFrame:
    """(image, scale, off) that take mono depths to the model's, by medians and mean absolute deviations; 0 without enough of them."""
    half = F.lit(0.5)
    med = pairs.groupBy("image").agg(F.count("*").alias("n"), (F.max("mono") - F.min("mono")).alias("span"), F.percentile("mono", half).alias("tm"), F.percentile("colmap", half).alias("tc"))
    dev = pairs.join(med, "image").groupBy("image", "n", "span", "tm", "tc").agg(F.try_divide(F.avg(F.abs(F.col("colmap") - F.col("tc"))), F.avg(F.abs(F.col("mono") - F.col("tm")))).alias("s"))
    ok = (F.col("n") > 10) & (F.col("span") > 1e-3)
    return dev.select("image", F.when(ok, F.col("s")).otherwise(0.0).alias("scale"), F.when(ok, F.col("tc") - F.col("tm") * F.col("s")).otherwise(0.0).alias("off"))


def psnr(pixels: DataFrame) -> DataFrame:
    m = pixels.groupBy("scene", "method", "image").agg(F.avg((F.col("p") - F.col("q")) * (F.col("p") - F.col("q"))).alias("mse"))
    return m.groupBy("scene", "method").agg(F.avg(F.when(F.col("mse") > 0, 20 * F.log10(F.try_divide(F.lit(1.0), F.sqrt("mse")))).otherwise(F.lit(float("inf")))).alias("psnr"), F.avg(F.when(F.col("mse") > 0, 10 * F.log10(F.try_divide(F.lit(1.0), F.col("mse")))).otherwise(F.lit(float("inf")))).alias("psnr10"))


def losses(pixels: DataFrame, share: float, ssim: Column) -> DataFrame:
    gap = F.col("p") - F.col("q")
    return pixels.groupBy("image").agg(F.avg(F.abs(gap)).alias("l1"), F.avg(gap * gap).alias("l2")).withColumn("loss", (1 - share) * F.col("l1") + share * (1 - ssim))


def pose_accuracy(errors: DataFrame, limits=((0.1, 1), (0.25, 2), (0.5, 5), (5, 10))) -> DataFrame:
    shares = [(F.avg(((F.col("m") <= m) & (F.col("deg") <= g)).cast("int")) * 100).alias(f"acc_{k}") for k, (m, g) in enumerate(limits)]
    return errors.agg(*shares, F.percentile("m", F.lit(0.5)).alias("med_m"), F.percentile("deg", F.lit(0.5)).alias("med_deg"))


def stereo_metrics(pixels: DataFrame, limits) -> DataFrame:
    """Means over images of each image's mean error, root mean square and shares above the limits."""
    gap = F.abs(F.col("p") - F.col("q"))
    bad = {f"bad{k}": F.avg((gap > x).cast("int")) * 100 for k, x in enumerate(limits)}
    each = pixels.groupBy("image").agg(F.avg(gap).alias("avgerr"), F.sqrt(F.avg(gap * gap)).alias("rmse"), *[v.alias(k) for k, v in bad.items()])
    return each.agg(*[F.avg(k).alias(k) for k in ("avgerr", "rmse", *bad)])


def flow_metrics(flow: DataFrame, limits=(0.5, 1, 3, 5)) -> DataFrame:
    """Over all pixels, with the end-point error by bands of speed."""
    du, dv = F.col("u") - F.col("gu"), F.col("v") - F.col("gv")
    e = flow.withColumn("epe", F.sqrt(du**2 + dv**2)).withColumn("speed", F.sqrt(F.col("gu") ** 2 + F.col("gv") ** 2))
    band = lambda cond: F.avg(F.when(cond, F.col("epe")))
    s = F.col("speed")
    return e.agg(
        F.avg(F.abs(F.col("u") - F.col("gu")) + F.abs(F.col("v") - F.col("gv"))).alias("l1"), F.avg("epe").alias("epe"), *[(F.avg((F.col("epe") > x).cast("int")) * 100).alias(f"bad{k}") for k, x in enumerate(limits)],
        band(s < 10).alias("epe_slow"), band((s >= 10) & (s < 40)).alias("epe_mid"), band(s >= 40).alias("epe_fast"),
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """(q, ap) of rows (q, pos, score, id): the mean precision at the ranks of the positives."""
    by_rank = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(by_rank)).withColumn("hits", F.sum(F.col("pos").cast("int")).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.filter("pos").groupBy("q").agg(F.avg(F.col("hits") / F.col("rank")).alias("ap"))


def robust_focal(rays: DataFrame, low: float, high: float) -> DataFrame:
    """(image_id, focal): the lower median of what each pixel says of the focal length, clipped."""
    one = F.array(F.when(F.col("xc") != 0, F.col("du") * F.col("depth") / F.col("xc")), F.when(F.col("yc") != 0, F.col("dv") * F.col("depth") / F.col("yc")))
    f = rays.select("image_id", F.explode(one).alias("f")).filter("f IS NOT NULL")
    return f.groupBy("image_id").agg(c.clamp(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY f)"), low, high).alias("focal"))


def cloud_norms(points: DataFrame, key: str) -> DataFrame:
    n = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return points.withColumn("len", n).groupBy(key).agg(F.avg("len").alias("by_mean"), F.percentile("len", F.lit(0.5)).alias("by_median"), (F.avg(F.sqrt("len")) ** 2).alias("by_sqrt"), (F.exp(F.avg(F.log1p("len"))) - 1).alias("by_log"))


def joint_median(points: DataFrame) -> DataFrame:
    low = lambda k: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {k})")
    m = points.agg(low("z").alias("depth"), *[low(k).alias(f"c{k}") for k in "xyz"])
    scale = points.crossJoin(scalar(m)).withColumn("far", _distance("c")).agg(low("far").alias("scale"))
    return m.crossJoin(scale)


def median_distance(poses: DataFrame) -> DataFrame:
    other = poses.select(F.col("image_id").alias("other"), *[F.col(k).alias(f"m{k}") for k in "xyz"])
    return poses.join(other, F.col("image_id") < F.col("other")).agg(F.percentile(_distance(), F.lit(0.5)).alias("med"))


def canonical_view(rows: DataFrame) -> DataFrame:
    w = F.col("conf") - 0.999
    return rows.groupBy("pixel").agg((F.sum(F.col("x") * w) / F.sum(w)).alias("x"), (F.sum(F.col("conf") ** 2) / F.sum("conf")).alias("conf"))


def pair_score(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pair").agg(F.pow(F.avg("c0") * F.avg("c1") * F.avg("c2") * F.avg("c3"), F.lit(0.25)).alias("score"), F.sum("c0").alias("total"), F.count("*").alias("n"))


def anchor_offsets(pixels: DataFrame, block: int, width: int) -> DataFrame:
    """(id, anchor, off): depth relative to the first pixel of the block."""
    k = pixels.withColumn("anchor", F.floor(F.col("y") / block) * width + F.floor(F.col("x") / block))
    first = k.groupBy("anchor").agg(F.min_by("z", "id").alias("az"))
    return k.join(first, "anchor").select("id", "anchor", (F.col("z") / F.col("az")).alias("off"))


def tsdf(views: DataFrame, cut: float) -> DataFrame:
    return views.groupBy("point_id").agg((F.sum(c.clamp(F.col("gap"), -cut, cut) * F.col("w")) / F.sum("w")).alias("tsdf"))


def _principal(moments: list[float], n: int):
    import numpy as np

    m = np.zeros((n, n))
    m[np.triu_indices(n)] = moments
    return np.linalg.eigh(m + np.triu(m, 1).T)[1][:, -1]


def gravity_average(rows: DataFrame) -> DataFrame:
    """The principal axis of unit vectors, turned to where most of them point. Six moments reach the driver."""
    names = "xyz"
    row = rows.agg(*[F.avg(F.col(p) * F.col(q)) for i, p in enumerate(names) for q in names[i:]]).first()
    axis = _principal([v or 0.0 for v in row], 3)
    against = sum((F.col(k) * float(v) for k, v in zip(names, axis, strict=True)), F.lit(0.0)) < 0
    wrong, total = rows.agg(F.count_if(against), F.count("*")).first()
    axis = -axis if wrong > total / 2 else axis
    return rows.sparkSession.createDataFrame([tuple(map(float, axis))], "x double, y double, z double")


def quaternion_average(rows: DataFrame) -> DataFrame:
    """The unit quaternion nearest to all of them, whatever their signs. Ten moments reach the driver."""
    names = "wxyz"
    n2 = sum((F.col(k) ** 2 for k in names), F.lit(0.0))
    row = rows.agg(*[F.avg(F.col(p) * F.col(q) / n2) for i, p in enumerate(names) for q in names[i:]]).first()
    q = _principal([v or 0.0 for v in row], 4)
    return rows.sparkSession.createDataFrame([tuple(map(float, -q if q[0] < 0 else q))], "w double, x double, y double, z double")


def unique_first(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(value).alias(value))


def spacing_mode(points: DataFrame, k: int, radius: float) -> DataFrame:
    """The most frequent spacing in hundredths, where a point's spacing is the sum of k - 1 nearest distances over k."""
    near = nearest(points, points, k - 1, radius, skip_self=True)
    bins = near.groupBy("a").agg(F.ceil(100 * (F.sum(F.sqrt("d2")) / k) - 1e-9).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.agg(F.greatest(F.max_by("bin", F.struct("n", -F.col("bin"))) / 100.0, F.lit(0.01)).alias("spacing"))


def initial_scales(points: DataFrame, radius: float) -> DataFrame:
    """Mean distance to three neighbours, and the logarithm of the root of the mean squared distance."""
    return nearest(points, points, 3, radius, skip_self=True).groupBy(F.col("a").alias("point_id")).agg(F.avg(F.sqrt("d2")).alias("scale"), F.ln(F.sqrt(F.greatest(F.avg("d2"), F.lit(1e-7)))).alias("log_scale"))


def mask_boxes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(*[f(k).cast("long").alias(n) for k, f, n in (("px", F.min, "x0"), ("py", F.min, "y0"), ("px", F.max, "x1"), ("py", F.max, "y1"))])


def tile_merge(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pixel").agg((F.sum(F.col("pred") * F.col("w")) / (F.sum("w") + F.lit(1e-16))).alias("pred"))


def attention_pool(vectors: DataFrame, key: str) -> DataFrame:
    """(key, dim, v): weighted sums of the dimensions, of unit length."""
    sums = vectors.select(key, "w", F.posexplode("v").alias("dim", "x")).groupBy(key, (F.col("dim") + 1).cast("long").alias("dim")).agg(F.sum(F.col("w") * F.col("x")).alias("s"))
    n = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("s") ** 2)).alias("n"))
    return sums.join(n, key).select(key, "dim", (F.col("s") / F.col("n")).alias("v"))


def triangulation_merge(rows: DataFrame) -> DataFrame:
    """Weighted means that leave NaN out; a total weight of almost nothing divides by one."""
    w = F.when(F.isnan("x"), 0.0).otherwise(F.col("w"))
    total = F.sum(w)
    return rows.groupBy("pixel").agg((F.sum(F.when(F.isnan("x"), 0.0).otherwise(w * F.col("x"))) / F.when(total <= 1e-5, 1.0).otherwise(total)).alias("x"))
