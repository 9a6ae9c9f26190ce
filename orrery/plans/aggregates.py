"""Queries on aggregations (AGG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators import aggregates as a
from orrery.plans import tables as t
from orrery.plans.filters import DEPTHS, INLIERS, OBS, depths, inlier_pairs, observed  # noqa: F401
from orrery.plans.joining import BOXES, IOU, MASKS, boxes, masks
from orrery.plans.projections import HSV
from orrery.plans.registry import query, rd, rounded


@query("AGG01_mean_depth", f"WITH {DEPTHS} SELECT point_id, {rd('depth')} AS depth, n_views FROM seen")
def agg01(spark, d):
    return depths(spark, d).select("point_id", rounded(F.col("depth")).alias("depth"), "n_views")


PRIOR = f"""{DEPTHS}, rng AS (SELECT min(depth) AS lo, max(depth) AS hi, count(depth) AS n, quantile_cont(depth, 0.25) AS q1, quantile_cont(depth, 0.75) AS q3 FROM seen),
 bins AS (SELECT CAST(least(floor((depth - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM seen, rng WHERE depth IS NOT NULL GROUP BY 1),
 mode AS (SELECT lo + (arg_max(bin, (bins.n, -bin)) + 0.5) * (hi - lo) / 50 AS mode FROM bins, rng GROUP BY lo, hi),
 prior AS (SELECT point_id, n_views, depth, CASE WHEN rng.n < 10 THEN 1 WHEN depth IS NULL THEN 0 ELSE exp(-0.5 * pow((depth - mode) / greatest((q3 - q1) / 2, 0.05 * mode), 2)) END AS prior FROM seen, rng, mode)"""


@query("AGG02_depth_prior", f"WITH {PRIOR} SELECT point_id, n_views, {rd('depth')} AS mean_depth, {rd('prior')} AS prior FROM prior WHERE n_views >= 2")
def agg02(spark, d):
    return a.depth_prior(depths(spark, d)).filter("n_views >= 2").select("point_id", "n_views", rounded(F.col("depth")).alias("mean_depth"), rounded(F.col("prior")).alias("prior"))


HUES = f"""{t.POINTS}, {HSV}, hist0 AS (SELECT CAST(least(floor(h * 36), 35) AS BIGINT) AS bin, sum(s * 0.8) AS w FROM hsv WHERE v > 0.6 GROUP BY 1),
 hist AS (SELECT k AS bin, coalesce(w, 0) / (SELECT sum(w) FROM hist0) AS share FROM (SELECT unnest(range(36)) AS k) LEFT JOIN hist0 ON k = bin)"""


def hues(spark, d):
    h, s, v = c.hsv(*[F.col(x) for x in "rgb"])
    return t.points(spark, d).select("point_id", h.alias("h"), s.alias("s"), v.alias("v"))


@query("AGG03_hue_histogram", f"WITH {HUES} SELECT CAST(bin AS BIGINT) AS bin, {rd('share')} AS share FROM hist")
def agg03(spark, d):
    p = hues(spark, d).filter("v > 0.6").withColumn("w", F.col("s") * 0.8)
    return a.hue_histogram(p, 36).select("bin", rounded(F.col("share")).alias("share"))


@query("AGG04_colour_prior", f"WITH {HUES}, k AS (SELECT point_id, least(greatest(share * s + CASE WHEN s < 0.15 THEN 0.5 * v ELSE 0 END, 0), 1) * 0.8 AS p FROM hsv JOIN hist ON CAST(least(floor(h * 36), 35) AS BIGINT) = bin) SELECT point_id, {rd('p / (SELECT max(p) FROM k)')} AS prior FROM k")
def agg04(spark, d):
    p = hues(spark, d)
    hist = a.hue_histogram(p.filter("v > 0.6").withColumn("w", F.col("s") * 0.8), 36)
    return a.colour_prior(p.withColumn("quality", F.lit(0.8)), hist, 36).select("point_id", rounded(F.col("prior")).alias("prior"))


CUES = f"{PRIOR}, {MASKS}, cue AS (SELECT v.point_id, sum(coalesce(value, 0) * (0.5 + v.image_id % 3 / 10.0)) / sum(0.5 + v.image_id % 3 / 10.0) AS mask, count(*) AS n FROM views v LEFT JOIN masks m ON v.image_id = m.image_id AND CAST(trunc(u) AS INTEGER) = px AND CAST(trunc(v) AS INTEGER) = py GROUP BY 1), score AS (SELECT point_id, cue.n, (1 - 0.25 - 0.1) * mask + 0.25 * prior + 0.1 * (point_id % 10 / 10.0) AS score FROM cue JOIN prior USING (point_id))"


def scores(spark, d):
    from orrery.operators.joins import raster_join

    v = raster_join(t.views(spark, d), masks(spark, d)).withColumn("quality", 0.5 + F.col("image_id") % 3 / 10.0)
    extra = t.points(spark, d).select("point_id", (F.col("point_id") % 10 / 10.0).alias("colour"))
    return a.multi_cue_score(v, a.depth_prior(depths(spark, d)), extra)


@query("AGG05_multi_cue_vote", f"WITH {CUES} SELECT point_id, n, {rd('score')} AS score FROM score WHERE n >= 2 AND score >= 0.2")
def agg05(spark, d):
    return scores(spark, d).filter("n >= 2 AND score >= 0.2").select("point_id", "n", rounded(F.col("score")).alias("score"))


@query("AGG06_adaptive_threshold", f"WITH {CUES}, steps AS (SELECT k, 0.65 - 0.05 * k AS thr FROM (SELECT unnest(range(7)) AS k)), cnt AS (SELECT k, thr, (SELECT count(*) FROM score WHERE score >= thr) AS n FROM steps) SELECT {rd('thr', 3)} AS threshold, n FROM cnt WHERE k = coalesce((SELECT min(k) FROM cnt WHERE n >= 50), 6)")
def agg06(spark, d):
    """Scores are made once; all thresholds are counted in one aggregation."""
    return a.adaptive_threshold(scores(spark, d), 0.65, 0.05, 0.35, 50, 120_000).withColumn("threshold", rounded(F.col("threshold"), 3))


@query("AGG07_score_histogram", f"WITH {CUES}, r AS (SELECT min(score) AS lo, max(score) AS hi FROM score) SELECT CAST(least(floor((score - lo) / (hi - lo) * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM score, r GROUP BY 1")
def agg07(spark, d):
    return a.histogram(scores(spark, d), "score", 10)


@query(
    "AGG08_geometry_score",
    f"WITH {t.VIEWS}, k AS (SELECT point_id, count(*) AS n, sqrt(greatest(sum(depth * depth) / count(*) - pow(avg(depth), 2), 0)) AS sd FROM views GROUP BY 1), m AS (SELECT max(n) AS mn, quantile_cont(sd, 0.95) AS p95 FROM k), e AS (SELECT point_id, n, 0.6 * n / mn + 0.4 * (1 - least(sd, p95) / p95) AS score FROM k, m) SELECT point_id, {rd('score', 5)} AS score FROM e WHERE score >= (SELECT quantile_cont(score, 0.5) FROM e) - 1e-9",
)
def agg08(spark, d):
    return a.geometry_filter(t.views(spark, d), 0.5).select("point_id", rounded(F.col("score"), 5).alias("score"))


@query(
    "AGG09_multi_label_vote",
    f"WITH {t.VOTES}, n AS (SELECT point_id, count(*) AS n FROM votes GROUP BY 1), s AS (SELECT point_id, label, sum(score) / n AS s FROM votes JOIN n USING (point_id) GROUP BY point_id, label, n), r AS (SELECT label, row_number() OVER (ORDER BY label) AS idx FROM (SELECT DISTINCT label FROM votes)) SELECT point_id, CASE WHEN max(s) >= 12 THEN arg_max(label, (s, -idx)) ELSE 'bg' END AS label FROM s JOIN r USING (label) GROUP BY 1",
)
def agg09(spark, d):
    return a.multi_label_vote(t.votes(spark, d), 12.0)


@query("AGG10_label_summary", f"WITH {t.POINTS} SELECT r % 5 AS label, count(*) AS n, {rd('avg(x)')} AS cx, {rd('avg(y)')} AS cy, {rd('avg(z)')} AS cz, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points GROUP BY 1")
def agg10(spark, d):
    s = a.label_summary(t.points(spark, d).withColumn("label", F.col("r") % 5))
    return s.withColumns({k: rounded(F.col(k)) for k in ("cx", "cy", "cz")})


@query("AGG11_best_box", "WITH b AS (SELECT event_type AS label, user_id % 20 AS frame, event_id AS box, value AS score FROM events), top AS (SELECT label, arg_max(box, (score, -box)) AS box FROM b GROUP BY 1), own AS (SELECT label, frame, arg_max(box, (score, -box)) AS box FROM b WHERE score > 150 GROUP BY 1, 2) SELECT top.label, f AS frame, coalesce(own.box, top.box) AS box FROM top CROSS JOIN (SELECT unnest(range(20)) AS f) LEFT JOIN own ON own.label = top.label AND own.frame = f")
def agg11(spark, d):
    b = t.table(spark, d, "events").select(F.col("event_type").alias("label"), (F.col("user_id") % 20).alias("frame"), F.col("event_id").alias("box"), F.col("value").alias("score"))
    frames = spark.range(20).select(F.col("id").alias("frame"))
    return a.best_boxes(b, frames, 150.0)


@query("AGG12_border_majority", "WITH k AS (SELECT l_suppkey AS image, l_linenumber AS cluster, count(*) AS n FROM lineitem WHERE l_partkey % 50 IN (0, 49) GROUP BY 1, 2) SELECT image, CAST(arg_max(cluster, (n, -cluster)) AS BIGINT) AS background FROM k GROUP BY 1")
def agg12(spark, d):
    k = t.table(spark, d, "lineitem").filter("l_partkey % 50 IN (0, 49)").select(F.col("l_suppkey").alias("image"), F.col("l_linenumber").cast("long").alias("cluster"))
    return a.majority(k, "image", "cluster").withColumnRenamed("cluster", "background")


@query("AGG13_coverage_outliers", "WITH k AS (SELECT o_custkey AS image, sum(o_totalprice) / 3000000 AS cov, avg(o_orderkey % 10) / 10 AS q FROM orders GROUP BY 1), m AS (SELECT median(cov) AS med FROM k) SELECT image, abs(cov - med) > 0.3 AND q < 0.5 AS outlier FROM k, m")
def agg13(spark, d):
    k = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("image")).agg((F.sum("o_totalprice") / 3000000).alias("cov"), (F.avg(F.col("o_orderkey") % 10) / 10).alias("q"))
    return a.coverage_outliers(k).select("image", "outlier")


@query("AGG14_camera_validity", f"WITH {t.EDGES}, e AS (SELECT a AS camera, n % 2 = 0 AS ok FROM edges UNION ALL SELECT b, n % 2 = 0 FROM edges) SELECT camera, count(*) AS n, avg(ok::INT) > 0.5 AS is_valid FROM e GROUP BY 1")
def agg14(spark, d):
    return a.end_share(t.edges(spark, d).withColumn("ok", F.col("n") % 2 == 0), 0.5)


@query("AGG15_gravity_outliers", f"WITH {t.EDGES}, e AS (SELECT a AS frame, n % 3 = 0 AS bad FROM edges UNION ALL SELECT b, n % 3 = 0 FROM edges) SELECT frame, count(*) AS total, CAST(count_if(bad) AS BIGINT) AS mistakes, count_if(bad) / count(*) >= 0.3 AND count(*) >= 7 AS error_prone FROM e GROUP BY 1")
def agg15(spark, d):
    return a.error_prone(t.edges(spark, d).withColumn("bad", F.col("n") % 3 == 0), 0.3, 7)


@query("AGG16_upper_median_mad", f"WITH {t.EDGES}, m AS (SELECT list_sort(list(w))[count(*) // 2 + 1] AS med FROM edges), e AS (SELECT abs(w - med) AS dev FROM edges, m) SELECT {rd('(SELECT med FROM m)')} AS med, {rd('list_sort(list(dev))[count(*) // 2 + 1]')} AS mad, {rd('greatest((SELECT med FROM m) - list_sort(list(dev))[count(*) // 2 + 1], 20)')} AS threshold FROM e")
def agg16(spark, d):
    return a.median_mad(t.edges(spark, d), "w", 20.0).select(*[rounded(F.col(k)).alias(k) for k in ("med", "mad", "threshold")])


@query(
    "AGG17_robust_normalise",
    f"WITH {t.POINTS}, r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS axis, {k} AS v, row_number() OVER (ORDER BY {k}) - 1 AS i, count(*) OVER () AS n FROM points" for k in "xyz") + f") SELECT axis, max(v) FILTER (i = floor(0.1 * (n - 1))) AS lo, max(v) FILTER (i = floor(0.9 * (n - 1))) AS hi, {rd('avg(v) FILTER (i BETWEEN floor(0.1 * (n - 1)) AND floor(0.9 * (n - 1)))')} AS mid FROM r GROUP BY 1",
)
def agg17(spark, d):
    return a.robust_box(t.points(spark, d), 0.1, 0.9).withColumn("mid", rounded(F.col("mid")))


@query("AGG18_scene_radius", f"WITH {t.CAMERAS}, m AS (SELECT avg(-tx) AS x, avg(-ty) AS y, avg(-tz) AS z FROM cameras) SELECT {rd('1.1 * max(sqrt(pow(-tx - x, 2) + pow(-ty - y, 2) + pow(-tz - z, 2)))')} AS radius FROM cameras, m")
def agg18(spark, d):
    centres = t.cameras(spark, d).select((-F.col("tx")).alias("x"), (-F.col("ty")).alias("y"), (-F.col("tz")).alias("z"))
    return a.scene_radius(centres).select(rounded(F.col("radius")).alias("radius"))


@query("AGG19_pose_scale", f"WITH {t.CAMERAS}, m AS (SELECT avg(tx) AS mx, avg(ty) AS my, avg(tz) AS mz FROM cameras), k AS (SELECT image_id, tx - mx AS x, ty - my AS y, tz - mz AS z FROM cameras, m), s AS (SELECT 1 / max(greatest(abs(x), abs(y), abs(z))) AS s FROM k) SELECT image_id, {rd('x * s')} AS x, {rd('y * s')} AS y, {rd('z * s')} AS z FROM k, s")
def agg19(spark, d):
    poses = t.cameras(spark, d).select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return a.centre_and_scale(poses).select("image_id", *[rounded(F.col(k)).alias(k) for k in "xyz"])


SCALES = "dp AS (SELECT o_custkey AS image, o_totalprice / 1000 AS mono, o_orderkey % 100 + 1.0 AS colmap FROM orders), med AS (SELECT image, count(*) AS n, max(mono) - min(mono) AS rng, median(mono) AS tm, median(colmap) AS tc FROM dp GROUP BY 1), dev AS (SELECT image, avg(abs(mono - tm)) AS sm, avg(abs(colmap - tc)) AS sc FROM dp JOIN med USING (image) GROUP BY 1), scl AS (SELECT image, CASE WHEN n > 10 AND rng > 1e-3 THEN sc / sm ELSE 0 END AS scale, CASE WHEN n > 10 AND rng > 1e-3 THEN tc - tm * (sc / sm) ELSE 0 END AS off FROM med JOIN dev USING (image))"


def depth_pairs(spark, d):
    return t.table(spark, d, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_totalprice") / 1000).alias("mono"), (F.col("o_orderkey") % 100 + 1.0).alias("colmap"))


@query("AGG20_depth_scale", f"WITH {SCALES} SELECT image, {rd('scale', 5)} AS scale, {rd('off', 4)} AS off FROM scl")
def agg20(spark, d):
    return a.depth_scales(depth_pairs(spark, d)).select("image", rounded(F.col("scale"), 5).alias("scale"), rounded(F.col("off"), 4).alias("off"))


@query("AGG21_median_scale", f"WITH {SCALES} SELECT {rd('median(scale)', 5)} AS med FROM scl WHERE scale > 0")
def agg21(spark, d):
    return a.depth_scales(depth_pairs(spark, d)).filter("scale > 0").agg(rounded(F.percentile("scale", F.lit(0.5)), 5).alias("med"))


PIX = "pix AS (SELECT l_suppkey % 10 AS scene, l_linenumber AS method, l_suppkey AS image, l_discount * 10 AS p, l_tax * 12 AS q FROM lineitem)"


def pixels(spark, d):
    return t.table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("scene"), F.col("l_linenumber").cast("long").alias("method"), F.col("l_suppkey").alias("image"), (F.col("l_discount") * 10).alias("p"), (F.col("l_tax") * 12).alias("q"))


@query("AGG22_psnr", f"WITH {PIX}, m AS (SELECT scene, method, image, avg((p - q) * (p - q)) AS mse FROM pix GROUP BY 1, 2, 3) SELECT scene, CAST(method AS BIGINT) AS method, {rd('avg(20 * log10(1 / sqrt(mse)))', 5)} AS psnr, {rd('avg(10 * log10(1 / mse))', 5)} AS psnr10 FROM m GROUP BY 1, 2")
def agg22(spark, d):
    return a.psnr(pixels(spark, d)).withColumns({k: rounded(F.col(k), 5) for k in ("psnr", "psnr10")})


@query("AGG23_ssim")
def agg23(spark, d):
    from orrery.operators.images import ssim

    rows = t.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("image"), (F.col("l_partkey") % 24).cast("int").alias("x"), (F.col("l_orderkey") % 24).cast("int").alias("y")).agg(F.avg(F.col("l_discount") * 10).alias("p"), F.avg(F.col("l_tax") * 12).alias("q"))
    return ssim(rows).select("image", rounded(F.col("ssim"), 5).alias("ssim"))


@query("AGG24_losses", f"WITH {PIX} SELECT image, {rd('avg(abs(p - q))')} AS l1, {rd('avg((p - q) * (p - q))')} AS l2, {rd('0.8 * avg(abs(p - q)) + 0.2 * (1 - 0.5)')} AS loss FROM pix GROUP BY 1")
def agg24(spark, d):
    return a.losses(pixels(spark, d), 0.2, F.lit(0.5)).withColumns({k: rounded(F.col(k)) for k in ("l1", "l2", "loss")})


@query("AGG26_pose_accuracy", "WITH e AS (SELECT CASE WHEN o_orderkey % 31 = 0 THEN 'inf'::DOUBLE ELSE (o_orderkey % 600) / 100.0 END AS m, CASE WHEN o_orderkey % 31 = 0 THEN 'inf'::DOUBLE ELSE (o_orderkey % 120) / 10.0 END AS deg FROM orders) SELECT " + ", ".join(f"{rd(f'avg((m <= {m} AND deg <= {g})::INT) * 100')} AS acc_{k}" for k, (m, g) in enumerate(((0.1, 1), (0.25, 2), (0.5, 5), (5, 10)))) + f", {rd('median(m)')} AS med_m, {rd('median(deg)')} AS med_deg FROM e")
def agg26(spark, d):
    k, inf = F.col("o_orderkey"), F.lit(float("inf"))
    lost = k % 31 == 0
    e = t.table(spark, d, "orders").select(F.when(lost, inf).otherwise((k % 600) / 100.0).alias("m"), F.when(lost, inf).otherwise((k % 120) / 10.0).alias("deg"))
    out = a.pose_accuracy(e)
    return out.select(*[rounded(F.col(n)).alias(n) for n in out.columns])


@query("AGG27_stereo_metrics", f"WITH {PIX}, i AS (SELECT image, avg(abs(p - q)) AS e, sqrt(avg((p - q) * (p - q))) AS r, " + ", ".join(f"avg((abs(p - q) > {x})::INT) * 100 AS b{k}" for k, x in enumerate((0.1, 0.3, 0.5, 0.7))) + " FROM pix GROUP BY 1) SELECT " + ", ".join(f"{rd(f'avg({x})')} AS {n}" for x, n in (("e", "avgerr"), ("r", "rmse"), ("b0", "bad0"), ("b1", "bad1"), ("b2", "bad2"), ("b3", "bad3"))) + " FROM i")
def agg27(spark, d):
    out = a.stereo_metrics(pixels(spark, d), (0.1, 0.3, 0.5, 0.7))
    return out.select(*[rounded(F.col(n)).alias(n) for n in out.columns])


FLOW = "flow AS (SELECT l_quantity AS gu, l_tax * 100 AS gv, l_quantity + l_discount * 40 - 2 AS u, l_tax * 100 + l_discount * 10 AS v FROM lineitem), fe AS (SELECT *, sqrt(pow(u - gu, 2) + pow(v - gv, 2)) AS epe, sqrt(gu * gu + gv * gv) AS speed FROM flow)"


@query("AGG28_flow_metrics", f"WITH {FLOW} SELECT {rd('avg(abs(u - gu) + abs(v - gv))')} AS l1, {rd('avg(epe)')} AS epe, " + ", ".join(f"{rd(f'avg((epe > {x})::INT) * 100')} AS bad{k}" for k, x in enumerate((0.5, 1, 3, 5))) + f", {rd('avg(epe) FILTER (speed < 10)')} AS epe_slow, {rd('avg(epe) FILTER (speed >= 10 AND speed < 40)')} AS epe_mid, {rd('avg(epe) FILTER (speed >= 40)')} AS epe_fast FROM fe")
def agg28(spark, d):
    q, x, s = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax") * 100
    out = a.flow_metrics(t.table(spark, d, "lineitem").select(q.alias("gu"), s.alias("gv"), (q + x * 40 - 2).alias("u"), (s + x * 10).alias("v")))
    return out.select(*[rounded(F.col(n)).alias(n) for n in out.columns])


@query("AGG29_weighted_mean", f"SELECT l_linenumber AS k, {rd('sum(l_discount * l_quantity) / sum(l_quantity)')} AS mean FROM lineitem GROUP BY 1")
def agg29(spark, d):
    return t.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(rounded(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")).alias("mean"))


AP = "s AS (SELECT user_id AS q, event_type = 'click' AS pos, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), p AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY rank) / CAST(rank AS DOUBLE) AS prec FROM s WHERE pos)"


@query("AGG30_average_precision", f"WITH {AP} SELECT q, {rd('avg(prec)')} AS ap FROM p GROUP BY q")
def agg30(spark, d):
    s = t.table(spark, d, "events").select(F.col("user_id").alias("q"), (F.col("event_type") == "click").alias("pos"), F.col("value").alias("score"), F.col("event_id").alias("id"))
    return a.average_precision(s).withColumn("ap", rounded(F.col("ap")))


@query("AGG31_detection_evaluation")
def agg31(spark, d):
    from orrery.operators.images import match_detections

    pairs = boxes(spark, d, "a").join(boxes(spark, d, "b"), "image").filter("a % 2 = 0 AND b % 2 = 1")
    p, q = ([F.col(f"{s}{n}") for n in ("x0", "y0", "x1", "y1")] for s in "ab")
    i, u = c.box_overlap(p, q)
    return match_detections(pairs.select("image", F.col("a").alias("det"), F.col("b").alias("gt"), (F.col("a") % 97 / 97.0).alias("score"), (i / u).alias("iou")), 0.3)


@query("AGG32_robust_focal", f"WITH {t.VIEWS}, f AS (SELECT image_id, (u - 320) * depth / (x + tx) AS f FROM views JOIN cameras USING (image_id) WHERE x + tx <> 0 UNION ALL SELECT image_id, (v - 320) * depth / (y + ty) FROM views JOIN cameras USING (image_id) WHERE y + ty <> 0) SELECT image_id, {rd('least(greatest(quantile_disc(f, 0.5), 50), 500)', 4)} AS focal FROM f GROUP BY 1")
def agg32(spark, d):
    v = t.views(spark, d).join(F.broadcast(t.cameras(spark, d).select("image_id", "tx", "ty")), "image_id")
    v = v.select("image_id", (F.col("x") + F.col("tx")).alias("xc"), (F.col("y") + F.col("ty")).alias("yc"), F.col("depth"), (F.col("u") - 320).alias("du"), (F.col("v") - 320).alias("dv"))
    return a.robust_focal(v, 50.0, 500.0).withColumn("focal", rounded(F.col("focal"), 4))


@query("AGG33_normalise_cloud", f"WITH {t.POINTS}, n AS (SELECT r % 4 AS k, *, sqrt(x*x + y*y + z*z) AS len FROM points) SELECT k, {rd('avg(len)')} AS by_mean, {rd('median(len)')} AS by_median, {rd('pow(avg(sqrt(len)), 2)')} AS by_sqrt, {rd('exp(avg(ln(1 + len))) - 1')} AS by_log FROM n GROUP BY 1")
def agg33(spark, d):
    return a.cloud_norms(t.points(spark, d).withColumn("k", F.col("r") % 4), "k").select("k", *[rounded(F.col(n)).alias(n) for n in ("by_mean", "by_median", "by_sqrt", "by_log")])


@query("AGG34_joint_median", f"WITH {t.POINTS}, m AS (SELECT quantile_disc(z, 0.5) AS depth FROM points), c AS (SELECT quantile_disc(x, 0.5) AS cx, quantile_disc(y, 0.5) AS cy, quantile_disc(z, 0.5) AS cz FROM points) SELECT {rd('depth')} AS depth, {rd('cx')} AS cx, {rd('cy')} AS cy, {rd('cz')} AS cz, {rd('(SELECT quantile_disc(sqrt(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2)), 0.5) FROM points, c)')} AS scale FROM m, c")
def agg34(spark, d):
    out = a.joint_median(t.points(spark, d))
    return out.select(*[rounded(F.col(k)).alias(k) for k in ("depth", "cx", "cy", "cz", "scale")])


@query("AGG35_median_camera_distance", f"WITH {t.CAMERAS} SELECT {rd('median(sqrt(pow(p.tx - q.tx, 2) + pow(p.ty - q.ty, 2) + pow(p.tz - q.tz, 2)))')} AS med FROM cameras p JOIN cameras q ON p.image_id < q.image_id")
def agg35(spark, d):
    poses = t.cameras(spark, d).select("image_id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"))
    return a.median_distance(poses).select(rounded(F.col("med")).alias("med"))


@query("AGG36_canonical_view", f"SELECT l_partkey AS pixel, {rd('sum(l_quantity * (l_tax + 1 - 0.999)) / sum(l_tax + 1 - 0.999)')} AS x, {rd('sum((l_tax + 1) * (l_tax + 1)) / sum(l_tax + 1)')} AS conf FROM lineitem GROUP BY 1")
def agg36(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("pixel"), F.col("l_quantity").alias("x"), (F.col("l_tax") + 1).alias("conf"))
    return a.canonical_view(rows).select("pixel", rounded(F.col("x")).alias("x"), rounded(F.col("conf")).alias("conf"))


@query("AGG37_pair_score", f"SELECT l_suppkey AS pair, {rd('pow(avg(l_quantity) * avg(l_discount + 1) * avg(l_tax + 1) * avg(l_linenumber), 0.25)')} AS score, {rd('sum(l_quantity)', 3)} AS total, count(*) AS n FROM lineitem GROUP BY 1")
def agg37(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("c0"), (F.col("l_discount") + 1).alias("c1"), (F.col("l_tax") + 1).alias("c2"), F.col("l_linenumber").alias("c3"))
    return a.pair_score(rows).select("pair", rounded(F.col("score")).alias("score"), rounded(F.col("total"), 3).alias("total"), "n")


@query("AGG38_anchor_offsets", f"WITH px AS (SELECT p_partkey AS id, p_partkey % 64 AS x, p_partkey // 64 AS y, p_size + 1.0 AS z FROM part), k AS (SELECT *, (y // 8) * 8 + x // 8 AS anchor FROM px), c AS (SELECT anchor, arg_min(z, id) AS az FROM k GROUP BY 1) SELECT id, anchor, {rd('z / az')} AS off FROM k JOIN c USING (anchor)")
def agg38(spark, d):
    k = F.col("p_partkey")
    px = t.table(spark, d, "part").select(k.alias("id"), (k % 64).alias("x"), F.floor(k / 64).alias("y"), (F.col("p_size") + 1.0).alias("z"))
    return a.anchor_offsets(px, 8, 8).withColumn("off", rounded(F.col("off")))


@query("AGG39_tsdf", f"WITH {t.VIEWS}, k AS (SELECT point_id, least(greatest((3 + image_id % 3) - depth, -1), 1) AS s, 1 + r / 255.0 AS w FROM views) SELECT point_id, {rd('sum(s * w) / sum(w)')} AS tsdf FROM k GROUP BY 1")
def agg39(spark, d):
    v = t.views(spark, d).select("point_id", (3 + F.col("image_id") % 3 - F.col("depth")).alias("gap"), (1 + F.col("r") / 255.0).alias("w"))
    return a.tsdf(v, 1.0).withColumn("tsdf", rounded(F.col("tsdf")))


@query("AGG40_gravity_average")
def agg40(spark, d):
    g = t.points(spark, d).withColumn("n", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + (5 * F.col("z")) ** 2)).select((F.col("x") / F.col("n")).alias("x"), (F.col("y") / F.col("n")).alias("y"), (5 * F.col("z") / F.col("n")).alias("z"))
    return a.gravity_average(g).select(*[rounded(F.col(k), 5).alias(k) for k in "xyz"])


@query("AGG41_quaternion_average")
def agg41(spark, d):
    from orrery.plans.projections import quaternions

    return a.quaternion_average(quaternions(spark, d)).select(*[rounded(F.col(k), 5).alias(k) for k in "wxyz"])


@query("AGG42_unique_merge", "SELECT l_orderkey AS id, min(l_partkey) AS v FROM lineitem GROUP BY 1")
def agg42(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("v"))
    return a.unique_first(rows, "id", "v")


@query("AGG43_spacing_mode", f"WITH {t.POINTS}, nn AS (SELECT p.point_id AS a, q.point_id AS b, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS d2 FROM points p, points q WHERE p.point_id <> q.point_id), rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rank FROM nn), m AS (SELECT a, CAST(ceil(100 * (sum(sqrt(d2)) / 4) - 1e-9) AS BIGINT) AS bin FROM rk WHERE rank <= 3 GROUP BY 1), h AS (SELECT bin, count(*) AS n FROM m GROUP BY 1) SELECT {rd('greatest(arg_max(bin, (n, -bin)) / 100.0, 0.01)')} AS spacing FROM h")
def agg43(spark, d):
    return a.spacing_mode(t.points(spark, d), 4, 3.0).select(rounded(F.col("spacing")).alias("spacing"))


@query("AGG44_scale_init", f"WITH {t.POINTS}, nn AS (SELECT p.point_id AS a, q.point_id AS b, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS d2 FROM points p, points q WHERE p.point_id <> q.point_id), rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rank FROM nn) SELECT a AS point_id, {rd('avg(sqrt(d2))')} AS scale, {rd('ln(sqrt(greatest(avg(d2), 1e-7)))')} AS log_scale FROM rk WHERE rank <= 3 GROUP BY 1")
def agg44(spark, d):
    return a.initial_scales(t.points(spark, d), 3.0).select("point_id", rounded(F.col("scale")).alias("scale"), rounded(F.col("log_scale")).alias("log_scale"))


@query("AGG45_masks_to_boxes", f"WITH {MASKS} SELECT image_id, CAST(min(px) AS BIGINT) AS x0, CAST(min(py) AS BIGINT) AS y0, CAST(max(px) AS BIGINT) AS x1, CAST(max(py) AS BIGINT) AS y1 FROM masks WHERE value > 0.6 GROUP BY 1")
def agg45(spark, d):
    return a.mask_boxes(masks(spark, d).filter("value > 0.6"))


@query("AGG47_tile_merge", f"SELECT l_partkey AS pixel, {rd('sum(l_quantity * exp(-2 * l_tax)) / (sum(exp(-2 * l_tax)) + 1e-16)')} AS pred FROM lineitem GROUP BY 1")
def agg47(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("pixel"), F.col("l_quantity").alias("pred"), F.exp(-2 * F.col("l_tax")).alias("w"))
    return a.tile_merge(rows).withColumn("pred", rounded(F.col("pred")))


@query("AGG48_attention_pool", f"WITH {t.DESCRIPTORS}, e AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim, 1 + vec_id % 7 AS w FROM descriptors), s AS (SELECT label, dim, sum(w * x) AS s FROM e GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(s * s)) AS n FROM s GROUP BY 1) SELECT label, CAST(dim AS BIGINT) AS dim, {rd('s / n', 5)} AS v FROM s JOIN n USING (label)")
def agg48(spark, d):
    v = t.descriptors(spark, d).withColumn("w", 1 + F.col("vec_id") % 7)
    return a.attention_pool(v, "label").withColumn("v", rounded(F.col("v"), 5))


@query("AGG49_triangulation_merge", f"SELECT l_partkey AS pixel, {rd('coalesce(sum(CASE WHEN l_linenumber > 1 THEN l_tax * l_quantity END) / CASE WHEN sum(CASE WHEN l_linenumber > 1 THEN l_tax ELSE 0 END) <= 1e-5 THEN 1 ELSE sum(CASE WHEN l_linenumber > 1 THEN l_tax ELSE 0 END) END, 0)')} AS x FROM lineitem GROUP BY 1")
def agg49(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("pixel"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).otherwise(F.lit(float("nan"))).alias("x"), F.col("l_tax").alias("w"))
    return a.triangulation_merge(rows).withColumn("x", rounded(F.col("x")))


@query(
    "MTH01_array_functions",
    f"""WITH k AS (SELECT l_suppkey, l_quantity AS q, l_extendedprice AS p, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount END AS holes FROM lineitem)
 SELECT l_suppkey, {rd('quantile_cont(p, 0.9)', 4)} AS p90, {rd('quantile_cont(holes, 0.25)', 6)} AS nan_quarter, count(DISTINCT q) AS n_unique, arg_min(q, (p, q)) AS first_by_price,
 CAST(sum((floor((least(greatest(q, 5), 45) - 5) / 10) = 0)::INT) AS BIGINT) AS bin0, CAST(sum((least(floor((least(greatest(q, 5), 45) - 5) / 10), 3) = 3)::INT) AS BIGINT) AS bin3, {rd('max(sqrt(q * q + p * p))', 4)} AS longest FROM k GROUP BY 1""",
)
def mth01(spark, d):
    """Per supplier: percentile, percentile without holes, distinct values, the first in sorted order, bins of clipped values, the longest hypotenuse."""
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    at = F.least(F.floor((c.clamp(q, 5, 45) - 5) / 10), F.lit(3))
    holes = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_discount"))
    return t.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        rounded(F.percentile(p, F.lit(0.9)), 4).alias("p90"), rounded(F.percentile(holes, F.lit(0.25))).alias("nan_quarter"), F.count_distinct(q).alias("n_unique"), F.min_by(q, F.struct(p, q)).alias("first_by_price"),
        F.count_if(at == 0).alias("bin0"), F.count_if(at == 3).alias("bin3"), rounded(F.max(F.hypot(q, p)), 4).alias("longest"),
    )
