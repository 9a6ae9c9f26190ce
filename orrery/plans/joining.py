"""Queries on joins (JOIN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import joins
from orrery.plans import tables as t
from orrery.plans.filters import INLIERS, inlier_pairs
from orrery.plans.registry import query, rd, rounded


@query("JOIN01_image_camera", "SELECT s_suppkey AS image_id, n_name AS camera FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join01(spark, d):
    images = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), "s_nationkey")
    cameras = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("camera"))
    return images.join(joins.small(cameras), "s_nationkey").select("image_id", "camera")


@query("JOIN02_projection_join", f"WITH {t.VIEWS} SELECT point_id, count(*) AS n_views FROM views GROUP BY 1")
def join02(spark, d):
    return t.views(spark, d).groupBy("point_id").agg(F.count("*").alias("n_views"))


MASKS = "masks AS (SELECT CAST(l_suppkey % 25 AS BIGINT) AS image_id, 300 + CAST(l_quantity AS INTEGER) AS px, 320 + CAST(l_partkey % 40 - 20 AS INTEGER) AS py, max(1 - l_discount * 5) AS value FROM lineitem GROUP BY 1, 2, 3)"


def masks(spark, d):
    rows = t.table(spark, d, "lineitem")
    return rows.groupBy((F.col("l_suppkey") % 25).alias("image_id"), (F.lit(300) + F.col("l_quantity").cast("int")).alias("px"), (F.lit(320) + (F.col("l_partkey") % 40 - 20).cast("int")).alias("py")).agg(F.max(1 - F.col("l_discount") * 5).alias("value"))


@query("JOIN03_raster_lookup", f"WITH {t.VIEWS}, {MASKS} SELECT point_id, {rd('sum(coalesce(value, 0))')} AS total FROM views v LEFT JOIN masks m ON v.image_id = m.image_id AND CAST(trunc(u) AS INTEGER) = px AND CAST(trunc(v) AS INTEGER) = py GROUP BY 1")
def join03(spark, d):
    return joins.raster_join(t.views(spark, d), masks(spark, d)).groupBy("point_id").agg(rounded(F.sum("value")).alias("total"))


@query(
    "JOIN04_bilinear_lookup",
    f"""WITH {t.VIEWS}, {MASKS}, c AS (SELECT *, CAST(least(greatest(floor(u), 0), 638) AS INTEGER) AS cx, CAST(least(greatest(floor(v), 0), 638) AS INTEGER) AS cy FROM views),
 k AS (SELECT point_id, image_id, cx + dx AS px, cy + dy AS py, (CASE dx WHEN 1 THEN u - cx ELSE 1 - (u - cx) END) * (CASE dy WHEN 1 THEN v - cy ELSE 1 - (v - cy) END) AS w FROM c, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy))
 SELECT point_id, image_id, {rd('sum(w * coalesce(value, 0))')} AS value FROM k LEFT JOIN masks USING (image_id, px, py) GROUP BY 1, 2""",
)
def join04(spark, d):
    return joins.bilinear_join(t.views(spark, d), masks(spark, d), 640).withColumn("value", rounded(F.col("value")))


NN = "nn AS (SELECT p.point_id AS a, q.point_id AS b, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS d2 FROM points p, points q WHERE p.point_id <> q.point_id), rk AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rank FROM nn)"


@query("JOIN05_knn_outlier_removal", f"WITH {t.POINTS}, {NN}, m AS (SELECT a, avg(sqrt(d2)) AS mean FROM rk WHERE rank <= 8 GROUP BY 1), s AS (SELECT avg(mean) + 2 * stddev_pop(mean) AS lim FROM m) SELECT a AS point_id, {rd('mean')} AS mean FROM m CROSS JOIN s WHERE mean <= lim")
def join05(spark, d):
    """Statistical outlier removal: mean distance of k nearest, within two standard deviations of the mean."""
    from orrery.operators.spatial import outlier_removal

    return outlier_removal(t.points(spark, d), 8, 2.0, 3.0).withColumn("mean", rounded(F.col("mean")))


@query(
    "JOIN06_nearest_merge",
    f"WITH {t.POINTS}, edited AS (SELECT point_id AS b, x + 0.1 AS x, y, z, 255 - r AS r, point_id % 3 AS seq FROM points WHERE point_id % 4 = 0), k AS (SELECT p.point_id, arg_max(e.r, (e.seq, e.b)) AS r FROM points p JOIN edited e ON pow(p.x - e.x, 2) + pow(p.y - e.y, 2) + pow(p.z - e.z, 2) <= 0.25 GROUP BY 1) SELECT point_id, coalesce(k.r, p.r) AS r FROM points p LEFT JOIN k USING (point_id)",
)
def join06(spark, d):
    """Edited points overwrite the colour of points within the radius; the last writer wins."""
    from orrery.operators.spatial import merge_edited

    p = t.points(spark, d)
    edited = p.filter("point_id % 4 = 0").select("point_id", (F.col("x") + 0.1).alias("x"), "y", "z", (255 - F.col("r")).alias("r"), (F.col("point_id") % 3).alias("seq"))
    return merge_edited(p, edited, 0.5)


DD = "dd AS (SELECT p.vec_id AS a, q.vec_id AS b, round(list_sum(list_transform(list_zip(p.v, q.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS d FROM descriptors p, descriptors q WHERE p.label < 5 AND q.label >= 5)"


def two_sides(spark, d):
    """Descriptors of labels below 5, and the others."""
    v = t.descriptors(spark, d).select(F.col("vec_id").alias("id"), "v", "label")
    return v.filter("label < 5").drop("label"), v.filter("label >= 5").drop("label")


MUTUAL = "m1 AS (SELECT a, arg_min(b, (d, b)) AS b FROM dd GROUP BY a), m2 AS (SELECT b, arg_min(a, (d, a)) AS a FROM dd GROUP BY b)"


@query("JOIN07_mutual_nearest", f"WITH {t.DESCRIPTORS}, {DD}, {MUTUAL} SELECT a, b FROM m1 JOIN m2 USING (a, b)")
def join07(spark, d):
    return joins.mutual(*two_sides(spark, d))


@query(
    "JOIN08_reciprocal_descent",
    f"WITH RECURSIVE {t.DESCRIPTORS}, {DD}, {MUTUAL}, go(start, a, k) AS (SELECT a, a, 0 FROM m1 WHERE a % 2 = 0 UNION ALL SELECT start, m2.a, k + 1 FROM go JOIN m1 ON go.a = m1.a JOIN m2 ON m1.b = m2.b WHERE k < 6), f AS (SELECT start, arg_max(a, k) AS a FROM go GROUP BY start) SELECT DISTINCT f.a, m1.b FROM f JOIN m1 ON f.a = m1.a JOIN m2 ON m2.b = m1.b AND m2.a = f.a",
)
def join08(spark, d):
    return joins.descend(*two_sides(spark, d), F.col("id") % 2 == 0, 6)


@query("JOIN09_symmetric_union", f"WITH {t.DESCRIPTORS}, {DD}, {MUTUAL}, u AS (SELECT a, b FROM m1 UNION SELECT a, b FROM m2) SELECT a, b, {rd('least(10 - d, 9.5)')} AS conf FROM u JOIN dd USING (a, b)")
def join09(spark, d):
    return joins.both_ways(*two_sides(spark, d)).select("a", "b", rounded(F.least(10 - F.col("d"), F.lit(9.5))).alias("conf"))


@query("JOIN10_names_outer_and_inner", "SELECT p_partkey AS id, p_size, n_name, n_name IS NULL AS created FROM part LEFT JOIN nation ON p_size = n_nationkey")
def join10(spark, d):
    n = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("p_size"), "n_name")
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size").join(joins.small(n), "p_size", "left").withColumn("created", F.col("n_name").isNull())


@query("JOIN11_observation_chain", f"WITH {t.OBSERVATIONS} SELECT track_id, count(*) AS n, min(n_name) AS camera FROM observations JOIN supplier ON image_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON track_id = p_partkey GROUP BY 1")
def join11(spark, d):
    images = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), "s_nationkey").join(joins.small(t.table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("image_id", "n_name")
    points = t.table(spark, d, "part").select(F.col("p_partkey").alias("track_id"))
    return joins.observation_join(t.observations(spark, d), points, images).groupBy("track_id").agg(F.count("*").alias("n"), F.min("n_name").alias("camera"))


@query("JOIN12_edge_ends", f"WITH {t.EDGES} SELECT a, b, p.s_nationkey AS frame_a, q.s_nationkey AS frame_b FROM edges JOIN supplier p ON a = p.s_suppkey JOIN supplier q ON b = q.s_suppkey")
def join12(spark, d):
    s = t.table(spark, d, "supplier")
    end = lambda k: s.select(F.col("s_suppkey").alias(k), F.col("s_nationkey").alias(f"frame_{k}"))
    return t.edges(spark, d).select("a", "b").join(end("a"), "a").join(end("b"), "b").select("a", "b", "frame_a", "frame_b")


@query("JOIN13_covisibility", f"WITH {t.OBSERVATIONS}, k AS (SELECT track_id FROM observations GROUP BY 1 HAVING count(*) > 2) SELECT p.image_id AS a, q.image_id AS b, count(*) AS shared FROM observations p JOIN observations q ON p.track_id = q.track_id AND p.image_id < q.image_id WHERE p.track_id IN (SELECT track_id FROM k) GROUP BY 1, 2")
def join13(spark, d):
    from orrery.operators.graph import covisibility

    return covisibility(t.observations(spark, d), 2)


BOXES = "boxes AS (SELECT o_custkey AS image, o_orderkey AS id, o_orderkey % 31 / 10.0::DOUBLE AS x0, o_orderkey % 37 / 12.0::DOUBLE AS y0, o_orderkey % 31 / 10.0::DOUBLE + 1 + o_orderkey % 3 AS x1, o_orderkey % 37 / 12.0::DOUBLE + 1 + o_orderkey % 5 AS y1 FROM orders)"


def boxes(spark, d, side):
    k = F.col("o_orderkey")
    x, y = (k % 31) / 10.0, (k % 37) / 12.0
    return t.table(spark, d, "orders").select(F.col("o_custkey").alias("image"), k.alias(side), x.alias(f"{side}x0"), y.alias(f"{side}y0"), (x + 1 + k % 3).alias(f"{side}x1"), (y + 1 + k % 5).alias(f"{side}y1"))


IOU = """ov AS (SELECT p.image, p.id AS a, q.id AS b, greatest(least(p.x1, q.x1) - greatest(p.x0, q.x0), 0) * greatest(least(p.y1, q.y1) - greatest(p.y0, q.y0), 0) AS i, (p.x1 - p.x0) * (p.y1 - p.y0) AS s, (q.x1 - q.x0) * (q.y1 - q.y0) AS t,
 (greatest(p.x1, q.x1) - least(p.x0, q.x0)) * (greatest(p.y1, q.y1) - least(p.y0, q.y0)) AS hull FROM boxes p JOIN boxes q ON p.image = q.image AND p.id < q.id),
 iou AS (SELECT image, a, b, i / (s + t - i + 1e-6) AS iou, i / (s + t - i + 1e-6) - (hull - (s + t - i)) / (hull + 1e-6) AS giou FROM ov)"""


@query("JOIN14_box_iou", f"WITH {BOXES}, {IOU} SELECT image, a, b, {rd('iou')} AS iou, {rd('giou')} AS giou FROM iou")
def join14(spark, d):
    return joins.box_pairs(boxes(spark, d, "a"), boxes(spark, d, "b"), "image").filter("a < b").select("image", "a", "b", rounded(F.col("iou")).alias("iou"), rounded(F.col("giou")).alias("giou"))


@query("JOIN15_points_in_boxes", f"WITH {BOXES}, pts AS (SELECT p_partkey AS id, p_partkey % 997 AS sheet, p_partkey % 29 / 9.0::DOUBLE AS x, p_partkey % 23 / 7.0::DOUBLE AS y FROM part) SELECT b.id AS box, count(*) AS n FROM boxes b JOIN pts p ON b.image % 997 = p.sheet AND p.x >= b.x0 AND p.x < b.x1 AND p.y >= b.y0 AND p.y < b.y1 GROUP BY 1")
def join15(spark, d):
    """Points and boxes lie on 997 sheets."""
    k = F.col("p_partkey")
    pts = t.table(spark, d, "part").select(k.alias("id"), (k % 997).alias("sheet"), ((k % 29) / 9.0).alias("x"), ((k % 23) / 7.0).alias("y"))
    on_sheets = boxes(spark, d, "a").withColumn("sheet", F.col("image") % 997)
    return joins.counts_in_boxes(on_sheets, pts, 1.0, ["sheet"]).select(F.col("a").alias("box"), "n")


RECTS = f"{t.VIEWS}, rects AS (SELECT point_id * 100 + image_id AS id, image_id, depth, greatest(0, CAST(floor((u - 12) / 16) AS BIGINT)) AS x0, least(40, CAST(floor((u + 12) / 16) AS BIGINT) + 1) AS x1, greatest(0, CAST(floor((v - 12) / 16) AS BIGINT)) AS y0, least(40, CAST(floor((v + 12) / 16) AS BIGINT) + 1) AS y1 FROM views)"


def rects(spark, d):
    at = lambda k, s: F.floor((F.col(k) + s) / 16)
    zero, forty = F.lit(0).cast("long"), F.lit(40).cast("long")
    return t.views(spark, d).select((F.col("point_id") * 100 + F.col("image_id")).alias("id"), "image_id", "depth", F.greatest(zero, at("u", -12)).alias("x0"), F.least(forty, at("u", 12) + 1).alias("x1"), F.greatest(zero, at("v", -12)).alias("y0"), F.least(forty, at("v", 12) + 1).alias("y1"))


@query("JOIN16_tile_overlap", f"WITH {RECTS} SELECT image_id, tile_x, tile_y, count(*) AS n FROM (SELECT id, image_id, unnest(range(x0, x1)) AS tile_x, y0, y1 FROM rects) a, LATERAL (SELECT unnest(range(a.y0, a.y1)) AS tile_y) GROUP BY 1, 2, 3")
def join16(spark, d):
    r = joins.tiles_of(rects(spark, d), *[F.col(k) for k in ("x0", "y0", "x1", "y1")])
    return r.groupBy("image_id", "tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("JOIN17_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def join17(spark, d):
    rich = t.table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("JOIN18_anti", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.095)")
def join18(spark, d):
    seen = t.table(spark, d, "lineitem").filter("l_quantity > 49 AND l_discount > 0.095").select(F.col("l_suppkey").alias("s_suppkey"))
    return t.table(spark, d, "supplier").join(seen, "s_suppkey", "left_anti").select("s_suppkey")


@query("JOIN19_top_pairs_per_query", f"WITH {t.EDGES}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS rn FROM edges) SELECT a, b, s_name FROM k JOIN supplier ON b = s_suppkey WHERE rn <= 3")
def join19(spark, d):
    top = t.edges(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("w"), "b"))).filter("rn <= 3")
    return top.join(t.table(spark, d, "supplier"), F.col("b") == F.col("s_suppkey")).select("a", "b", "s_name")
