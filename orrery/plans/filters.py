"""Queries on filters (FLT) and set operations (SET)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators import filters as f
from orrery.operators import joins, sets
from orrery.plans import tables as t
from orrery.plans.registry import drawn, query, rd, rounded


@query(
    "FLT01_sanitise",
    f"""WITH {t.POINTS}, bad AS (SELECT point_id, CASE WHEN point_id % 50 = 0 THEN 'nan'::DOUBLE WHEN point_id % 51 = 0 THEN 'inf'::DOUBLE ELSE x END AS x, y, z, r + 40 AS r, g, b FROM points),
 ok AS (SELECT * FROM bad WHERE isfinite(x) AND isfinite(y) AND isfinite(z)), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM ok),
 k AS (SELECT ok.*, n, sqrt(pow(x - mx, 2) + pow(y - my, 2) + pow(z - mz, 2)) AS far FROM ok CROSS JOIN m), q AS (SELECT quantile_cont(far, 0.995) AS lim FROM k)
 SELECT point_id, x, y, z, least(greatest(r, 0), 255) AS r, g, b FROM k CROSS JOIN q WHERE n <= 10 OR far <= lim""",
)
def flt01(spark, d):
    k = F.col("point_id")
    p = t.points(spark, d).withColumn("x", F.when(k % 50 == 0, F.lit(float("nan"))).when(k % 51 == 0, F.lit(float("inf"))).otherwise(F.col("x"))).withColumn("r", F.col("r") + 40)
    return f.sanitise(p)


DEPTHS = f"{t.VIEWS}, seen AS (SELECT p.point_id, avg(v.depth) AS depth, count(v.depth) AS n_views FROM points p LEFT JOIN views v USING (point_id) GROUP BY 1)"


def depths(spark, d):
    p = t.points(spark, d)
    return p.select("point_id").join(t.views(spark, d).groupBy("point_id").agg(F.avg("depth").alias("depth"), F.count("*").alias("n_views")), "point_id", "left").withColumn("n_views", F.coalesce("n_views", F.lit(0)))


@query(
    "FLT02_depth_band",
    f"WITH {DEPTHS}, q AS (SELECT quantile_cont(depth, 0.25) AS a, quantile_cont(depth, 0.5) AS m, quantile_cont(depth, 0.75) AS b FROM seen), k AS (SELECT seen.*, depth IS NULL OR abs(depth - m) <= 0.8 * (b - a) AS stays FROM seen CROSS JOIN q) SELECT point_id, {rd('depth')} AS depth FROM k WHERE stays OR (SELECT count(*) FROM k WHERE stays) < 50",
)
def flt02(spark, d):
    return f.depth_band(depths(spark, d), width=0.8).select("point_id", rounded(F.col("depth")).alias("depth"))


@query("FLT03_confidence_gate", "SELECT event_id, value FROM events WHERE value >= 1.5 AND event_type <> 'error'")
def flt03(spark, d):
    return t.table(spark, d, "events").filter((F.col("value") >= 1.5) & (F.col("event_type") != "error")).select("event_id", "value")


INLIERS = "pairs AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, l_discount < 0.05 AS inlier FROM lineitem)"


def inlier_pairs(spark, d):
    return t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b"), (F.col("l_discount") < 0.05).alias("inlier"))


@query("FLT04_inlier_count", f"WITH {INLIERS} SELECT a, b, CAST(count_if(inlier) AS BIGINT) AS n, count_if(inlier) >= 6 AS is_valid FROM pairs GROUP BY a, b")
def flt04(spark, d):
    return f.inlier_count(inlier_pairs(spark, d), 6)


@query("FLT05_inlier_ratio", f"WITH {INLIERS} SELECT a, b, {rd('count_if(inlier) / count(*)')} AS ratio, count_if(inlier) / count(*) >= 0.4 AS is_valid FROM pairs GROUP BY a, b")
def flt05(spark, d):
    return f.inlier_ratio(inlier_pairs(spark, d), 0.4).withColumn("ratio", rounded(F.col("ratio")))


@query(
    "FLT06_rotation_consistency",
    f"""WITH {t.EDGES}, poses AS (SELECT s_suppkey AS id, radians(s_suppkey * 7 % 360) / 2 AS h FROM supplier WHERE s_suppkey % 5 <> 0)
 SELECT a, b, 2 * degrees(acos(least(1.0, abs(cos((q.h - p.h) - radians(n % 40) / 2))))) <= 10 + 1e-9 AS is_valid FROM edges JOIN poses p ON a = p.id JOIN poses q ON b = q.id""",
)
def flt06(spark, d):
    s = F.col("s_suppkey")
    half = F.radians(s * 7 % 360) / 2
    poses = t.table(spark, d, "supplier").filter("s_suppkey % 5 <> 0").select(s.alias("id"), F.cos(half).alias("w"), F.lit(0.0).alias("x"), F.sin(half).alias("y"), F.lit(0.0).alias("z"))
    turn = F.radians(F.col("n") % 40) / 2
    e = t.edges(spark, d).select("a", "b", F.cos(turn).alias("w"), F.lit(0.0).alias("x"), F.sin(turn).alias("y"), F.lit(0.0).alias("z"))
    return f.rotation_consistency(e, poses, 10 + 1e-9).select("a", "b", "is_valid")


OBS = f"""{t.OBSERVATIONS}, three AS (SELECT o.*, p.x, p.y, p.z, s.s_nationkey FROM observations o JOIN points p ON o.track_id = p.point_id JOIN supplier s ON o.image_id = s.s_suppkey),
 err AS (SELECT *, z + s_nationkey / 10.0 AS depth, sqrt(pow(100 * (x / 20) / (z + s_nationkey / 10.0 + 1e-8) - px, 2) + pow(100 * (y / 20) / (z + s_nationkey / 10.0 + 1e-8) - py, 2)) AS e FROM three)"""


def observed(spark, d):
    """Observations with point, depth and reprojection error."""
    o = joins.observation_join(t.observations(spark, d), t.points(spark, d).withColumnRenamed("point_id", "track_id"), t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), (F.col("s_nationkey") / 10.0).alias("tz")))
    depth = F.col("z") + F.col("tz")
    return o.withColumn("depth", depth).withColumn("e", F.sqrt((100 * (F.col("x") / 20) / (depth + F.lit(1e-8)) - F.col("px")) ** 2 + (100 * (F.col("y") / 20) / (depth + F.lit(1e-8)) - F.col("py")) ** 2))


@query("FLT07_reprojection_filter", f"WITH {t.POINTS}, {OBS}, k AS (SELECT track_id, count(*) AS n, CAST(count_if(depth >= 1e-6 AND e < 30) AS BIGINT) AS n_kept FROM err GROUP BY 1) SELECT track_id, n, n_kept, n <> n_kept AS changed FROM k")
def flt07(spark, d):
    return f.track_filter(observed(spark, d), (F.col("depth") >= 1e-6) & (F.col("e") < 30))


ANG = "degrees(acos(least(greatest((x * px + y * py + z * 10) / (sqrt(x*x + y*y + z*z) * sqrt(px*px + py*py + 100)), -1), 1)))"


@query("FLT08_angle_filter", f"WITH {t.POINTS}, {OBS}, k AS (SELECT track_id, count(*) AS n, CAST(count_if({ANG} < CASE WHEN s_nationkey % 2 = 0 THEN 60 ELSE 120 END) AS BIGINT) AS n_kept FROM err GROUP BY 1) SELECT track_id, n, n_kept, n <> n_kept AS changed FROM k")
def flt08(spark, d):
    a = c.angle_between([F.col("x"), F.col("y"), F.col("z")], [F.col("px"), F.col("py"), F.lit(10.0)])
    calibrated = F.col("tz") * 10 % 2 == 0
    return f.track_filter(observed(spark, d), a < F.when(calibrated, 60).otherwise(120))


@query(
    "FLT09_triangulation_angle",
    f"WITH {t.OBSERVATIONS}, rays AS (SELECT track_id, image_id, px / sqrt(px*px + py*py + 1600) AS a, py / sqrt(px*px + py*py + 1600) AS b, 40 / sqrt(px*px + py*py + 1600) AS c FROM observations), ok AS (SELECT DISTINCT p.track_id FROM rays p JOIN rays q ON p.track_id = q.track_id AND p.image_id < q.image_id WHERE p.a*q.a + p.b*q.b + p.c*q.c < cos(radians(5.0))) SELECT track_id, track_id IN (SELECT track_id FROM ok) AS stays FROM (SELECT DISTINCT track_id FROM rays)",
)
def flt09(spark, d):
    n = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + 1600)
    rays = t.observations(spark, d).select("track_id", "image_id", (F.col("px") / n).alias("a"), (F.col("py") / n).alias("b"), (F.lit(40.0) / n).alias("c"))
    return f.triangulation_angle(rays, 5.0)


@query("FLT10_focal_sanity", "SELECT p_partkey AS camera_id, p_retailprice / (100 * p_size) BETWEEN 0.1 AND 10 AS stays FROM part")
def flt10(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("camera_id"), f.sane_ratio(F.col("p_retailprice"), 100 * F.col("p_size"), 0.1, 10.0).alias("stays"))


@query("FLT11_calibration_residual", f"WITH {t.EDGES} SELECT a, b, (w / n - 25) * (w / n - 25) <= 2.0 * 2.0 AS is_valid FROM edges")
def flt11(spark, d):
    r = F.col("w") / F.col("n") - 25
    return t.edges(spark, d).select("a", "b", (r * r <= 4.0).alias("is_valid"))


SEQ = "seq AS (SELECT DISTINCT l_suppkey AS i, l_partkey % 100 AS j FROM lineitem)"


def sequence(spark, d):
    return t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 100).alias("j")).distinct()


@query("FLT12_sequence_distance", f"WITH {SEQ}, n AS (SELECT greatest(max(i), max(j)) + 1 AS n FROM seq) SELECT i, j, abs(i - j) <= 5 AS is_linear FROM seq, n WHERE least(abs(i - j), n - abs(i - j)) <= 5")
def flt12(spark, d):
    return f.sequence_distance(sequence(spark, d), 5, cyclic=True).withColumn("is_linear", F.abs(F.col("i") - F.col("j")) <= 5)


GAUSS = "gauss AS (SELECT p_partkey AS id, (p_partkey % 40 - 20) / 4.0::DOUBLE AS opacity, ln((p_size + 1) / 60.0::DOUBLE) AS s0, ln((p_partkey % 30 + 1) / 45.0::DOUBLE) AS s1, ln((p_partkey % 11 + 1) / 25.0::DOUBLE) AS s2, CAST(p_partkey % 25 AS DOUBLE) AS radius, (p_partkey % 100) / 300000.0::DOUBLE AS grad FROM part)"


def gaussians(spark, d):
    k = F.col("p_partkey")
    return t.table(spark, d, "part").select(
        k.alias("id"), ((k % 40 - 20) / 4.0).alias("opacity"), F.ln((F.col("p_size") + 1) / 60.0).alias("s0"), F.ln((k % 30 + 1) / 45.0).alias("s1"), F.ln((k % 11 + 1) / 25.0).alias("s2"), (k % 25).cast("double").alias("radius"), ((k % 100) / 300000.0).alias("grad")
    )


@query("FLT13_prune", f"WITH {GAUSS} SELECT id FROM gauss WHERE NOT (1 / (1 + exp(-opacity)) < 0.005 OR radius > 20 OR exp(greatest(s0, s1, s2)) > 0.1 * 5)")
def flt13(spark, d):
    return gaussians(spark, d).filter(~f.prunable(5.0)).select("id")


@query("FLT14_cull", f"WITH {GAUSS} SELECT id FROM gauss WHERE NOT (1 / (1 + exp(-opacity)) < 0.1 OR (exp(greatest(s0, s1, s2)) > 0.5 OR radius / 100 > 0.15))")
def flt14(spark, d):
    return gaussians(spark, d).filter(~f.cullable(True)).select("id")


@query("FLT15_detection_threshold", "WITH s AS (SELECT user_id AS q, event_type AS token, max(value) AS logit FROM events GROUP BY 1, 2) SELECT q, " + rd("max(1 / (1 + exp(-(logit - 100) / 20)))") + " AS score FROM s GROUP BY q HAVING max(1 / (1 + exp(-(logit - 100) / 20))) > 0.35")
def flt15(spark, d):
    s = t.table(spark, d, "events").groupBy(F.col("user_id").alias("q"), F.col("event_type").alias("token")).agg(F.max("value").alias("logit"))
    return f.detections(s.withColumn("logit", (F.col("logit") - 100) / 20), 0.35).withColumn("score", rounded(F.col("score")))


@query("FLT16_cluster_box_area", f"WITH {t.POINTS}, k AS (SELECT r % 12 AS cluster, (max(x) - min(x)) * (max(y) - min(y)) / (37.0 * 41.0) AS area FROM points GROUP BY 1) SELECT cluster, {rd('area')} AS area FROM k WHERE area BETWEEN 0.02 AND 0.92")
def flt16(spark, d):
    k = t.points(spark, d).groupBy((F.col("r") % 12).alias("cluster")).agg(((F.max("x") - F.min("x")) * (F.max("y") - F.min("y")) / (37.0 * 41.0)).alias("area"))
    return k.filter(F.col("area").between(0.02, 0.92)).withColumn("area", rounded(F.col("area")))


@query("FLT17_audit", "SELECT conv_id, turn, contains(upper(text), 'OK') AS ok FROM conversations")
def flt17(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", f.audit_ok(F.col("text")).alias("ok"))


@query(
    "FLT18_upload",
    "WITH k AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' WHEN 3 THEN '.webp' ELSE '.jpeg' END AS name, p_retailprice * 9000 AS bytes FROM part), o AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM k WHERE bytes <= 10485760 AND regexp_matches(lower(name), 'jpeg|jpg|png|webp')) SELECT id, name FROM o WHERE rn <= 50",
)
def flt18(spark, d):
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".gif", ".webp", ".jpeg"))), (k % 5 + 1).cast("int"))
    files = t.table(spark, d, "part").select(k.alias("id"), F.concat("p_name", ext).alias("name"), (F.col("p_retailprice") * 9000).alias("bytes"))
    return f.upload(files).select("id", "name")


@query("FLT19_quality_sample", f"WITH k AS (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000) ORDER BY {drawn('o_custkey')}, o_custkey LIMIT 20) SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT o_custkey FROM k) GROUP BY 1")
def flt19(spark, d):
    """A hash-ordered sample of sequences of good quality."""
    orders = t.table(spark, d, "orders")
    chosen = f.sample_groups(orders.filter("o_totalprice > 100000"), "o_custkey", 20)
    return orders.join(F.broadcast(chosen), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"))


CLEAN = f"{t.VIEWS}, px AS (SELECT point_id, image_id, CAST(trunc(u / 8) AS BIGINT) AS a, CAST(trunc(v / 8) AS BIGINT) AS b, depth, 1.0 + r / 100.0 AS conf FROM views), best AS (SELECT image_id, a, b, max(conf) AS mc, min(depth) AS md FROM px GROUP BY 1, 2, 3)"


@query("FLT20_depth_consistency", f"WITH {CLEAN} SELECT point_id, {rd('min(CASE WHEN depth < (1 - 0.001) * md AND conf < mc THEN least(conf, 0.0) WHEN depth > 1.02 * md AND conf < mc THEN least(conf, 0.5) ELSE conf END)')} AS conf FROM px JOIN best USING (image_id, a, b) GROUP BY 1")
def flt20(spark, d):
    """One pass over all views, so the result does not depend on their order."""
    px = t.views(spark, d).select("point_id", "image_id", (F.col("u") / 8).cast("long").alias("a"), (F.col("v") / 8).cast("long").alias("b"), "depth", (1.0 + F.col("r") / 100.0).alias("conf"))
    return f.depth_consistency(px).withColumn("conf", rounded(F.col("conf")))


@query("FLT21_prefix_pairs", f"WITH {SEQ} SELECT i, j FROM seq WHERE NOT (starts_with(CAST(i AS VARCHAR), '1') AND starts_with(CAST(j AS VARCHAR), '2'))")
def flt21(spark, d):
    return f.prefix_pairs(sequence(spark, d), "1", "2", both=True, complement=True)


# --- set operations ----------------------------------------------------------------------------------------------


@query("SET01_voxel_first", f"WITH {t.POINTS} SELECT CAST(floor(x / 3) AS BIGINT) AS vx, CAST(floor(y / 3) AS BIGINT) AS vy, CAST(floor(z / 3) AS BIGINT) AS vz, min(point_id) AS point_id FROM points GROUP BY 1, 2, 3")
def set01(spark, d):
    return sets.voxel_first(t.points(spark, d), 3.0, "point_id").select("vx", "vy", "vz", "point_id")


@query("SET02_adaptive_voxel")
def set02(spark, d):
    return sets.adaptive_voxel(t.points(spark, d), 300, "point_id").select(F.count("*").alias("n"), F.lit(True).alias("bounded"))


DIR = "directed AS (SELECT l_suppkey AS a, l_partkey % 60 AS b, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2)"


def directed(spark, d):
    return t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 60).alias("b")).agg(F.min("l_orderkey").alias("seq"))


@query("SET03_unordered_pairs", f"WITH {DIR}, k AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY seq, a, b) AS rn FROM directed) SELECT a, b FROM k WHERE rn = 1")
def set03(spark, d):
    return sets.unordered_first(directed(spark, d), "seq").select("a", "b")


@query("SET04_symmetrize", f"WITH {DIR} SELECT a, b FROM directed UNION ALL SELECT b, a FROM directed")
def set04(spark, d):
    return sets.symmetrize(directed(spark, d).select("a", "b"))


@query("SET05_concat_repeat_resize", "WITH k AS (SELECT n_nationkey AS id FROM nation UNION ALL SELECT r_regionkey + 100 FROM region), r AS (SELECT id, c FROM k CROSS JOIN (SELECT unnest(range(3)) AS c)) SELECT id, CAST(c AS BIGINT) AS copy FROM r")
def set05(spark, d):
    one = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    two = t.table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("id"))
    return sets.repeat(one.unionByName(two), 3)


@query("SET06_distinct_matches", "SELECT DISTINCT l_suppkey AS f1, l_linenumber AS f2 FROM lineitem")
def set06(spark, d):
    return t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("f1"), F.col("l_linenumber").alias("f2")).distinct()


@query("SET07_split", "WITH k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, CASE WHEN i % 8 = 0 THEN 'test' ELSE 'train' END AS part FROM k")
def set07(spark, d):
    return sets.hold_out(t.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 8)


@query("SET08_mask_union", "SELECT DISTINCT l_suppkey AS image_id, l_linenumber AS v, l_partkey % 50 AS u FROM lineitem WHERE l_discount < 0.03 OR l_tax < 0.02")
def set08(spark, d):
    rows = t.table(spark, d, "lineitem")
    mask = lambda cond: rows.filter(cond).select(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("v"), (F.col("l_partkey") % 50).alias("u"))
    return sets.mask_union(mask("l_discount < 0.03"), mask("l_tax < 0.02"))


@query("SET09_modulo_hold_out", "SELECT o_custkey, o_custkey % 10 = 0 AS held_out, count(*) AS n FROM orders GROUP BY 1")
def set09(spark, d):
    return t.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("held_out", F.pmod("o_custkey", F.lit(10)) == 0)
