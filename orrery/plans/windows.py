"""Queries on ordered sequences (WIN) and on sorting, limits and samples (SRT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.operators import joins, sets
from orrery.operators import windows as w
from orrery.plans import tables as t
from orrery.plans.joining import RECTS, rects
from orrery.plans.projections import prj31
from orrery.plans.registry import ORACLES, drawn, query, rd, rounded


@query("WIN01_top_per_view", "WITH k AS (SELECT l_suppkey AS view, l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_partkey, l_discount, l_extendedprice) AS rn FROM lineitem) SELECT view, l_orderkey, l_partkey FROM k WHERE rn <= 20")
def win01(spark, d):
    rows = t.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "view")
    return w.top_per_key(rows, "view", [F.desc("l_quantity"), "l_orderkey", "l_partkey", "l_discount", "l_extendedprice"], 20).select("view", "l_orderkey", "l_partkey")


# searches take the rows whose id is divisible by 100 as queries, against all rows
SIM = "sim AS (SELECT p.vec_id AS i, q.vec_id AS j, round(list_sum(list_transform(list_zip(p.v, q.v), lambda x: x[1] * x[2])), 6) AS s FROM descriptors p, descriptors q WHERE p.vec_id % 100 = 0)"


def asked(spark, d):
    return t.descriptors(spark, d).filter("vec_id % 100 = 0")


@query("WIN02_nearest_per_row", f"WITH {t.DESCRIPTORS}, {SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rn FROM sim WHERE i <> j) SELECT i, j FROM k WHERE rn <= 5")
def win02(spark, d):
    return joins.search(asked(spark, d).select(F.col("vec_id").alias("id"), "v"), t.descriptors(spark, d).select(F.col("vec_id").alias("id"), "v"), 5).select("i", "j")


@query("WIN03_hold_out_of_sorted_names", "WITH k AS (SELECT s_name, row_number() OVER (ORDER BY s_name) - 1 AS i FROM supplier) SELECT s_name, i % 8 = 0 AS is_test FROM k")
def win03(spark, d):
    return sets.hold_out(t.table(spark, d, "supplier").select("s_name"), "s_name", 8).select("s_name", (F.col("part") == "test").alias("is_test"))


@query("WIN04_representative_frames", "WITH k AS (SELECT l_suppkey AS seq, l_orderkey AS frame, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) SELECT seq, frame FROM k WHERE i % greatest(n // 6, 1) = 0 AND i // greatest(n // 6, 1) < 6")
def win04(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seq"), F.col("l_orderkey").alias("frame")).distinct()
    return w.stride(rows, "seq", "frame", 6).select("seq", "frame")


@query("WIN05_prefix_sums", f"WITH {RECTS}, k AS (SELECT id, (x1 - x0) * (y1 - y0) AS n FROM rects) SELECT id, CAST(coalesce(sum(n) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k")
def win05(spark, d):
    r = rects(spark, d).withColumn("n", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return w.prefix_sum(r, "id", "n").select("id", "start")


TILES = f"{RECTS}, tiles AS (SELECT id, depth, image_id * 1600 + tile_y * 40 + tile_x AS tile FROM (SELECT id, image_id, depth, unnest(range(x0, x1)) AS tile_x, y0, y1 FROM rects) a, LATERAL (SELECT unnest(range(a.y0, a.y1)) AS tile_y))"


def tiles(spark, d):
    return joins.tiles_of(rects(spark, d), *[F.col(k) for k in ("x0", "y0", "x1", "y1")]).select("id", "depth", (F.col("image_id") * 1600 + F.col("tile_y") * 40 + F.col("tile_x")).alias("tile"))


@query("WIN06_tile_ranges", f"WITH {TILES}, n AS (SELECT tile, count(*) AS n FROM tiles GROUP BY 1) SELECT tile, CAST(sum(n) OVER (ORDER BY tile) - n AS BIGINT) AS first, CAST(sum(n) OVER (ORDER BY tile) AS BIGINT) AS stop FROM n")
def win06(spark, d):
    return w.tile_ranges(tiles(spark, d))


@query(
    "WIN07_compositing",
    f"""WITH {TILES}, a AS (SELECT tile, id, depth, least(0.99::DOUBLE, 0.1::DOUBLE + (id % 8) / 9.7::DOUBLE) AS alpha, (id % 5) / 3.9::DOUBLE AS c FROM tiles),
 k AS (SELECT *, coalesce(exp(sum(ln(1 - alpha)) OVER (PARTITION BY tile ORDER BY depth, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS before FROM a WHERE alpha >= 1 / 255.0),
 g AS (SELECT *, before * (1 - alpha) AS after FROM k) SELECT tile, {rd('sum(c * alpha * before)', 9)} AS colour, {rd('min(after)', 9)} AS rest, count(*) AS n FROM g WHERE after >= 1e-4 GROUP BY 1""",
)
def win07(spark, d):
    rows = tiles(spark, d).withColumn("alpha", F.least(F.lit(0.99), 0.1 + (F.col("id") % 8) / 9.7)).withColumn("c", (F.col("id") % 5) / 3.9)
    return w.composite(rows).select("tile", rounded(F.col("colour"), 9).alias("colour"), rounded(F.col("rest"), 9).alias("rest"), "n")


@query("WIN08_moving_average", f"WITH RECURSIVE k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), e(user_id, i, ema) AS (SELECT user_id, i, 0.4 * value FROM k WHERE i = 1 UNION ALL SELECT k.user_id, k.i, 0.4 * k.value + 0.6 * e.ema FROM e JOIN k ON k.user_id = e.user_id AND k.i = e.i + 1) SELECT user_id, {rd('arg_max(ema, i)', 5)} AS ema FROM e GROUP BY 1")
def win08(spark, d):
    return w.ema(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.4).select("user_id", rounded(F.col("ema"), 5).alias("ema"))


@query(
    "WIN09_smoothed_value",
    f"""WITH k AS (SELECT event_id, value, avg(value) OVER w AS mean, max(value) OVER w AS top, list_sort(list(value) OVER w) AS l, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS overall FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
 SELECT event_id, {rd('l[(len(l) + 1) // 2]')} AS med, {rd('mean')} AS mean, {rd('top')} AS top, {rd('overall', 9)} AS overall FROM k""",
)
def win09(spark, d):
    out = w.smoothed(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 20)
    return out.select("event_id", *[rounded(F.col(k), p).alias(k) for k, p in (("med", 6), ("mean", 6), ("top", 6), ("overall", 9))])


@query("WIN10_concatenation_offsets", "WITH k AS (SELECT n_nationkey AS scene, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) SELECT CAST(scene AS BIGINT) AS scene, n, CAST(coalesce(sum(n) OVER (ORDER BY scene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k")
def win10(spark, d):
    return w.prefix_sum(scenes(spark, d), "scene", "n")


def scenes(spark, d):
    s = t.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.table(spark, d, "nation").join(s, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("scene"), F.coalesce("n", F.lit(0)).alias("n"))


@query("WIN11_cumulative_lookup", "WITH k AS (SELECT n_nationkey AS scene, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1), c AS (SELECT scene, sum(n) OVER (ORDER BY scene) AS stop, sum(n) OVER (ORDER BY scene) - n AS start FROM k) SELECT p_partkey AS id, CAST(scene AS BIGINT) AS scene, CAST(p_partkey % 100 - start AS BIGINT) AS place FROM part JOIN c ON p_partkey % 100 >= start AND p_partkey % 100 < stop")
def win11(spark, d):
    q = t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("at"))
    return w.cumulative_lookup(q, w.prefix_sum(scenes(spark, d), "scene", "n"))


@query("WIN12_sliding_pairs", "WITH k AS (SELECT s_suppkey AS a, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) SELECT p.a AS a, q.a AS b FROM k p JOIN k q ON q.i - p.i BETWEEN 1 AND 3")
def win12(spark, d):
    return w.sliding_pairs(t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("a")), "a", 3)


@query("WIN14_top_features", "WITH k AS (SELECT l_suppkey AS image, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT image, l_orderkey, l_partkey FROM k WHERE rn <= CAST(floor(0.05 * n) AS BIGINT)")
def win14(spark, d):
    rows = t.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "image")
    return w.top_share(rows, "image", [F.desc("l_extendedprice"), "l_orderkey", "l_partkey"], 0.05).select("image", "l_orderkey", "l_partkey")


# --- sorts, limits, samples --------------------------------------------------------------------------------------


@query("SRT01_list_projects", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey")
def srt01(spark, d):
    return t.table(spark, d, "orders").filter("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SRT02_tracks_by_length", f"WITH {t.OBSERVATIONS}, k AS (SELECT track_id, count(*) AS len FROM observations GROUP BY 1) SELECT track_id, len, row_number() OVER (ORDER BY len DESC, track_id DESC) AS place FROM k ORDER BY place LIMIT 100")
def srt02(spark, d):
    n = t.observations(spark, d).groupBy("track_id").agg(F.count("*").alias("len"))
    top = n.orderBy(F.desc("len"), F.desc("track_id")).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("len"), F.desc("track_id"))).cast("long"))


@query("SRT03_track_selection", f"WITH {t.OBSERVATIONS} SELECT track_id, count(*) AS len FROM observations GROUP BY 1 HAVING count(*) >= 25")
def srt03(spark, d):
    """Without a quota, which never binds by default, the length decides."""
    n = t.observations(spark, d).groupBy("track_id").agg(F.count("*").alias("len"))
    return n.filter("len >= 25")


@query("SRT03_track_quota")
def srt03_quota(spark, d):
    return w.quota_selection(t.observations(spark, d), 3, 25, 500).groupBy("track_id").agg(F.count("*").alias("len"))


@query("SRT04_tile_depth_order", f"WITH {TILES} SELECT tile, id, row_number() OVER (PARTITION BY tile ORDER BY depth, id) AS place FROM tiles")
def srt04(spark, d):
    """Sorted by tile and depth: range partitions, then ranks within a tile."""
    return tiles(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("tile").orderBy("depth", "id")).cast("long")).select("tile", "id", "place")


@query("SRT05_morton_order", f"WITH m AS ({ORACLES['PRJ31_morton']}) SELECT point_id, code, row_number() OVER (ORDER BY code, point_id) - 1 AS place FROM m")
def srt05(spark, d):
    return sets.global_rank(prj31(spark, d), "code", "point_id").select("point_id", "code", F.col("place").cast("long").alias("place"))


@query("SRT06_top_detections", "WITH k AS (SELECT l_suppkey AS image, l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_quantity) AS rn FROM lineitem) SELECT image, l_orderkey, l_partkey FROM k WHERE rn <= 300")
def srt06(spark, d):
    rows = t.table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "image")
    return w.top_per_key(rows, "image", [F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_quantity"], 300).select("image", "l_orderkey", "l_partkey")


@query("SRT07_best_mask", "WITH k AS (SELECT o_custkey AS image, o_orderkey AS mask, (o_orderkey % 100) / 100.0::DOUBLE AS dist, (o_orderkey % 67) / 67.0::DOUBLE AS area FROM orders) SELECT image, arg_max(mask, (0.6 * (1 - dist) + 0.4 * area, -mask)) AS mask FROM k WHERE area > 0.02 AND area < 0.60 GROUP BY 1")
def srt07(spark, d):
    k = F.col("o_orderkey")
    return w.best_mask(t.table(spark, d, "orders").select(F.col("o_custkey").alias("image"), k.alias("mask"), ((k % 100) / 100.0).alias("dist"), ((k % 67) / 67.0).alias("area")))


@query("SRT08_farthest_points")
def srt08(spark, d):
    return w.farthest_points(t.descriptors(spark, d).select(F.col("vec_id").alias("id"), "v"), 10)


@query("SRT09_greedy_cover")
def srt09(spark, d):
    rows = t.table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("crop"), (F.col("l_partkey") % 400).alias("pixel"), (1 + F.col("l_discount")).alias("w")).groupBy("crop", "pixel").agg(F.max("w").alias("w"))
    return w.greedy_cover(rows, 0.9)


@query("SRT10_hash_sample", f"SELECT o_orderkey FROM orders ORDER BY {drawn('o_orderkey')}, o_orderkey LIMIT 500")
def srt10(spark, d):
    return w.hash_sample(t.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("SRT11_batched_sampler", f"WITH k AS (SELECT (row_number() OVER (ORDER BY {drawn('o_orderkey', '780 ')}, o_orderkey) - 1) // 32 AS batch FROM orders) SELECT batch, CAST(floor({drawn('batch', '780 batch ')} * 5) AS BIGINT) AS feature, count(*) AS n FROM k GROUP BY 1, 2")
def srt11(spark, d):
    return w.batches(t.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 32, 5, 3).groupBy("batch", "feature").agg(F.count("*").alias("n"))


@query("SRT12_hard_negatives", f"WITH {t.DESCRIPTORS}, {SIM}, k AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rn FROM sim JOIN descriptors p ON i = p.vec_id JOIN descriptors q ON j = q.vec_id WHERE p.label <> q.label) SELECT i, j FROM k WHERE rn <= 2")
def srt12(spark, d):
    """The most similar rows with another label."""
    rows = t.descriptors(spark, d).select(F.col("vec_id").alias("id"), "v", F.col("label").alias("tag"))
    return joins.search(rows.filter("id % 100 = 0"), rows, 2).select("i", "j")


@query("SRT13_even_frames", "WITH f AS (SELECT DISTINCT l_suppkey AS seq, l_orderkey AS frame FROM lineitem), n AS (SELECT seq, count(*) AS n FROM f GROUP BY 1), g AS (SELECT DISTINCT seq, CAST(round_even(j * ((n - 1) / 9.0), 0) AS BIGINT) AS i FROM n, (SELECT unnest(range(10)) AS j)), k AS (SELECT seq, frame, row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS i FROM f) SELECT seq, frame FROM k JOIN g USING (seq, i)")
def srt13(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("seq"), F.col("l_orderkey").alias("frame")).distinct()
    return w.even_frames(rows, "seq", "frame", 10).select("seq", "frame")
