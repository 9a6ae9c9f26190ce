"""Queries on graphs (GRA), clusters (CLU), iterations (ITR), solver shells (SOL) and detector shells (NN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators import graph as g
from orrery.operators import joins, spatial
from orrery.operators import splats as sp
from orrery.plans import tables as t
from orrery.plans.filters import GAUSS, gaussians
from orrery.plans.projections import PAIR, pairs_of_pixels
from orrery.plans.registry import drawn, query, rd, rounded
from orrery.plans.windows import SIM

IDS = "ids AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n FROM supplier)"


def ids(spark, d):
    return t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))


@query("GRA01_complete_pairs", f"WITH {IDS} SELECT p.i AS i, q.i AS j FROM ids p JOIN ids q ON p.i > q.i")
def gra01(spark, d):
    return g.complete_pairs(ids(spark, d))


@query("GRA02_window_pairs", f"WITH {IDS}, k AS (SELECT i, (i + w) % n AS j FROM ids, (SELECT unnest(range(1, 6)) AS w)) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM k")
def gra02(spark, d):
    return g.window_pairs(ids(spark, d), 5, cyclic=True)


@query("GRA02_window_pairs_linear", f"WITH {IDS} SELECT i, i + w AS j FROM ids, (SELECT unnest(range(1, 6)) AS w) WHERE i + w < n")
def gra02_linear(spark, d):
    return g.window_pairs(ids(spark, d), 5, cyclic=False)


@query("GRA03_log_window_pairs", f"WITH {IDS}, k AS (SELECT i, i + s * w AS j, n FROM ids, (SELECT unnest([1, 2, 4, 8, 16]) AS w), (SELECT unnest([1, -1]) AS s)) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM k WHERE j >= 0 AND j < n AND i <> j")
def gra03(spark, d):
    return g.log_window_pairs(ids(spark, d), 5)


@query("GRA04_one_reference", f"WITH {IDS} SELECT 3 AS i, i AS j FROM ids WHERE i <> 3")
def gra04(spark, d):
    return g.star_pairs(ids(spark, d), 3)


@query("GRA05_retrieval_pairs")
def gra05(spark, d):
    rows = t.descriptors(spark, d).select(F.col("vec_id").alias("id"), "v")
    return g.retrieval_pairs(rows, 8, 4, rows.filter("id % 100 = 0"))


@query("GRA06_adjacency", f"WITH {t.EDGES}, e AS (SELECT a, b FROM edges WHERE n > 1 UNION ALL SELECT b, a FROM edges WHERE n > 1) SELECT a AS node, count(*) AS degree, CAST(sum(b) AS BIGINT) AS total FROM e GROUP BY 1")
def gra06(spark, d):
    adj = g.adjacency(t.edges(spark, d).filter("n > 1"))
    return adj.select("node", F.size("near").cast("long").alias("degree"), F.aggregate("near", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


SPARSE = "sparse AS (SELECT DISTINCT c_custkey * 2 AS a, c_custkey * 2 + 2 * (1 + c_custkey % 3) AS b FROM customer WHERE c_custkey % 7 <> 0)"


def sparse(spark, d):
    k = F.col("c_custkey")
    return t.table(spark, d, "customer").filter("c_custkey % 7 <> 0").select((k * 2).alias("a"), (k * 2 + 2 * (1 + k % 3)).alias("b")).distinct()


CC = f"{SPARSE}, bth AS (SELECT a, b FROM sparse UNION SELECT b, a FROM sparse), reach(node, root) AS (SELECT DISTINCT a, a FROM bth UNION SELECT b.b, r.root FROM reach r JOIN bth b ON b.a = r.node WHERE b.b > r.root), cc AS (SELECT node, min(root) AS component FROM (SELECT node, root FROM reach UNION ALL SELECT a, a FROM bth) GROUP BY 1)"


@query("GRA07_components", f"WITH RECURSIVE {CC} SELECT node, component FROM cc")
def gra07(spark, d):
    return g.components(sparse(spark, d))


@query("GRA08_largest_component", f"WITH RECURSIVE {CC}, sz AS (SELECT component, count(*) AS n FROM cc GROUP BY 1) SELECT node, component = (SELECT arg_max(component, (n, -component)) FROM sz) AS is_registered FROM cc")
def gra08(spark, d):
    return g.keep_largest(sparse(spark, d))


@query("GRA09_component_ranks", f"WITH RECURSIVE {CC}, sz AS (SELECT component, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS k FROM cc GROUP BY 1 HAVING count(*) >= 10) SELECT node, coalesce(k, -1) AS cluster_id FROM cc LEFT JOIN sz USING (component)")
def gra09(spark, d):
    return g.rank_components(sparse(spark, d), 10)


@query("GRA10_tracks")
def gra10(spark, d):
    rows = t.table(spark, d, "lineitem")
    m = rows.select((F.col("l_suppkey") % 20).alias("i1"), (F.col("l_partkey") % 400).alias("f1"), (F.col("l_orderkey") % 20).alias("i2"), ((F.col("l_partkey") * 3) % 400).alias("f2")).filter("i1 <> i2").distinct()
    pixels = spark.range(20).select(F.col("id").alias("image")).crossJoin(spark.range(400).select(F.col("id").alias("feature"))).withColumn("x", (F.col("feature") % 20).cast("double")).withColumn("y", F.floor(F.col("feature") / 20).cast("double"))
    return g.establish_tracks(m, pixels, 10.0).groupBy("track_id").agg(F.count("*").alias("n"))


REACH = "bth AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(node, root) AS (SELECT DISTINCT a, a FROM bth UNION SELECT b.b, r.root FROM reach r JOIN bth b ON b.a = r.node WHERE b.b > r.root), cc AS (SELECT node, min(root) AS component FROM reach GROUP BY 1)"


@query("GRA11_incremental_tracks", f"WITH RECURSIVE links AS (SELECT DISTINCT (p_partkey % 10) * 4294967296 + p_partkey % 97 AS a, (p_partkey % 10 + 1) * 4294967296 + p_partkey % 89 AS b FROM part), {REACH}, long AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS track FROM cc GROUP BY 1 HAVING count(*) >= 3) SELECT track, node >> 32 AS image, node & 4294967295 AS feature FROM cc JOIN long USING (component)")
def gra11(spark, d):
    rows = t.table(spark, d, "part")
    k = F.col("p_partkey")
    m = rows.select((k % 10).alias("i1"), (k % 97).alias("f1"), (k % 10 + 1).alias("i2"), (k % 89).alias("f2"))
    return g.merged_tracks(m, 3)


@query(
    "GRA12_maximum_spanning_tree",
    f"""WITH RECURSIVE {t.EDGES}, grow(nodes, e, k) AS (SELECT [(SELECT min(a) FROM edges)], NULL::STRUCT(a BIGINT, b BIGINT, w DOUBLE), 0
 UNION ALL SELECT list_append(nodes, CASE WHEN list_contains(nodes, e.a) THEN e.b ELSE e.a END), e, k + 1 FROM (SELECT nodes, k, arg_max({{'a': a, 'b': b, 'w': w}}::STRUCT(a BIGINT, b BIGINT, w DOUBLE), (w, -a, -b)) AS e FROM grow, edges WHERE list_contains(nodes, a) <> list_contains(nodes, b) GROUP BY nodes, k))
 SELECT e.a AS a, e.b AS b, e.w AS w FROM grow WHERE k > 0""",
)
def gra12(spark, d):
    return g.maximum_spanning_tree(t.edges(spark, d).select("a", "b", "w"))


@query("GRA13_centred_tree")
def gra13(spark, d):
    return g.centred_tree(g.maximum_spanning_tree(t.edges(spark, d).select("a", "b", "w")))


@query(
    "GRA14_pose_chain",
    f"""WITH RECURSIVE {t.EDGES}, strong AS (SELECT a, b FROM edges WHERE n > 12), bth AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
 walk(node, level) AS (SELECT 0::BIGINT, 0 UNION SELECT bth.b, level + 1 FROM walk JOIN bth ON bth.a = node WHERE level < 100), lv AS (SELECT node, min(level) AS level FROM walk GROUP BY 1),
 tree AS (SELECT c.node, min(p.node) AS parent FROM lv c JOIN (SELECT lv.node, lv.level, bth.b FROM lv JOIN bth ON bth.a = lv.node) p ON p.b = c.node AND p.level = c.level - 1 GROUP BY 1),
 pose(node, m, tx, ty, sc) AS (SELECT 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT tree.node, m + (tree.node - parent) / 50.0, tx + sc * (cos(m) * parent / 10.0 - sin(m) * tree.node / 10.0), ty + sc * (sin(m) * parent / 10.0 + cos(m) * tree.node / 10.0), sc * (1 + tree.node % 3 / 10.0) FROM pose JOIN tree ON pose.node = parent)
 SELECT node, {rd('tx', 6)} AS tx, {rd('ty', 6)} AS ty, {rd('sc', 6)} AS scale FROM pose""",
)
def gra14(spark, d):
    """Similarity transforms of neighbours, composed from the root along a tree: turns about z, shifts and scales."""
    tree = g.breadth_first(t.edges(spark, d).filter("n > 12").select("a", "b"), 0)
    turn, k = (F.col("node") - F.col("parent")) / 50.0, F.col("node")
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = F.array(F.cos(turn), -F.sin(turn), zero, F.sin(turn), F.cos(turn), zero, zero, zero, one)
    step = tree.select("node", "parent", "level", rows.alias("rot"), F.array(F.col("parent") / 10.0, k / 10.0, zero).alias("shift"), (1 + k % 3 / 10.0).alias("scale"))
    out = g.chained_poses(step)
    return out.select("node", *[rounded(F.get("shift", F.lit(i))).alias(x) for i, x in enumerate(("tx", "ty"))], rounded(F.col("scale")).alias("scale"))


@query("GRA15_ward_tree")
def gra15(spark, d):
    """The kinematic tree of the strongest edges' graph."""
    e = t.edges(spark, d)
    most = e.agg(F.max("n").alias("most"))
    return g.ward_tree(e.crossJoin(F.broadcast(most)).select("a", "b", (F.col("n") / F.col("most")).alias("s"))).select("a", "b", rounded(F.col("d")).alias("d"))


@query("GRA16_sparsify", f"WITH {t.EDGES}, deg AS (SELECT v, count(*) AS k FROM (SELECT a AS v FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1) SELECT a, b, p.k AS ka, q.k AS kb FROM edges JOIN deg p ON a = p.v JOIN deg q ON b = q.v WHERE p.k <= 95 OR q.k <= 95")
def gra16(spark, d):
    """With every other edge's chance set to nothing, what stays is decided by degrees alone."""
    return g.sparsify(t.edges(spark, d), 95, 0.0).select("a", "b", "ka", "kb")


@query("GRA16_sparsify_sampled", f"WITH {t.EDGES}, deg AS (SELECT v, count(*) AS k FROM (SELECT a AS v FROM edges UNION ALL SELECT b FROM edges) GROUP BY 1), mean AS (SELECT avg(k) AS m FROM deg) SELECT a, b FROM edges JOIN deg p ON a = p.v JOIN deg q ON b = q.v CROSS JOIN mean WHERE p.k <= 50 OR q.k <= 50 OR {drawn("a || ' ' || b")} < 30.0 * m / (p.k * q.k)")
def gra16_sampled(spark, d):
    return g.sparsify(t.edges(spark, d), 50, 30.0).select("a", "b")


@query("GRA17_strong_clusters")
def gra17(spark, d):
    return g.strong_clusters(t.edges(spark, d).select("a", "b", F.col("n").alias("w")), 22.0)


@query("GRA18_weakly_connected")
def gra18(spark, d):
    return g.prune_weak(t.observations(spark, d), 5)


@query(
    "GRA19_strong_tree",
    f"""WITH RECURSIVE {t.EDGES}, strong AS (SELECT a, b FROM edges WHERE n > 12 AND NOT (a = 0 AND b IN (1, 2))), bth AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong),
 walk(node, level) AS (SELECT 0::BIGINT, 0 UNION SELECT bth.b, level + 1 FROM walk JOIN bth ON bth.a = node WHERE level < 100), lv AS (SELECT node, min(level) AS level FROM walk GROUP BY 1)
 SELECT c.node, coalesce(min(p.node), -1) AS parent, CAST(c.level AS INTEGER) AS level FROM lv c LEFT JOIN (SELECT lv.node, lv.level, bth.b FROM lv JOIN bth ON bth.a = lv.node) p ON p.b = c.node AND p.level = c.level - 1 GROUP BY 1, 3""",
)
def gra19(spark, d):
    banned = spark.createDataFrame([(0, 1), (0, 2)], "a long, b long")
    return g.breadth_first(t.edges(spark, d).filter("n > 12").select("a", "b"), 0, banned).withColumn("parent", F.coalesce("parent", F.lit(-1).cast("long")))


@query("GRA20_fixed_offsets", "WITH k AS (SELECT c_nationkey AS sequence, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer) SELECT p.sequence, p.i, q.i AS j FROM k p JOIN k q ON p.sequence = q.sequence AND q.i < 100 AND q.i - p.i IN (5, 10, 15, 20, 25, 30)")
def gra20(spark, d):
    frames = t.table(spark, d, "customer").select(F.col("c_nationkey").alias("sequence"), F.col("c_custkey").alias("frame"))
    return g.fixed_offsets(frames, 100, 30, 5)


# --- clusters and iterations -------------------------------------------------------------------------------------


@query(
    "CLU01_dbscan",
    f"""WITH RECURSIVE {t.POINTS}, near AS (SELECT p.point_id AS a, q.point_id AS b FROM points p JOIN points q ON pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= 2.25), core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 3),
 links AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)), {REACH}, border AS (SELECT a, min(component) AS near FROM near JOIN cc ON b = node GROUP BY 1)
 SELECT point_id, coalesce(component, near, -1) AS cluster FROM points LEFT JOIN cc ON node = point_id LEFT JOIN border ON border.a = point_id""",
)
def clu01(spark, d):
    return spatial.dbscan(t.points(spark, d), 1.5, 3)


@query("CLU04_spectral_split", f"WITH {t.EDGES} SELECT node, node >= 1000 AS side FROM (SELECT DISTINCT unnest([a, b, a + 1000, b + 1000]) AS node FROM edges)")
def clu04(spark, d):
    """Two copies of the graph, held together by one weak edge: the second eigenvector of the normalised Laplacian tells them apart."""
    e = t.edges(spark, d).select("a", "b", "w")
    both = e.unionByName(e.select((F.col("a") + 1000).alias("a"), (F.col("b") + 1000).alias("b"), "w")).unionByName(spark.createDataFrame([(1, 1001, 1e-3)], "a long, b long, w double"))
    found = g.spectral_embedding(both, 2, 20)
    high = found.agg(F.max_by("x1", "node").alias("top"))
    return found.crossJoin(F.broadcast(high)).select("node", (F.col("x1") * F.col("top") > 0).alias("side"))


@query("CLU02_kmeans")
def clu02(spark, d):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = t.descriptors(spark, d).select("vec_id", array_to_vector("v").alias("features"))
    model = KMeans(k=5, seed=42, maxIter=20).fit(v)
    return model.transform(v).groupBy("prediction").agg(F.count("*").alias("n"))


@query("CLU03_largest_region")
def clu03(spark, d):
    px = t.table(spark, d, "lineitem").filter("l_discount < 0.04").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_orderkey") % 40).alias("y")).distinct()
    return g.largest_region(px)


def _smoothed(before: str, after: str) -> str:
    moved = ", ".join(f"sum(q.{k} / (sqrt(d2) + 1e-8)) / sum(1 / (sqrt(d2) + 1e-8)) AS {k}" for k in "xyz")
    return f"""{after}_d AS (SELECT p.point_id AS a, q.point_id AS b, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS d2 FROM {before} p JOIN {before} q ON p.point_id <> q.point_id),
 {after} AS (SELECT a AS point_id, {moved} FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS rank FROM {after}_d) n JOIN {before} q ON n.b = q.point_id WHERE rank <= 7 GROUP BY 1)"""


@query("ITR01_smooth", f"WITH {t.POINTS}, {_smoothed('points', 'once')}, {_smoothed('once', 'twice')} SELECT point_id, {rd('x', 5)} AS x, {rd('y', 5)} AS y, {rd('z', 5)} AS z FROM twice")
def itr01(spark, d):
    return spatial.smooth(t.points(spark, d), 2, 7, 4.0).select("point_id", *[rounded(F.col(k), 5).alias(k) for k in "xyz"])


DENSE = f"{GAUSS}, top AS (SELECT *, exp(greatest(s0, s1, s2)) AS big FROM gauss)"


@query("ITR02_densify", f"WITH {DENSE} SELECT id, 'keep' AS kind, 0 AS copy FROM top WHERE NOT (grad >= 0.0002 AND big > 0.05) UNION ALL SELECT id, 'clone', 0 FROM top WHERE grad >= 0.0002 AND big <= 0.05 UNION ALL SELECT id, 'split', c FROM top, (SELECT unnest([1, 2]) AS c) WHERE grad >= 0.0002 AND big > 0.05")
def itr02(spark, d):
    return sp.densify(gaussians(spark, d), 0.0002, 0.05, 2).select("id", "kind", "copy")


@query("ITR03_refine", f"WITH {DENSE}, k AS (SELECT *, grad * 0.5 * 640 > 0.05 AS hot FROM top) SELECT id, hot AND big > 0.3 AS is_split, hot AND big <= 0.3 AS is_dup, {rd('CASE WHEN hot AND big > 0.3 THEN s0 - ln(1.6) ELSE s0 END')} AS s0 FROM k")
def itr03(spark, d):
    return sp.refine(gaussians(spark, d), 640, 0.05, 0.3).select("id", "is_split", "is_dup", rounded(F.col("s0")).alias("s0"))


@query("ITR04_opacity_reset", f"WITH {GAUSS}, k AS (SELECT id, opacity, least(1 / (1 + exp(-opacity)), 0.01) AS o FROM gauss) SELECT id, {rd('ln(o / (1 - o))', 5)} AS reset, {rd('least(opacity, ln(0.2 / 0.8))', 5)} AS clamped FROM k")
def itr04(spark, d):
    return sp.reset_opacity(gaussians(spark, d)).select("id", rounded(F.col("reset"), 5).alias("reset"), rounded(F.col("clamped"), 5).alias("clamped"))


@query("ITR05_gradient_statistics", "SELECT l_partkey AS id, " + rd("sum(sqrt(l_discount * l_discount + l_tax * l_tax))") + " AS total, count(*) AS n, max(l_quantity) AS radius FROM lineitem GROUP BY 1")
def itr05(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("gx"), F.col("l_tax").alias("gy"), F.col("l_quantity").alias("radius"))
    return sp.gradient_statistics(rows).withColumn("total", rounded(F.col("total")))


# --- relational shells of solvers and detectors ------------------------------------------------------------------


@query("SOL01_calibration_problem", f"WITH {t.EDGES} SELECT a, b, p.s_acctbal > 0 AND q.s_acctbal > 0 AS both_prior FROM edges JOIN supplier p ON a = p.s_suppkey JOIN supplier q ON b = q.s_suppkey WHERE n > 10")
def sol01(spark, d):
    s = lambda k: t.table(spark, d, "supplier").select(F.col("s_suppkey").alias(k), F.col("s_acctbal").alias(f"p{k}"))
    return t.edges(spark, d).filter("n > 10").join(s("a"), "a").join(s("b"), "b").select("a", "b", ((F.col("pa") > 0) & (F.col("pb") > 0)).alias("both_prior"))


@query("SOL02_pose_estimation_slot")
def sol02(spark, d):
    """Matches grouped by pair for a solver; here the slot runs a least-squares translation."""
    m = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("pair"), F.col("l_quantity").alias("ax"), F.col("l_discount").alias("ay"), F.col("l_tax").alias("bx"), F.col("l_linenumber").cast("double").alias("by"))
    return sp.solve_pairs(m)


@query("SOL03_inlier_scores", f"WITH {PAIR}, e AS (SELECT id % 20 AS pair, (ax - bx) * (ax - bx) + (ay - bq) * (ay - bq) AS e FROM pr) SELECT pair, CAST(count_if(e <= 0.5) AS BIGINT) AS n_inliers, {rd('sum(least(e, 0.5))')} AS cost FROM e GROUP BY 1")
def sol03(spark, d):
    e = pairs_of_pixels(spark, d).select((F.col("id") % 20).alias("pair"), c.homography_error([[F.lit(float(i == j)) for j in range(3)] for i in range(3)], [F.col("ax"), F.col("ay")], [F.col("bx"), F.col("bq")]).alias("e"))
    return sp.inlier_scores(e, 0.5).withColumn("cost", rounded(F.col("cost")))


@query("SOL04_irls_weights", f"WITH {t.EDGES}, e AS (SELECT a, b, abs(w / n - 25) AS r FROM edges) SELECT a, b, {rd('25.0 / pow(25.0 + r * r, 2)')} AS geman, {rd('pow(r * r + 1e-6, -0.75)')} AS half FROM e")
def sol04(spark, d):
    return sp.irls_weights(t.edges(spark, d).select("a", "b", F.abs(F.col("w") / F.col("n") - 25).alias("r")), 5.0).select("a", "b", rounded(F.col("geman")).alias("geman"), rounded(F.col("half")).alias("half"))


@query("SOL05_stratified_choice", f"WITH {t.EDGES} SELECT CAST(count_if(a % 3 = 0 AND b % 3 = 0) AS BIGINT) AS n_gravity, count(*) AS n, count_if(a % 3 = 0 AND b % 3 = 0) <= 0.95 * count(*) AS two_steps FROM edges")
def sol05(spark, d):
    return sp.stratified(t.edges(spark, d).withColumn("has_gravity", (F.col("a") % 3 == 0) & (F.col("b") % 3 == 0)))


@query("SOL06_gravity_refinement", f"WITH {t.EDGES}, e AS (SELECT a AS frame, w / n AS x FROM edges UNION ALL SELECT b, w / n FROM edges) SELECT frame, count(*) AS n, avg((abs(x - 25) > 2)::INT) < 0.5 AS accepted FROM e GROUP BY 1 HAVING count(*) >= 7")
def sol06(spark, d):
    e = t.edges(spark, d)
    rows = e.select(F.explode(F.array("a", "b")).alias("frame"), (F.col("w") / F.col("n")).alias("x"))
    return rows.groupBy("frame").agg(F.count("*").alias("n"), (F.avg((F.abs(F.col("x") - 25) > 2).cast("int")) < 0.5).alias("accepted")).filter("n >= 7")


@query("SOL07_positioning_constraints", f"WITH {t.OBSERVATIONS}, k AS (SELECT track_id FROM observations GROUP BY 1 HAVING count(*) >= 3) SELECT track_id, image_id FROM observations WHERE track_id IN (SELECT track_id FROM k) AND image_id % 4 <> 0")
def sol07(spark, d):
    return sp.constraints(t.observations(spark, d), F.col("image_id") % 4 != 0, 3).select("track_id", "image_id")


@query("SOL08_bundle_schedule", f"WITH {t.OBSERVATIONS}, e AS (SELECT track_id, px / 10 + py AS e FROM observations) SELECT f AS factor, CAST(count_if(e < f) AS BIGINT) AS n FROM e, (SELECT unnest([1, 2, 3]) AS f) GROUP BY 1")
def sol08(spark, d):
    e = t.observations(spark, d).select("track_id", (F.col("px") / 10 + F.col("py")).alias("e"))
    return sp.tightening(e, (3, 2, 1))


@query("SOL09_retriangulation_inputs", "SELECT s_suppkey AS image_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_tax > 0.079)")
def sol09(spark, d):
    cached = t.table(spark, d, "lineitem").filter("l_quantity > 49 AND l_tax > 0.079").select(F.col("l_suppkey").alias("image_id"))
    return t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id")).join(cached, "image_id", "left_anti")


@query("SOL10_undistort", f"WITH {t.VIEWS}, k AS (SELECT point_id, image_id, (u - 320) / 100 AS x, (v - 320) / 100 AS y FROM views) SELECT point_id, image_id, {rd('x / sqrt(x*x + y*y + 1)')} AS rx, {rd('y / sqrt(x*x + y*y + 1)')} AS ry, {rd('1 / sqrt(x*x + y*y + 1)')} AS rz FROM k")
def sol10(spark, d):
    ray = sp.unit_ray(F.col("u"), F.col("v"), (F.lit(100.0), F.lit(100.0), F.lit(320.0), F.lit(320.0)))
    return t.views(spark, d).select("point_id", "image_id", *[rounded(x).alias(n) for x, n in zip(ray, ("rx", "ry", "rz"), strict=True)])


@query("SOL11_correspondences", f"WITH {t.OBSERVATIONS} SELECT p.track_id, p.image_id AS i, q.image_id AS j FROM observations p JOIN observations q ON p.track_id = q.track_id AND q.image_id = p.image_id + 1")
def sol11(spark, d):
    o = t.observations(spark, d).select("track_id", F.col("image_id").alias("i"))
    return o.join(o.select("track_id", F.col("i").alias("j"), (F.col("i") - 1).alias("i")), ["track_id", "i"]).select("track_id", "i", "j")


@query("SOL12_training_step", f"WITH {t.POINTS} SELECT point_id AS step, {rd('exp((1 - least(point_id / 2000.0, 1)) * ln(0.00016) + least(point_id / 2000.0, 1) * ln(0.0000016)) * 1e6', 4)} AS micro, point_id % 100 = 0 AND point_id > 500 AS densifies FROM points")
def sol12(spark, d):
    s = F.col("point_id")
    return t.points(spark, d).select(s.alias("step"), rounded(c.log_linear(s, 0.00016, 0.0000016, 2000) * 1e6, 4).alias("micro"), ((s % 100 == 0) & (s > 500)).alias("densifies"))


@query("NN01_pair_cache", f"WITH {t.EDGES} SELECT a, b, md5(CAST(a AS VARCHAR) || '_' || CAST(b AS VARCHAR)) AS key FROM edges")
def nn01(spark, d):
    return t.edges(spark, d).select("a", "b", F.md5(F.concat_ws("_", F.col("a").cast("string"), F.col("b").cast("string"))).alias("key"))


@query("NN02_detections", "WITH s AS (SELECT user_id % 20 AS image, event_id AS q, event_type AS token, 1 / (1 + exp(-(value - 100) / 20)) AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY p DESC, q) AS rn FROM s WHERE p > 0.5) SELECT image, q, token FROM k WHERE rn <= 30")
def nn02(spark, d):
    from orrery.operators.windows import top_per_key

    s = t.table(spark, d, "events").select((F.col("user_id") % 20).alias("image"), F.col("event_id").alias("q"), F.col("event_type").alias("token"), c.sigmoid((F.col("value") - 100) / 20).alias("p"))
    return top_per_key(s.filter("p > 0.5"), "image", [F.desc("p"), "q"], 30).select("image", "q", "token")


@query("NN04_retrieval", f"WITH {t.DESCRIPTORS}, {SIM} SELECT i, arg_max(j, (s, -j)) AS best FROM sim WHERE i <> j GROUP BY 1")
def nn04(spark, d):
    rows = t.descriptors(spark, d).select(F.col("vec_id").alias("id"), "v")
    return joins.search(rows.filter("id % 100 = 0"), rows, 1).select("i", F.col("j").alias("best"))


@query("NN05_info_nce", f"WITH {t.DESCRIPTORS}, {SIM}, k AS (SELECT i, ln(sum(exp(s / 20))) AS total, max(CASE WHEN i = j THEN s / 20 END) AS own FROM sim GROUP BY 1) SELECT {rd('avg(total - own)', 5)} AS loss FROM k")
def nn05(spark, d):
    rows = t.descriptors(spark, d).select(F.col("vec_id").alias("id"), "v")
    return sp.info_nce(rows.filter("id % 100 = 0"), rows, 20.0).select(rounded(F.col("loss"), 5).alias("loss"))
