"""Queries of solvers: relative poses, triangulation, rotations, bundles and focal lengths (SOL)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators import bundle, focals, rotations, triangulation, two_view
from orrery.operators.state import materialize
from orrery.plans import tables as t
from orrery.plans.registry import query, rd, rounded

LIMIT = 1e-3

#: Matches of neighbouring cameras in camera coordinates; four of ten lead to a wrong place.
MATCHES = f"""{t.VIEWS}, mt AS (SELECT p.image_id * 100 + q.image_id AS pair, (p.u - 320) / 100 AS x1, (p.v - 320) / 100 AS y1,
 CASE WHEN (p.point_id * 31 + p.image_id) % 10 < 4 THEN ((p.point_id * 7919 + p.image_id * 104729) % 2001) / 1000.0::DOUBLE - 1 ELSE (q.u - 320) / 100 END AS x2,
 CASE WHEN (p.point_id * 31 + p.image_id) % 10 < 4 THEN ((p.point_id * 6101 + p.image_id * 15485) % 1999) / 1000.0::DOUBLE - 1 ELSE (q.v - 320) / 100 END AS y2,
 b.tx - a.tx AS tx, b.tz - a.tz AS tz FROM views p JOIN views q ON p.point_id = q.point_id AND q.image_id - p.image_id IN (1, 2) JOIN cameras a ON a.image_id = p.image_id JOIN cameras b ON b.image_id = q.image_id)"""


def matches(spark, d):
    v = t.views(spark, d)
    p = v.select("point_id", F.col("image_id").alias("a"), F.explode(F.array(F.col("image_id") + 1, F.col("image_id") + 2)).alias("b"), ((F.col("u") - 320) / 100).alias("x1"), ((F.col("v") - 320) / 100).alias("y1"))
    q = v.select("point_id", F.col("image_id").alias("b"), ((F.col("u") - 320) / 100).alias("x2"), ((F.col("v") - 320) / 100).alias("y2"))
    k, wrong = F.col("point_id"), (F.col("point_id") * 31 + F.col("a")) % 10 < 4
    x2 = F.when(wrong, (k * 7919 + F.col("a") * 104729) % 2001 / 1000.0 - 1).otherwise(F.col("x2"))
    y2 = F.when(wrong, (k * 6101 + F.col("a") * 15485) % 1999 / 1000.0 - 1).otherwise(F.col("y2"))
    return p.join(q, ["point_id", "b"]).select((F.col("a") * 100 + F.col("b")).alias("pair"), "x1", "y1", x2.alias("x2"), y2.alias("y2"))


@query(
    "SOL02_relative_poses",
    f"""WITH {MATCHES}, e AS (SELECT *, pow(-tz * y1 * x2 + y2 * (tz * x1 - tx) + tx * y1, 2) / (pow(tz * y1, 2) + pow(tz * x1 - tx, 2) + pow(tz * y2, 2) + pow(tz * x2 - tx, 2)) AS err FROM mt)
 SELECT pair, count(*) AS n, CAST(count_if(err < {LIMIT} * {LIMIT}) AS BIGINT) AS n_inliers, 1.0::DOUBLE AS r00, 1.0::DOUBLE AS r11, {rd('any_value(tx / sqrt(tx * tx + tz * tz))', 4)} AS t0, 0.0::DOUBLE AS t1, {rd('any_value(tz / sqrt(tx * tx + tz * tz))', 4)} AS t2 FROM e GROUP BY 1""",
)
def sol02(spark, d):
    """SQL knows the planted poses; the operator finds them."""
    got = two_view.relative_poses(matches(spark, d), LIMIT)
    at = lambda name, k: rounded(F.get(name, F.lit(k)), 4)
    return got.select("pair", "n", "n_inliers", at("rot", 0).alias("r00"), at("rot", 4).alias("r11"), *[at("t", k).alias(f"t{k}") for k in range(3)])


SUMS = f"""{t.VIEWS}, ob AS (SELECT point_id AS track_id, image_id, (round(u) - 320) / 100 AS x, (round(v) - 320) / 100 AS y, tx, ty, tz FROM views JOIN (SELECT image_id, tx, ty, tz FROM cameras) USING (image_id)),
 rw AS (SELECT track_id, 1.0 AS a0, 0.0 AS a1, -x AS a2, tx - x * tz AS a3, 0.0 AS b0, 1.0 AS b1, -y AS b2, ty - y * tz AS b3 FROM ob),
 sm AS (SELECT track_id, count(*) AS n, {', '.join(f'sum(a{i} * a{j} + b{i} * b{j}) AS m{i}{j}' for i, j in triangulation.PLACES)} FROM rw GROUP BY 1)"""


def sightings(spark, d, whole_pixels: bool):
    """Views of points with the cameras' poses."""
    at = t.cameras(spark, d).select("image_id", F.array(*[F.lit(float(x)) if isinstance(x, int) else F.col(x) for x in (1, 0, 0, "tx", 0, 1, 0, "ty", 0, 0, 1, "tz")]).alias("pose"))
    px = (lambda k: F.round(F.col(k))) if whole_pixels else F.col
    v = t.views(spark, d).select(F.col("point_id").alias("track_id"), "image_id", ((px("u") - 320) / 100).alias("x"), ((px("v") - 320) / 100).alias("y"))
    return v.join(at, "image_id")


def _det(c: list[list[str]]) -> str:
    return f"({c[0][0]} * ({c[1][1]} * {c[2][2]} - {c[1][2]} * {c[2][1]}) - {c[0][1]} * ({c[1][0]} * {c[2][2]} - {c[1][2]} * {c[2][0]}) + {c[0][2]} * ({c[1][0]} * {c[2][1]} - {c[1][1]} * {c[2][0]}))"


M3 = [[f"m{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]


@query("SOL11_normal_sums", f"WITH {SUMS} SELECT track_id, n, {', '.join(rd(f'm{i}{j}', 6) + f' AS m{i}{j}' for i, j in triangulation.PLACES)} FROM sm")
def sol11_sums(spark, d):
    """Ten sums of each track, from two halves of the cameras that are merged."""
    rows = sightings(spark, d, True)
    both = triangulation.merged(*[triangulation.normal_sums(rows.filter(F.col("image_id") % 2 == k)) for k in (0, 1)])
    return both.select("track_id", "n", *[rounded(F.get("sums", F.lit(k)), 6).alias(f"m{i}{j}") for k, (i, j) in enumerate(triangulation.PLACES)])


@query(
    "SOL11_triangulation",
    f"WITH {SUMS} SELECT track_id, n, " + ", ".join(rd(f"CASE WHEN abs({_det(M3)}) > 1e-12 THEN {_det([[f'(-m{i}3)' if j == k else M3[i][j] for j in range(3)] for i in range(3)])} / {_det(M3)} END", 4) + f" AS {x}" for k, x in enumerate("xyz")) + " FROM sm WHERE n >= 3",
)
def sol11_points(spark, d):
    """Points from pixels that are rounded to whole ones."""
    return triangulation.triangulate(sightings(spark, d, True), 3).select("track_id", "n", *[rounded(F.col(k), 4).alias(k) for k in "xyz"])


@query("SOL11_eigenvectors", f"WITH {t.VIEWS}, k AS (SELECT point_id, count(*) AS n FROM views GROUP BY 1 HAVING count(*) >= 3) SELECT point_id AS track_id, n, {rd('x', 3)} AS x, {rd('y', 3)} AS y, {rd('z', 3)} AS z FROM k JOIN points USING (point_id)")
def sol11_eigen(spark, d):
    """From exact pixels the planted points come back."""
    return triangulation.triangulate(sightings(spark, d, False), 3, homogeneous=True).select("track_id", "n", *[rounded(F.col(k), 3).alias(k) for k in "xyz"])


def _planted(k: str):
    """A node's planted rotation: about z by k / 10, then about x by k / 7."""
    x = F.col(k)
    cz, sz, cx, sx, zero, one = F.cos(x / 10), F.sin(x / 10), F.cos(x / 7), F.sin(x / 7), F.lit(0.0), F.lit(1.0)
    about_x, about_z = [[one, zero, zero], [zero, cx, -sx], [zero, sx, cx]], [[cz, -sz, zero], [sz, cz, zero], [zero, zero, one]]
    return rotations.product(about_x, about_z)


def relative_rotations(spark, d):
    """Edges with the planted rotations' quotient; every fifth has a wrong one."""
    e = t.edges(spark, d).select("a", "b", F.col("w").cast("double").alias("w")).withColumns({"pa": _planted("a"), "pb": _planted("b")})
    e = e.select("a", "b", "w", rotations.product(rotations.matrix("pb"), [[F.get("pa", F.lit(3 * j + i)) for j in range(3)] for i in range(3)]).alias("rot"))
    e = e.withColumn("turn", F.array(*sum(rotations.turned_by([0.3 + F.col("a") % 7 / 5, F.lit(-0.4), 0.2 + F.col("b") % 5 / 4]), [])))
    bad = (F.col("a") * 31 + F.col("b") * 17) % 5 == 0
    return e.withColumn("rot", F.when(bad, rotations.product(rotations.matrix("turn"), rotations.matrix("rot"))).otherwise(F.col("rot"))).drop("turn", "pa", "pb")


@query(
    "SOL04_rotation_averaging",
    f"WITH {t.EDGES}, e AS (SELECT a AS node, (a * 31 + b * 17) % 5 = 0 AS bad FROM edges UNION ALL SELECT b, (a * 31 + b * 17) % 5 = 0 FROM edges) SELECT node, count(*) AS n, CAST(count_if(bad) AS BIGINT) AS n_bad, 0.0::DOUBLE AS tenths_off FROM e GROUP BY 1",
)
def sol04_average(spark, d):
    """Per node its edges, those more than ten degrees off, and its distance from the planted rotation in whole tenths of a degree. SQL knows which edges were planted wrong."""
    edges = relative_rotations(spark, d)
    found = rotations.average(edges, 0)
    judged = rotations.residuals(edges, found).select(F.explode(F.array("a", "b")).alias("node"), "angle")
    counts = judged.groupBy("node").agg(F.count("*").alias("n"), F.count_if(F.col("angle") > 0.1745).alias("n_bad"))
    m = rotations.matrix("m")
    off = found.withColumn("planted", _planted("node")).select("node", rotations.product(rotations.matrix("rot"), [[F.get("planted", F.lit(3 * j + i)) for j in range(3)] for i in range(3)]).alias("m"))
    degrees = F.degrees(F.acos(c.clamp((m[0][0] + m[1][1] + m[2][2] - 1) / 2, -1.0, 1.0)))
    return counts.join(off, "node").select("node", "n", "n_bad", F.floor(degrees * 10).cast("double").alias("tenths_off"))


@query("SOL08_bundle_adjustment", f"WITH {t.VIEWS}, k AS (SELECT point_id FROM views GROUP BY 1 HAVING count(*) >= 3) SELECT count(*) AS n, count(DISTINCT image_id) AS cameras, count(DISTINCT point_id) AS points, 0.0::DOUBLE AS thousandths FROM views JOIN k USING (point_id)")
def sol08_bundle(spark, d):
    """Exact views of tracks seen thrice, and cameras and points moved away: the root of the mean squared residual falls below a thousandth."""
    v = t.views(spark, d).select(F.col("image_id").alias("camera"), F.col("point_id").alias("track"), ((F.col("u") - 320) / 100).alias("x"), ((F.col("v") - 320) / 100).alias("y"))
    seen = materialize(v.withColumn("n", F.count("*").over(Window.partitionBy("track"))).filter("n >= 3").drop("n"), "views")
    off = lambda k, m: ((F.col(k) * m) % 11 - 5) / 250.0
    points = t.points(spark, d).groupBy(F.col("point_id").alias("track")).agg(*[F.first(k).alias(k) for k in "xyz"]).select("track", F.array(*[F.col(k) + off("track", m) for k, m in zip("xyz", (3, 5, 7), strict=True)]).alias("p"))
    eye = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    cameras = t.cameras(spark, d).select(F.col("image_id").alias("camera"), eye.alias("rot"), F.array(*[F.col(k) + off("image_id", m) for k, m in zip(("tx", "ty", "tz"), (2, 4, 6), strict=True)]).alias("t"))
    cameras, points, costs = bundle.adjust(seen, cameras, points, rounds=3, huber=1.0)
    # one after the other: distinct counts of both at once would move every row twice
    found = seen.groupBy("camera").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("cameras")).crossJoin(seen.groupBy("track").count().agg(F.count("*").alias("points")))
    return found.withColumn("thousandths", F.floor(F.sqrt(2 * F.lit(costs[-1]) / F.col("n")) * 1000).cast("double"))


def _transposed(name: str):
    return [[F.get(name, F.lit(3 * j + i)) for j in range(3)] for i in range(3)]


def fundamental_matrices(spark, d):
    """Of the edges, for planted rotations, centres and focal lengths; every tenth is wrong."""
    centre = lambda k: [F.col(k) % 7 - 3.0, F.col(k) % 5 - 2.0, F.col(k) % 11 / 2.0]
    focal = lambda k: 500.0 + F.col(k) * 37 % 300
    e = t.edges(spark, d).select("a", "b").withColumns({"pa": _planted("a"), "pb": _planted("b")})
    between = [x - y for x, y in zip(centre("a"), centre("b"), strict=True)]
    e = e.select("a", "b", rotations.product(rotations.matrix("pb"), _transposed("pa")).alias("rot"), F.array(*c.matvec(rotations.matrix("pb"), between)).alias("t")).filter(F.exists("t", lambda x: F.abs(x) > 1e-9))
    x, y, z, zero = *[F.get("t", F.lit(k)) for k in range(3)], F.lit(0.0)
    e = e.select("a", "b", rotations.product([[zero, -z, y], [z, zero, -x], [-y, x, zero]], rotations.matrix("rot")).alias("e"))
    inverse = lambda k: [1 / focal(k), 1 / focal(k), F.lit(1.0)]
    right = F.array(*[inverse("b")[i] * F.get("e", F.lit(3 * i + j)) * inverse("a")[j] for i in range(3) for j in range(3)])
    wrong = F.array(*[F.get("f", F.lit(3 * j + i)) * s for i, row in enumerate(((1.0, 1.3, 0.7), (1.0, 1.0, 1.0), (0.8, 1.1, 1.0))) for j, s in enumerate(row)])
    return e.select("a", "b", right.alias("f")).withColumn("f", F.when((F.col("a") * 31 + F.col("b") * 17) % 10 == 0, wrong).otherwise(F.col("f")))


@query(
    "SOL01_focal_calibration",
    f"WITH {t.EDGES}, e AS (SELECT a, b, (a * 31 + b * 17) % 10 = 0 AS bad FROM edges WHERE a % 7 <> b % 7 OR a % 5 <> b % 5 OR a % 11 <> b % 11), k AS (SELECT a AS camera, bad FROM e UNION ALL SELECT b, bad FROM e) SELECT camera, count(*) AS n, CAST(count_if(bad) AS BIGINT) AS n_bad, 0.0::DOUBLE AS thousandths_off, true AS accepted FROM k GROUP BY 1",
)
def sol01_focals(spark, d):
    """Per camera its pairs, those whose residual is too large (FLT11), its focal length's distance from the planted one in whole thousandths, and whether it is near enough to the prior (FLT10). SQL knows what was planted."""
    pairs = materialize(fundamental_matrices(spark, d), "pairs")  # read several times
    k = F.col("camera")
    cameras = pairs.select(F.explode(F.array("a", "b")).alias("camera")).distinct().select("camera", ((500.0 + k * 37 % 300) * F.when(k % 3 == 0, 1.2).when(k % 3 == 1, 0.85).otherwise(1.0)).alias("focal"))
    found = focals.calibrate(pairs, cameras)
    judged = focals.pulls(pairs, found).groupBy("camera").agg(F.count("*").alias("n"), F.count_if(F.col("error") > 1e-5).alias("n_bad"))
    off = F.floor(F.abs(F.col("focal") / (500.0 + k * 37 % 300) - 1) * 1000).cast("double")
    return judged.join(found, "camera").select("camera", "n", "n_bad", off.alias("thousandths_off"), (F.col("focal") / F.col("prior")).between(0.1, 10.0).alias("accepted"))
