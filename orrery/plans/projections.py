"""Queries on scalar functions (PRJ, STR, JSN, ARR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.functions import fixed
from orrery.plans import tables as t
from orrery.plans.registry import drawn, query, rd, rounded

Q = "q AS (SELECT p_partkey AS id, (p_partkey % 7 + 1) / 8.0::DOUBLE AS w, (p_partkey % 5 - 2) / 4.0::DOUBLE AS x, (p_partkey % 11 - 5) / 6.0::DOUBLE AS y, (p_partkey % 3 - 1) / 2.0::DOUBLE AS z FROM part)"
QN = "n AS (SELECT id, w / l AS w, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(w*w + x*x + y*y + z*z) AS l FROM q))"


def quaternions(spark, d):
    k = F.col("p_partkey")
    return t.table(spark, d, "part").select(k.alias("id"), ((k % 7 + 1) / 8.0).alias("w"), ((k % 5 - 2) / 4.0).alias("x"), ((k % 11 - 5) / 6.0).alias("y"), ((k % 3 - 1) / 2.0).alias("z"))


def _rot_sql(source: str) -> str:
    cells = ["1 - 2*(y*y + z*z)", "2*(x*y - w*z)", "2*(x*z + w*y)", "2*(x*y + w*z)", "1 - 2*(x*x + z*z)", "2*(y*z - w*x)", "2*(x*z - w*y)", "2*(y*z + w*x)", "1 - 2*(x*x + y*y)"]
    return "SELECT id, " + ", ".join(f"{rd(x)} AS r{k // 3}{k % 3}" for k, x in enumerate(cells)) + f" FROM {source}"


def _rot(df, normalise):
    m = c.rotation([F.col(k) for k in "wxyz"], normalise)
    return df.select("id", *[rounded(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)])


@query("PRJ01_quaternion_to_rotation", f"WITH {Q} {_rot_sql('q')}")
def prj01(spark, d):
    return _rot(quaternions(spark, d), False)


@query("PRJ01_quaternion_to_rotation_unit", f"WITH {Q}, {QN} {_rot_sql('n')}")
def prj01_unit(spark, d):
    return _rot(quaternions(spark, d), True)


@query("PRJ02_rotation_to_quaternion", f"WITH {Q}, {QN} SELECT id, {rd('s*w', 5)} AS w, {rd('s*x', 5)} AS x, {rd('s*y', 5)} AS y, {rd('s*z', 5)} AS z FROM (SELECT *, CASE WHEN w < 0 THEN -1.0 ELSE 1.0 END AS s FROM n)")
def prj02(spark, d):
    from orrery.functions.arrays import quaternion_of_rotation

    m = c.rotation([F.col(k) for k in "wxyz"], True)
    q = quaternion_of_rotation(F.array(*[m[i][j] for i in range(3) for j in range(3)]))
    return quaternions(spark, d).select("id", q.alias("q")).select("id", *[rounded(F.element_at("q", k + 1), 5).alias(n) for k, n in enumerate("wxyz")])


@query("PRJ03_pinhole_projection", f"WITH {t.VIEWS} SELECT point_id, image_id, {rd('u')} AS u, {rd('v')} AS v, {rd('depth')} AS depth FROM views")
def prj03(spark, d):
    return t.views(spark, d).select("point_id", "image_id", *[rounded(F.col(x)).alias(x) for x in ("u", "v", "depth")])


@query("PRJ04_visibility", f"WITH {t.VIEWS} SELECT image_id, count(*) AS n FROM views GROUP BY image_id")
def prj04(spark, d):
    return t.views(spark, d).groupBy("image_id").agg(F.count("*").alias("n"))


HSV = """h0 AS (SELECT point_id, r / 255.0::DOUBLE AS x, g / 255.0::DOUBLE AS y, b / 255.0::DOUBLE AS z FROM points),
 h1 AS (SELECT *, greatest(x, y, z) AS top, greatest(x, y, z) - least(x, y, z) + 1e-8 AS delta FROM h0),
 h2 AS (SELECT *, CASE WHEN top = z THEN (x - y) / delta + 4 WHEN top = y THEN (z - x) / delta + 2 ELSE ((((y - z) / delta) % 6) + 6) % 6 END / 6 AS hue0,
  CASE WHEN top > 0 THEN delta / (top + 1e-8) ELSE 0.0 END AS s FROM h1),
 hsv AS (SELECT point_id, hue0, CASE WHEN delta > 1e-8 THEN hue0 ELSE 0.0 END AS h, s, top AS v FROM h2)"""


@query("PRJ05_rgb_to_hsv", f"WITH {t.POINTS}, {HSV} SELECT point_id, {rd('h')} AS h, {rd('hue0')} AS h_grey, {rd('s')} AS s, {rd('v')} AS v FROM hsv")
def prj05(spark, d):
    rgb = [F.col(x) for x in "rgb"]
    h, s, v = c.hsv(*rgb)
    return t.points(spark, d).select("point_id", rounded(h).alias("h"), rounded(c.hsv(*rgb, False)[0]).alias("h_grey"), rounded(s).alias("s"), rounded(v).alias("v"))


@query(
    "PRJ06_hsv_to_rgb",
    """WITH a AS (SELECT p_partkey AS id, (p_partkey % 61) / 64.0::DOUBLE AS h, (p_partkey % 9) / 8.0::DOUBLE AS s, (p_partkey % 17) / 16.0::DOUBLE AS v FROM part),
 b AS (SELECT *, CAST(floor(h * 6) AS BIGINT) AS i, h * 6 - floor(h * 6) AS f FROM a),
 e AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS u, i % 6 AS k FROM b)
 SELECT id, CAST(trunc(255 * CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN u ELSE v END) AS INTEGER) AS r,
 CAST(trunc(255 * CASE k WHEN 0 THEN u WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END) AS INTEGER) AS g,
 CAST(trunc(255 * CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN u WHEN 3 THEN v WHEN 4 THEN v ELSE q END) AS INTEGER) AS b FROM e""",
)
def prj06(spark, d):
    k = F.col("p_partkey")
    r, g, b = c.rgb_of_hsv((k % 61) / 64.0, (k % 9) / 8.0, (k % 17) / 16.0)
    return t.table(spark, d, "part").select(k.alias("id"), r.alias("r"), g.alias("g"), b.alias("b"))


LUM = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)"


def _byte(x: str) -> str:
    return f"CAST(trunc(least(greatest({x}, 0.0::DOUBLE), 255.0::DOUBLE)) AS INTEGER)"


def _channels(values) -> str:
    return ", ".join(f"{v} AS {n}" for v, n in zip(values, ("r2", "g2", "b2"), strict=True))


def _rgb_query(name, sql_values, make):
    @query(name, f"WITH {t.POINTS} SELECT point_id, {_channels(sql_values)} FROM points")
    def run(spark, d):
        out = make([F.col(x) for x in "rgb"])
        return t.points(spark, d).select("point_id", *[x.alias(n) for x, n in zip(out, ("r2", "g2", "b2"), strict=True)])


@query("PRJ07_luminance", f"WITH {t.POINTS} SELECT point_id, {rd(LUM)} AS lum FROM points")
def prj07(spark, d):
    return t.points(spark, d).select("point_id", rounded(c.luminance(*[F.col(x) for x in "rgb"])).alias("lum"))


_rgb_query("PRJ08_recolour", [_byte(f"{x}.0::DOUBLE * ({LUM} / 255.0::DOUBLE) * 0.85::DOUBLE + {n} * 0.15::DOUBLE") for x, n in ((220, "r"), (30, "g"), (30, "b"))], lambda rgb: c.recolour(rgb, (220, 30, 30)))
_rgb_query("PRJ09_tint", [_byte(f"{n} * (1 - 0.45::DOUBLE) + {x}.0::DOUBLE * 0.45::DOUBLE") for x, n in ((212, "r"), (175, "g"), (55, "b"))], lambda rgb: c.tint(rgb, (212, 175, 55), 0.45))
_rgb_query("PRJ09_desaturate", [_byte(LUM)] * 3, c.desaturate)
_rgb_query("PRJ09_brightness", [_byte(f"{n} * 1.3::DOUBLE") for n in "rgb"], lambda rgb: c.brightness(rgb, 1.3))
_rgb_query(
    "PRJ10_metallic",
    [
        _byte(
            f"(CASE WHEN {LUM}/255.0::DOUBLE > 0.60::DOUBLE THEN {x}.0::DOUBLE * ({LUM}/255.0::DOUBLE) * (1 - 0.20::DOUBLE * (({LUM}/255.0::DOUBLE - 0.60::DOUBLE) / 0.40::DOUBLE)) + {s}.0::DOUBLE * 0.20::DOUBLE * (({LUM}/255.0::DOUBLE - 0.60::DOUBLE) / 0.40::DOUBLE)"
            f" ELSE {x}.0::DOUBLE * ({LUM}/255.0::DOUBLE) END) * 0.85::DOUBLE + {n} * 0.15::DOUBLE"
        )
        for x, s, n in ((212, 255, "r"), (175, 210, "g"), (55, 40, "b"))
    ],
    lambda rgb: c.metallic(rgb, (212, 175, 55), (255, 210, 40)),
)


@query("PRJ11_metallic_by_brightest", f"WITH {t.POINTS}, l AS (SELECT *, {LUM} AS lum FROM points), m AS (SELECT max(lum) AS top FROM l) SELECT point_id, " + ", ".join(f"{_byte(f'{n} * (1 - 0.4::DOUBLE * (lum / (top + 1e-8))) + {s}.0::DOUBLE * 0.4::DOUBLE * (lum / (top + 1e-8))')} AS {n}2" for s, n in ((255, "r"), (210, "g"), (40, "b"))) + " FROM l CROSS JOIN m")
def prj11(spark, d):
    p = t.points(spark, d).withColumn("lum", c.luminance(*[F.col(x) for x in "rgb"]))
    top = p.agg(F.max("lum").alias("top"))
    n = F.col("lum") / (F.col("top") + F.lit(1e-8))
    return p.crossJoin(F.broadcast(top)).select("point_id", *[c.byte(F.col(x) * (1 - 0.4 * n) + F.lit(float(s)) * 0.4 * n).alias(f"{x}2") for s, x in ((255, "r"), (210, "g"), (40, "b"))])


def _textured() -> str:
    whole, total, case = sum(w for w, _ in fixed.TEXTURE_PALETTES["wood"]), 0.0, "CASE"
    for weight, _ in fixed.TEXTURE_PALETTES["wood"][:-1]:
        total += weight / whole
        case += f" WHEN {drawn('point_id', 'wood')} < {total!r} THEN {fixed.TEXTURE_PALETTES['wood'].index((weight, _))}"
    place = f"{case} ELSE {len(fixed.TEXTURE_PALETTES['wood']) - 1} END"
    out = []
    for k, ch in enumerate("rgb"):
        colours = "[" + ", ".join(str(float(colour[k])) for _, colour in fixed.TEXTURE_PALETTES["wood"]) + "]"
        out.append(f"CAST(floor(least(greatest({colours}[place + 1]::DOUBLE + 0.12::DOUBLE * 255 * sqrt(-2 * ln(greatest({drawn('point_id', ch + '1')}, 1e-12))) * cos(2 * pi() * {drawn('point_id', ch + '2')}), 0), 255)) AS INTEGER) AS {ch}")
    return f"WITH {t.POINTS}, k AS (SELECT point_id, {place} AS place FROM points) SELECT point_id, {', '.join(out)} FROM k"


@query("PRJ12_texture_palette", _textured())
def prj12(spark, d):
    """Palette colours drawn with their weights, with normal noise."""
    r, g, b = c.texture_colour(F.col("point_id"), "wood", noise=0.12)
    return t.points(spark, d).select("point_id", r.alias("r"), g.alias("g"), b.alias("b"))


CENTRE = "centre AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points)"


@query(
    "PRJ13_geometry_about_centroid",
    f"WITH {t.POINTS}, {CENTRE} SELECT point_id, {rd('mx + (x - mx) * 1.5', 5)} AS ux, {rd('my + (y - my) * 1.4', 5)} AS ay, {rd('mx + ((x - mx) * cos(radians(90.0)) + (z - mz) * sin(radians(90.0)))', 5)} AS rx, {rd('mz + (-(x - mx) * sin(radians(90.0)) + (z - mz) * cos(radians(90.0)))', 5)} AS rz, {rd('y + 0.2', 5)} AS ty FROM points CROSS JOIN centre",
)
def prj13(spark, d):
    p = t.points(spark, d)
    centre = p.agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
    x, y, z, mx, my, mz = (F.col(n) for n in ("x", "y", "z", "mx", "my", "mz"))
    co, si = F.cos(F.radians(F.lit(90.0))), F.sin(F.radians(F.lit(90.0)))
    values = {"ux": mx + (x - mx) * 1.5, "ay": my + (y - my) * 1.4, "rx": mx + ((x - mx) * co + (z - mz) * si), "rz": mz + (-(x - mx) * si + (z - mz) * co), "ty": y + 0.2}
    return p.crossJoin(F.broadcast(centre)).select("point_id", *[rounded(v, 5).alias(k) for k, v in values.items()])


@query("PRJ14_sh_dc", f"WITH {t.POINTS} SELECT point_id, {rd('(r / 255.0::DOUBLE - 0.5) / 0.28209479177387814')} AS dc, {rd('(r / 255.0::DOUBLE - 0.5) / 0.28209479177387814 * 0.28209479177387814 + 0.5')} AS back FROM points")
def prj14(spark, d):
    dc = c.sh_of_rgb(F.col("r") / 255.0)
    return t.points(spark, d).select("point_id", rounded(dc).alias("dc"), rounded(c.rgb_of_sh(dc)).alias("back"))


@query(
    "PRJ15_sh_evaluation",
    f"WITH {t.POINTS}, u AS (SELECT point_id, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM points)) SELECT point_id, "
    + rd("0.28209479177387814 + 0.4886025119029199 * (-0.3*y + 0.2*z - 0.1*x) + 0.5*1.0925484305920792*x*y + 0.25*0.31539156525252005*(2*z*z - x*x - y*y) + 0.125*0.3731763325901154*z*(2*z*z - 3*x*x - 3*y*y) + 0.0625*0.10578554691520431*(z*z*(35*z*z - 30) + 3)")
    + " AS value FROM u",
)
def prj15(spark, d):
    p = t.points(spark, d).withColumn("l", c.norm([F.col(a) for a in "xyz"]))
    basis = c.sh_basis(4, *[F.col(a) / F.col("l") for a in "xyz"])
    weights = {0: 1.0, 1: 0.3, 2: 0.2, 3: 0.1, 4: 0.5, 6: 0.25, 12: 0.125, 20: 0.0625}
    return p.select("point_id", rounded(sum((basis[k] * w for k, w in weights.items()), F.lit(0.0))).alias("value"))


_M = [["(1 - 2*(y*y + z*z))", "(2*(x*y - w*z))", "(2*(x*z + w*y))"], ["(2*(x*y + w*z))", "(1 - 2*(x*x + z*z))", "(2*(y*z - w*x))"], ["(2*(x*z - w*y))", "(2*(y*z + w*x))", "(1 - 2*(x*x + y*y))"]]
_S = ["0.5", "1.0", "2.0"]


@query("PRJ16_covariance", f"WITH {Q}, {QN} SELECT id, " + ", ".join(f"{rd(' + '.join(f'{_M[i][k]}*{_S[k]}*{_M[j][k]}*{_S[k]}' for k in range(3)), 5)} AS s{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM n")
def prj16(spark, d):
    six = c.covariance([F.lit(0.5), F.lit(1.0), F.lit(2.0)], [F.col(k) for k in "wxyz"])
    return quaternions(spark, d).select("id", *[rounded(v, 5).alias(n) for v, n in zip(six, ("s00", "s01", "s02", "s11", "s12", "s22"), strict=True)])


@query("PRJ17_activations", f"WITH {t.POINTS}, a AS (SELECT point_id, x / 10 AS v, (r + 1) / 258.0::DOUBLE AS p FROM points) SELECT point_id, {rd('exp(v)')} AS e, {rd('1 / (1 + exp(-v))')} AS s, {rd('ln(p / (1 - p))')} AS l FROM a")
def prj17(spark, d):
    v, p = F.col("x") / 10, (F.col("r") + 1) / 258.0
    return t.points(spark, d).select("point_id", rounded(F.exp(v)).alias("e"), rounded(c.sigmoid(v)).alias("s"), rounded(c.logit(p)).alias("l"))


@query("PRJ18_fov_focal", f"WITH a AS (SELECT p_partkey AS id, 300.0::DOUBLE + p_size AS f FROM part) SELECT id, {rd('2 * atan(640 / (2 * f))')} AS fov, {rd('640 / (2 * tan((2 * atan(640 / (2 * f))) / 2))', 4)} AS back FROM a")
def prj18(spark, d):
    f = F.lit(300.0) + F.col("p_size")
    fov = c.fov_of_focal(f, F.lit(640.0))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), rounded(fov).alias("fov"), rounded(c.focal_of_fov(fov, F.lit(640.0)), 4).alias("back"))


@query(
    "PRJ19_log_linear_rate",
    f"WITH a AS (SELECT p_partkey AS step, least(greatest(p_partkey / 3000.0::DOUBLE, 0), 1) AS t, least(greatest(p_partkey / 500.0::DOUBLE, 0), 1) AS w FROM part) SELECT step, {rd('(0.01 + 0.99 * sin(0.5 * 3.141592653589793 * w)) * exp((1 - t) * ln(0.00016) + t * ln(0.0000016)) * 1e6', 4)} AS micro FROM a",
)
def prj19(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("step"), rounded(c.log_linear(F.col("p_partkey"), 0.00016, 0.0000016, 3000, 500, 0.01) * 1e6, 4).alias("micro"))


@query("PRJ20_schedules", f"WITH {t.POINTS}, a AS (SELECT point_id, r / 255.0::DOUBLE AS t, x AS v FROM points) SELECT point_id, {rd('0.1 + (0.01 - 0.1) * t')} AS lin, {rd('0.01 + (0.1 - 0.01) * (1 + cos(t * 3.141592653589793)) / 2')} AS cosine, {rd('sign(v) * ln(1 + abs(v))')} AS slog, {rd('sign(v) * (exp(abs(v) / 10) - 1)')} AS sexp FROM a")
def prj20(spark, d):
    s, v = F.col("r") / 255.0, F.col("x")
    return t.points(spark, d).select(
        "point_id", rounded(c.linear_schedule(s, 0.1, 0.01)).alias("lin"), rounded(c.cosine_schedule(s, 0.1, 0.01)).alias("cosine"), rounded(c.signed_log1p(v)).alias("slog"), rounded(c.signed_expm1(v / 10)).alias("sexp")
    )


@query("PRJ21_rigid_transform", f"WITH {Q}, {QN} SELECT id, " + ", ".join(f"{rd(f'{_M[i][0]}*1.0 + {_M[i][1]}*2.0 + {_M[i][2]}*3.0 + {i + 1}.5', 5)} AS {'xyz'[i]}2" for i in range(3)) + " FROM n")
def prj21(spark, d):
    r = c.rotation([F.col(k) for k in "wxyz"], True)
    v = c.rigid(r, [F.lit(1.5), F.lit(2.5), F.lit(3.5)], [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    return quaternions(spark, d).select("id", *[rounded(x, 5).alias(f"{n}2") for x, n in zip(v, "xyz", strict=True)])


@query("PRJ22_depth_to_points", f"WITH {t.VIEWS} SELECT point_id, image_id, {rd('(u - 320) * depth / 100')} AS xc, {rd('(v - 320) * depth / 100')} AS yc, {rd('depth')} AS zc FROM views WHERE depth > 0")
def prj22(spark, d):
    v = c.unproject(F.col("u"), F.col("v"), F.col("depth"), (F.lit(100.0), F.lit(100.0), F.lit(320.0), F.lit(320.0)))
    return t.views(spark, d).filter("depth > 0").select("point_id", "image_id", *[rounded(x).alias(n) for x, n in zip(v, ("xc", "yc", "zc"), strict=True)])


@query("PRJ23_ravel", f"WITH {t.VIEWS} SELECT point_id, image_id, CAST(least(greatest(round_even(u / 2, 0), 0), 319) + 320 * least(greatest(round_even(v / 2, 0), 0), 319) AS BIGINT) AS place FROM views")
def prj23(spark, d):
    return t.views(spark, d).select("point_id", "image_id", c.ravel(F.col("u") / 2, F.col("v") / 2, 320, 320).alias("place"))


@query("PRJ24_principal_point", "SELECT p_partkey AS id, p_size - 0.5::DOUBLE AS to_cv, p_size + 0.5::DOUBLE AS to_model FROM part")
def prj24(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") - 0.5).alias("to_cv"), (F.col("p_size") + 0.5).alias("to_model"))


@query("PRJ25_rotation_angle", f"WITH {Q}, {QN} SELECT id, {rd('degrees(2 * acos(least(greatest(abs(w), -1), 1)))', 4)} AS angle, {rd('degrees(acos(least(greatest((w + y) / (sqrt(w*w + x*x + y*y) * sqrt(2.0)), -1), 1)))', 4)} AS vector_angle FROM n")
def prj25(spark, d):
    m = F.sqrt(sum((F.col(k) ** 2 for k in "wxyz"), F.lit(0.0)))
    q = [F.col(k) / m for k in "wxyz"]
    a = c.rotation_angle([F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)], q)
    b = c.angle_between([q[0], q[1], q[2]], [F.lit(1.0), F.lit(0.0), F.lit(1.0)])
    return quaternions(spark, d).select("id", rounded(a, 4).alias("angle"), rounded(b, 4).alias("vector_angle"))


PAIR = "pr AS (SELECT p_partkey AS id, (p_partkey % 13) / 10.0::DOUBLE AS ax, (p_partkey % 17) / 12.0::DOUBLE AS ay, (p_partkey % 19) / 11.0::DOUBLE AS bx, (p_partkey % 23) / 14.0::DOUBLE AS bq FROM part)"


def pairs_of_pixels(spark, d):
    k = F.col("p_partkey")
    return t.table(spark, d, "part").select(k.alias("id"), ((k % 13) / 10.0).alias("ax"), ((k % 17) / 12.0).alias("ay"), ((k % 19) / 11.0).alias("bx"), ((k % 23) / 14.0).alias("bq"))


def _l(rows):
    return [[F.lit(float(x)) for x in row] for row in rows]


E = [[0.0, -0.3, 0.2], [0.3, 0.0, -0.9], [-0.2, 0.9, 0.0]]


def _sampson_sql(a, b):
    ea = [f"({' + '.join(f'{E[i][k]}::DOUBLE * {a[k]}' for k in range(3))})" for i in range(3)]
    eb = [f"({' + '.join(f'{E[k][i]}::DOUBLE * {b[k]}' for k in range(3))})" for i in range(2)]
    r = f"({' + '.join(f'{b[i]} * {ea[i]}' for i in range(3))})"
    return f"{r} * {r} / ({ea[0]}*{ea[0]} + {ea[1]}*{ea[1]} + {eb[0]}*{eb[0]} + {eb[1]}*{eb[1]})"


@query("PRJ26_sampson_error", f"WITH {PAIR} SELECT id, {rd(_sampson_sql(['ax', 'ay', '1.0::DOUBLE'], ['bx', 'bq', '1.0::DOUBLE']))} AS pixels, {rd(_sampson_sql(['(ax / (2 + 1e-6))', '(ay / (2 + 1e-6))', '1.0::DOUBLE'], ['(bx / (2 + 1e-6))', '(bq / (2 + 1e-6))', '1.0::DOUBLE']))} AS rays FROM pr")
def prj26(spark, d):
    one, two = F.lit(1.0), F.lit(2.0)
    a, b = [F.col("ax"), F.col("ay")], [F.col("bx"), F.col("bq")]
    return pairs_of_pixels(spark, d).select("id", rounded(c.sampson(_l(E), [*a, one], [*b, one])).alias("pixels"), rounded(c.sampson_rays(_l(E), [*a, two], [*b, two])).alias("rays"))


@query("PRJ27_homography_error", f"WITH {PAIR}, p AS (SELECT id, bx, bq, 1.1*ax + 0.1*ay + 0.5 AS x, -0.1*ax + 0.9*ay + 0.2 AS y, 0.01*ax + 0.02*ay + 1.0 AS z FROM pr) SELECT id, {rd('(x/z - bx)*(x/z - bx) + (y/z - bq)*(y/z - bq)')} AS error2 FROM p")
def prj27(spark, d):
    h = _l([[1.1, 0.1, 0.5], [-0.1, 0.9, 0.2], [0.01, 0.02, 1.0]])
    return pairs_of_pixels(spark, d).select("id", rounded(c.homography_error(h, [F.col("ax"), F.col("ay")], [F.col("bx"), F.col("bq")])).alias("error2"))


@query(
    "PRJ28_cheirality",
    f"""WITH {PAIR}, n AS (SELECT id, ax / sqrt(ax*ax + ay*ay + 1) AS a0, ay / sqrt(ax*ax + ay*ay + 1) AS a1, 1 / sqrt(ax*ax + ay*ay + 1) AS a2, bx / sqrt(bx*bx + bq*bq + 1) AS b0, bq / sqrt(bx*bx + bq*bq + 1) AS b1, 1 / sqrt(bx*bx + bq*bq + 1) AS b2 FROM pr),
 k AS (SELECT id, -(a0*b0 + a1*b1 + a2*b2) AS c, -(a0*1.0 + a1*0.5) AS p, (b0*1.0 + b1*0.5) AS q FROM n),
 e AS (SELECT id, p - c * q AS d1, q - c * p AS d2, 1 - c * c AS s FROM k)
 SELECT id, d1 > 0 AND d2 > 0 AND d1 < 100 * s AND d2 < 100 * s AS ahead FROM e""",
)
def prj28(spark, d):
    unit = lambda x, y: [x / F.sqrt(x * x + y * y + 1), y / F.sqrt(x * x + y * y + 1), 1 / F.sqrt(x * x + y * y + 1)]
    eye, shift = _l([[1, 0, 0], [0, 1, 0], [0, 0, 1]]), [F.lit(1.0), F.lit(0.5), F.lit(0.0)]
    return pairs_of_pixels(spark, d).select("id", c.cheirality(eye, shift, unit(F.col("ax"), F.col("ay")), unit(F.col("bx"), F.col("bq"))).alias("ahead"))


@query("PRJ29_orientation_sign", f"WITH {PAIR} SELECT id, CAST(sign((0.0*bx + 0.3*bq + -0.2*1.0) * (0.4 - 1.0 * ay)) AS DOUBLE) + 0.0 AS sgn FROM pr")
def prj29(spark, d):
    return pairs_of_pixels(spark, d).select("id", (c.orientation_sign(_l(E), [F.lit(0.1), F.lit(0.4), F.lit(1.0)], [F.col("ax"), F.col("ay"), F.lit(1.0)], [F.col("bx"), F.col("bq"), F.lit(1.0)]) + F.lit(0.0)).alias("sgn"))


@query("PRJ30_boxes", f"WITH {PAIR} SELECT id, {rd('ax - 0.5*bx')} AS x0, {rd('ay - 0.5*bq')} AS y0, {rd('ax + 0.5*bx')} AS x1, {rd('ay + 0.5*bq')} AS y1, {rd('(ax - 0.5*bx + (ax + 0.5*bx)) / 2')} AS cx, {rd('(ax + 0.5*bx) - (ax - 0.5*bx)')} AS w FROM pr")
def prj30(spark, d):
    box = c.xyxy_of_cxcywh(F.col("ax"), F.col("ay"), F.col("bx"), F.col("bq"))
    back = c.cxcywh_of_xyxy(*box)
    return pairs_of_pixels(spark, d).select("id", *[rounded(x).alias(n) for x, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)], rounded(back[0]).alias("cx"), rounded(c.xywh_of_xyxy(*box)[2]).alias("w"))


@query(
    "PRJ31_morton",
    f"WITH {t.POINTS}, box AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM points), n AS (SELECT point_id, CAST(trunc(1023 * (x - x0) / (x1 - x0)) AS BIGINT) AS a, CAST(trunc(1023 * (y - y0) / (y1 - y0)) AS BIGINT) AS b, CAST(trunc(1023 * (z - z0) / (z1 - z0)) AS BIGINT) AS c FROM points CROSS JOIN box) SELECT point_id, "
    + " | ".join(f"((({v} >> {k}) & 1) << {3 * k + j})" for k in range(10) for j, v in enumerate("abc"))
    + " AS code FROM n",
)
def prj31(spark, d):
    p = t.points(spark, d)
    box = p.agg(*[f(a).alias(f"{a}{k}") for a in "xyz" for k, f in enumerate((F.min, F.max))])
    code = c.morton(*[F.col(a) for a in "xyz"], [F.col(f"{a}0") for a in "xyz"], [F.col(f"{a}1") for a in "xyz"])
    return p.crossJoin(F.broadcast(box)).select("point_id", code.alias("code"))


@query("PRJ32_cache_key", "SELECT p_partkey AS id, md5(p_name) AS digest FROM part")
def prj32(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("digest"))


MASK = "m AS (SELECT l_suppkey AS image_id, count(DISTINCT l_partkey) AS n, CAST(max(l_quantity) - min(l_quantity) + 1 AS DOUBLE) AS bw, CAST(max(l_linenumber) - min(l_linenumber) + 1 AS DOUBLE) AS bh FROM lineitem GROUP BY 1)"


@query(
    "PRJ33_mask_quality",
    f"WITH {MASK}, q AS (SELECT *, n / 2000.0::DOUBLE AS cov, least(bw, bh) / (greatest(bw, bh) + 1e-8) AS aspect, n / (bw * bh + 1e-8) AS fill FROM m) SELECT image_id, {rd('CASE WHEN n = 0 THEN 0 WHEN cov < 0.02 OR cov > 0.75 THEN greatest(0.1, 1 - abs(cov - 0.3) / 0.3) ELSE 0.4 * least(cov / 0.3, 1) + 0.3 * aspect + 0.3 * fill END')} AS quality FROM q",
)
def prj33(spark, d):
    m = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(
        F.count_distinct("l_partkey").alias("n"), (F.max("l_quantity") - F.min("l_quantity") + 1).alias("bw"), (F.max("l_linenumber") - F.min("l_linenumber") + 1).cast("double").alias("bh")
    )
    return m.select("image_id", rounded(c.mask_quality(F.col("n"), F.lit(50.0), F.lit(40.0), F.col("bw"), F.col("bh"))).alias("quality"))


@query("PRJ34_phrase_distance", f"SELECT p_partkey AS id, {rd('1.0 / (len(list_intersect(list_distinct(string_split(lower(p_name), chr(32))), list_distinct(string_split(lower(p_type), chr(32))))) + 1)')} AS distance FROM part")
def prj34(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), rounded(c.phrase_distance(F.col("p_name"), F.col("p_type"))).alias("distance"))


@query("PRJ35_phrase_class", "WITH k AS (SELECT lower(r_name) AS name, r_regionkey AS idx FROM region) SELECT n_name AS phrase, (SELECT arg_min(name, idx) FROM k WHERE contains(lower(n_name), substr(k.name, 1, 2))) AS class FROM nation")
def prj35(spark, d):
    from orrery.operators.text import phrase_class

    phrases = t.table(spark, d, "nation").select(F.col("n_name").alias("phrase"))
    classes = t.table(spark, d, "region").select(F.substring(F.lower("r_name"), 1, 2).alias("part"), F.lower("r_name").alias("class"), F.col("r_regionkey").alias("idx"))
    return phrase_class(phrases, classes)


@query("PRJ36_caption", "SELECT p_partkey AS id, CASE WHEN ends_with(trim(lower(p_name)), '.') THEN trim(lower(p_name)) ELSE trim(lower(p_name)) || '.' END AS caption FROM part")
def prj36(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), c.caption(F.col("p_name")).alias("caption"))


@query(
    "PRJ37_window_starts",
    "WITH a AS (SELECT p_partkey AS id, 600 + p_size AS total, 224 AS win FROM part), n AS (SELECT *, total - win AS last, 2 + CAST(floor((total - win - 1) / 112.0) AS BIGINT) AS n FROM a), e AS (SELECT *, unnest(range(n)) AS i FROM n) SELECT id, i AS k, CAST(round_even(i * (last / CAST(n - 1 AS DOUBLE)), 0) AS BIGINT) AS start FROM e",
)
def prj37(spark, d):
    from orrery.operators.sequences import window_starts

    return window_starts(t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (600 + F.col("p_size")).alias("total")), 224, 112)


@query(
    "PRJ38_crop_boxes",
    f"WITH {PAIR}, k AS (SELECT id, least(greatest(ax - 0.2, 0), 1) AS x0, least(greatest(ay - 0.2, 0), 1) AS y0, least(greatest(ax + bx - 0.2, 0), 1) AS x1, least(greatest(ay + bq - 0.2, 0), 1) AS y1 FROM pr) SELECT id, {rd('x0')} AS x0, {rd('y0')} AS y0, {rd('x1')} AS x1, {rd('y1')} AS y1, {rd('(x1 - x0) * (y1 - y0)')} AS area FROM k WHERE x1 > x0 AND y1 > y0",
)
def prj38(spark, d):
    from orrery.operators.filters import crop_boxes

    p = pairs_of_pixels(spark, d).select("id", F.col("ax").alias("x0"), F.col("ay").alias("y0"), (F.col("ax") + F.col("bx")).alias("x1"), (F.col("ay") + F.col("bq")).alias("y1"))
    return crop_boxes(p, 0.2, 0.2, 1.0, 1.0).select("id", *[rounded(F.col(k)).alias(k) for k in ("x0", "y0", "x1", "y1", "area")])


@query("PRJ39_pixel_weight", f"WITH {PAIR} SELECT id, {rd('CASE WHEN ax >= 0 AND ax < 1 AND ay >= 0 AND ay < 1 THEN exp(-2 * ((ax - 0.5)*(ax - 0.5) + (ay - 0.5)*(ay - 0.5))) ELSE 0 END')} AS weight FROM pr")
def prj39(spark, d):
    zero, one = F.lit(0.0), F.lit(1.0)
    return pairs_of_pixels(spark, d).select("id", rounded(c.gaussian_weight(F.col("ax"), F.col("ay"), (zero, zero, one, one))).alias("weight"))
