"""Scalar functions as Column factories. All of them stay inside Spark's generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions import fixed


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def byte(x: Column) -> Column:
    """Clipped to 0..255 and truncated."""
    return clamp(x, 0.0, 255.0).cast("int")


def dot(a, b) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        total = total + x * y
    return total


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cross(a, b) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def matvec(m, v) -> list[Column]:
    return [dot(row, v) for row in m]


def transpose(m):
    return [list(row) for row in zip(*m, strict=True)]


# --- rotations ---------------------------------------------------------------------------------------------------


def rotation(q, normalise: bool = False) -> list[list[Column]]:
    """3x3 rotation of a quaternion (w, x, y, z); as it is, or of unit length."""
    if normalise:
        n = norm(q)
        q = [c / n for c in q]
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def angle_between(a, b) -> Column:
    """Degrees between two vectors."""
    return F.degrees(F.acos(clamp(dot(a, b) / (norm(a) * norm(b)), -1.0, 1.0)))


def rotation_angle(p, q) -> Column:
    """Degrees of the rotation from unit quaternion p to q."""
    return F.degrees(2 * F.acos(clamp(F.abs(dot(p, q)), -1.0, 1.0)))


def rigid(r, t, v) -> list[Column]:
    return [a + b for a, b in zip(matvec(r, v), t, strict=True)]


# --- cameras -----------------------------------------------------------------------------------------------------


def project(v, camera) -> tuple[Column, Column, Column]:
    """(u, v, depth) of a point in camera axes; camera = (fx, fy, cx, cy)."""
    x, y, z = v
    fx, fy, cx, cy = camera
    d = z + F.lit(1e-8)
    return fx * x / d + cx, fy * y / d + cy, z


def intrinsics(params: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """fx, fy, cx, cy; what is missing is fx, fx, half the width and half the height."""
    at = lambda k: F.get(params, F.lit(k))
    fx = at(0)
    return fx, F.coalesce(at(1), fx), F.coalesce(at(2), width * 0.5), F.coalesce(at(3), height * 0.5)


def visible(u: Column, v: Column, depth: Column, width, height) -> Column:
    """In front and inside the image; pixels are truncated towards zero."""
    iu, iv = u.cast("int"), v.cast("int")
    return (depth > 0.01) & (iu >= 0) & (iu < width) & (iv >= 0) & (iv < height)


def focal_of_fov(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def fov_of_focal(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def unproject(u: Column, v: Column, depth: Column, camera) -> list[Column]:
    fx, fy, cx, cy = camera
    return [(u - cx) * depth / fx, (v - cy) * depth / fy, depth]


def ravel(x: Column, y: Column, width: int, height: int) -> Column:
    """Nearest pixel (halves to even), clipped, as x + width * y."""
    return (clamp(F.rint(x), 0.0, width - 1.0) + width * clamp(F.rint(y), 0.0, height - 1.0)).cast("long")


# --- two views ---------------------------------------------------------------------------------------------------


def sampson(e, a, b) -> Column:
    """Squared Sampson error of x2' E x1 for pixels a, b given as 3-vectors with last entry 1."""
    ea, eb = matvec(e, a), matvec(transpose(e), b)
    r = dot(b, ea)
    return r * r / (ea[0] * ea[0] + ea[1] * ea[1] + eb[0] * eb[0] + eb[1] * eb[1])


def sampson_rays(e, a, b, eps: float = 1e-6) -> Column:
    """The same for rays, which are first divided by z + eps."""
    flat = lambda v: [v[0] / (v[2] + eps), v[1] / (v[2] + eps), F.lit(1.0)]
    return sampson(e, flat(a), flat(b))


def homography_error(h, a, b) -> Column:
    p = matvec(h, [a[0], a[1], F.lit(1.0)])
    dx, dy = p[0] / p[2] - b[0], p[1] / p[2] - b[1]
    return dx * dx + dy * dy


def cheirality(r, t, a, b, low: float = 0.0, high: float = 100.0) -> Column:
    """Do rays a and b meet in front of both cameras, at depths within the bounds scaled by 1 - cos**2?"""
    ra = matvec(r, a)
    c = -dot(ra, b)
    b1, b2 = -dot(ra, t), dot(b, t)
    depth1, depth2 = b1 - c * b2, b2 - c * b1
    scale = 1 - c * c
    return (depth1 > low * scale) & (depth2 > low * scale) & (depth1 < high * scale) & (depth2 < high * scale)


def essential(r, t) -> list[list[Column]]:
    """[t]x R."""
    columns = transpose(r)
    return transpose([cross(t, c) for c in columns])


def orientation_sign(f, epipole, a, b) -> Column:
    """Sign of the oriented epipolar constraint."""
    row = [dot([f[0][k], f[1][k], f[2][k]], b) for k in (0,)][0]
    return F.signum(row * (epipole[1] - epipole[2] * a[1]))


# --- colours -----------------------------------------------------------------------------------------------------


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hsv(r: Column, g: Column, b: Column, grey_hue_zero: bool = True) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in 0..1 of 0..255 channels. A later channel that is the largest decides the hue.
    grey_hue_zero: greys have hue 0, else the hue that the blue channel gives them."""
    x, y, z = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(x, y, z), F.least(x, y, z)
    delta = top - low + F.lit(1e-8)
    hue = F.when(top == z, (x - y) / delta + 4).when(top == y, (z - x) / delta + 2).otherwise(F.pmod((y - z) / delta, F.lit(6.0))) / 6.0
    if grey_hue_zero:
        hue = F.when(delta > F.lit(1e-8), hue).otherwise(F.lit(0.0))
    return hue, F.when(top > 0, delta / (top + F.lit(1e-8))).otherwise(F.lit(0.0)), top


def rgb_of_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    six = h * 6.0
    i = F.floor(six)
    f = six - i
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(i, F.lit(6))
    pick = lambda *c: F.element_at(F.array(*c), (k + 1).cast("int"))
    return tuple((x * 255).cast("int") for x in (pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)))


def recolour(rgb, target) -> list[Column]:
    light = luminance(*rgb) / 255.0
    return [byte(lit(t) * light * 0.85 + c * 0.15) for c, t in zip(rgb, target, strict=True)]


def tint(rgb, target, strength: float = 0.4) -> list[Column]:
    return [byte(c * (1 - strength) + lit(t) * strength) for c, t in zip(rgb, target, strict=True)]


def desaturate(rgb) -> list[Column]:
    return [byte(luminance(*rgb))] * 3


def brightness(rgb, factor) -> list[Column]:
    return [byte(c * lit(factor)) for c in rgb]


def metallic(rgb, base, sheen) -> list[Column]:
    light = luminance(*rgb) / 255.0
    shine = (light - 0.60) / 0.40
    out = []
    for c, b, s in zip(rgb, base, sheen, strict=True):
        tinted = lit(b) * light
        tinted = F.when(light > 0.60, tinted * (1 - 0.20 * shine) + lit(s) * 0.20 * shine).otherwise(tinted)
        out.append(byte(tinted * 0.85 + c * 0.15))
    return out


def draw(key: Column, what: str = "") -> Column:
    """A number from 0 up to 1 that a key always gets: 32 bits of its MD5, so that other engines draw the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(what), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def texture_colour(key: Column, name: str, base: tuple[int, int, int] = (128, 128, 128), noise: float = 0.0) -> list[Column]:
    """A palette colour drawn for the key, with the palette's weights; an entry without a colour is the base's. noise: the standard
    deviation, as a share of 255, of what is added to each channel before it is cut to a byte."""
    palette = fixed.TEXTURE_PALETTES[name]
    whole, total, edges = sum(w for w, _ in palette), 0.0, []
    for weight, _ in palette:
        total += weight / whole
        edges.append(total)
    place = F.size(F.filter(F.array(*map(F.lit, edges[:-1])), lambda e: e <= draw(key, name)))
    chosen = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in (colour or base)]) for _, colour in palette]), place)
    out = []
    for k, channel in enumerate("rgb"):
        value = F.get(chosen, F.lit(k))
        if noise:
            # two even draws make a normal one
            even, turn = F.greatest(draw(key, f"{channel}1"), F.lit(1e-12)), draw(key, f"{channel}2")
            value = value + noise * 255 * F.sqrt(-2 * F.ln(even)) * F.cos(2 * math.pi * turn)
        out.append(F.floor(clamp(value, 0.0, 255.0)).cast("int"))
    return out


# --- splats ------------------------------------------------------------------------------------------------------


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(x: Column) -> Column:
    return F.ln(x / (1 - x))


def sh_of_rgb(c: Column) -> Column:
    return (c - 0.5) / fixed.SH0


def rgb_of_sh(c: Column) -> Column:
    return c * fixed.SH0 + 0.5


def sh_basis(degree: int, x: Column, y: Column, z: Column) -> list[Column]:
    """Values of the real spherical harmonics up to the degree in direction (x, y, z)."""
    xx, yy, zz, xy, yz, xz = x * x, y * y, z * z, x * y, y * z, x * z
    out = [F.lit(fixed.SH0)]
    if degree > 0:
        out += [-fixed.SH1 * y, fixed.SH1 * z, -fixed.SH1 * x]
    if degree > 1:
        c = fixed.SH2
        out += [c[0] * xy, c[1] * yz, c[2] * (2 * zz - xx - yy), c[3] * xz, c[4] * (xx - yy)]
    if degree > 2:
        c = fixed.SH3
        out += [c[0] * y * (3 * xx - yy), c[1] * xy * z, c[2] * y * (4 * zz - xx - yy), c[3] * z * (2 * zz - 3 * xx - 3 * yy), c[4] * x * (4 * zz - xx - yy), c[5] * z * (xx - yy), c[6] * x * (xx - 3 * yy)]
    if degree > 3:
        c = fixed.SH4
        out += [
            c[0] * xy * (xx - yy), c[1] * yz * (3 * xx - yy), c[2] * xy * (7 * zz - 1), c[3] * yz * (7 * zz - 3), c[4] * (zz * (35 * zz - 30) + 3),
            c[5] * xz * (7 * zz - 3), c[6] * (xx - yy) * (7 * zz - 1), c[7] * xz * (xx - 3 * yy), c[8] * (xx * (xx - 3 * yy) - yy * (3 * xx - yy)),
        ]
    return out


def covariance(scale, q) -> list[Column]:
    """The six entries xx, xy, xz, yy, yz, zz of R S S' R'."""
    r = rotation(q, normalise=True)
    m = [[r[i][k] * scale[k] for k in range(3)] for i in range(3)]
    return [dot(m[i], m[j]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def morton(x: Column, y: Column, z: Column, low, high) -> Column:
    """30 bits, 10 of each axis within the box, x lowest."""
    total = F.lit(0).cast("long")
    for axis, (v, a, b) in enumerate(zip((x, y, z), low, high, strict=True)):
        n = (1023 * (v - a) / (b - a)).cast("long")
        for bit in range(10):
            total = total.bitwiseOR(F.shiftleft(F.shiftright(n, bit).bitwiseAND(F.lit(1)), 3 * bit + axis))
    return total


# --- schedules ---------------------------------------------------------------------------------------------------


def log_linear(step: Column, start: float, end: float, steps: int, delay_steps: int = 0, delay_mult: float = 1.0) -> Column:
    t = clamp(step / steps, 0.0, 1.0)
    delay = delay_mult + (1 - delay_mult) * F.sin(F.lit(0.5 * 3.141592653589793) * clamp(step / delay_steps, 0.0, 1.0)) if delay_steps else F.lit(1.0)
    rate = delay * F.exp((1 - t) * F.ln(F.lit(start)) + t * F.ln(F.lit(end)))
    return F.when(step < 0, F.lit(0.0)).otherwise(rate)


def linear_schedule(t: Column, start: float, end: float) -> Column:
    return start + (end - start) * t


def cosine_schedule(t: Column, start: float, end: float) -> Column:
    return end + (start - end) * (1 + F.cos(t * 3.141592653589793)) / 2


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def signed_expm1(x: Column) -> Column:
    return F.signum(x) * F.expm1(F.abs(x))


# --- boxes and text ----------------------------------------------------------------------------------------------


def xyxy_of_cxcywh(cx: Column, cy: Column, w: Column, h: Column) -> list[Column]:
    return [cx - 0.5 * w, cy - 0.5 * h, cx + 0.5 * w, cy + 0.5 * h]


def cxcywh_of_xyxy(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [(x0 + x1) / 2, (y0 + y1) / 2, x1 - x0, y1 - y0]


def xywh_of_xyxy(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [x0, y0, x1 - x0, y1 - y0]


def box_area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def box_overlap(a, b) -> tuple[Column, Column]:
    """Intersection and union."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return w * h, box_area(a) + box_area(b) - w * h


def mask_quality(n: Column, width: Column, height: Column, box_w: Column, box_h: Column) -> Column:
    """Quality of a mask of n pixels with that bounding box: coverage, squareness and filling."""
    cov = n / (width * height)
    aspect = F.least(box_w, box_h) / (F.greatest(box_w, box_h) + F.lit(1e-8))
    fill = n / (box_w * box_h + F.lit(1e-8))
    good = 0.4 * F.least(cov / 0.3, F.lit(1.0)) + 0.3 * aspect + 0.3 * fill
    return F.when(n == 0, 0.0).when((cov < 0.02) | (cov > 0.75), F.greatest(F.lit(0.1), 1 - F.abs(cov - 0.3) / 0.3)).otherwise(good)


def phrase_distance(a: Column, b: Column) -> Column:
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    return 1.0 / (F.size(F.array_intersect(words(a), words(b))) + 1)


def caption(text: Column) -> Column:
    """Lower-cased, trimmed, ending with a full stop."""
    plain = F.trim(F.lower(text))
    return F.when(plain.endswith("."), plain).otherwise(F.concat(plain, F.lit(".")))


def safe_label(label: Column) -> Column:
    return F.regexp_replace(label, "[ /]", "_")


def hex_channels(text: Column) -> list[Column]:
    """Three channels of the first #rrggbb, null without one."""
    code = F.regexp_extract(F.lower(text), "#([0-9a-f]{6})", 1)
    return [F.when(code != "", F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int")) for k in range(3)]


def gaussian_weight(x: Column, y: Column, box) -> Column:
    """exp(-2 d**2) with d relative to the box's size; 0 outside."""
    dx = (x - (box[0] + box[2]) / 2) / (box[2] - box[0])
    dy = (y - (box[1] + box[3]) / 2) / (box[3] - box[1])
    inside = (x >= box[0]) & (x < box[2]) & (y >= box[1]) & (y < box[3])
    return F.when(inside, F.exp(-2 * (dx * dx + dy * dy))).otherwise(F.lit(0.0))
