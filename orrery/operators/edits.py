"""Edit prompts: a rule grammar as Columns, so that plans exist for a whole column of prompts, and plans applied to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.functions import fixed

COLOUR = "struct<type:string,r:int,g:int,b:int,sr:int,sg:int,sb:int,amount:double>"
GEOMETRY = "struct<type:string,axis:string,amount:double,dx:double,dy:double,dz:double>"

# The patterns that decide about an edit.
GREY = r"\b(grey|gray|greyscale|grayscale|desatur|monochrome|remove colou?r)\b"
METAL = r"\bmetallic\s+(\w+)|\b(\w+)\s+metallic\b"
TINT = r"\btint\s+(?:it\s+)?(\w+)"
BRIGHT = r"\b(bright(?:en)?|lighten)\s*(?:by\s*)?([\d.]+)?"
DARK = r"\b(dark(?:en)?)\s*(?:by\s*)?([\d.]+)?"
SCALE = r"\b(scale|resize)\s*(?:up|down)?\s*(?:by\s*)?([\d.]+)\s*[xX×]?"
BIGGER = r"\b(bigger|larger|enlarge|scale\s*up)\b"
SMALLER = r"\b(smaller|shrink|scale\s*down)\b"
TALLER = r"\b(taller|elongate|stretch\s*(?:vertical|up))\b"
WIDER = r"\b(wider|broader|expand\s*(?:horizontal))\b"
FLAT = r"\b(flat(?:ten)?|squish|compress)\b"
ROTATE = r"\brotate\s*(?:by\s*)?([\d.]+)\s*deg(?:rees?)?\s*(clockwise|counter|ccw|cw)?"
QUARTER = r"\brotate\s*(?:90|quarter)"
HALF = r"\brotate\s*(?:180|half)"
FLIP = r"\bflip\b"
UP = r"\bmove\s+up\s*(?:by\s*)?([\d.]+)?"
DOWN = r"\bmove\s+down\s*(?:by\s*)?([\d.]+)?"
SMOOTH = r"\b(smooth|round|soften)\b"


def _group(text: Column, pattern: str, k: int) -> Column:
    """The group's text, null if it is empty or nothing matches."""
    got = F.regexp_extract(text, pattern, k)
    return F.when(got != "", got)


def _number(text: Column, pattern: str, k: int, default: float) -> Column:
    return F.coalesce(_group(text, pattern, k).try_cast("double"), F.lit(default))


def _bound(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def first_of(text: Column, names) -> Column:
    """The first of the names, in their order, that stands in the text as a word: one search for all of them."""
    order = F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])
    at = F.array_min(F.transform(F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(names)})\b"), F.lit(1)), lambda x: F.try_element_at(order, x)))
    return F.get(F.array(*map(F.lit, names)), at)


def named(text: Column) -> Column:
    """The first colour of the table, in its order, that stands in the text."""
    return first_of(text, list(fixed.NAMED_COLOURS))


def channels(name: Column, tables: tuple[dict, ...], default=None) -> list[Column]:
    """Red, green and blue of a name; the first table that has it counts."""
    merged = {key: rgb for table in reversed(tables) for key, rgb in table.items()}
    table = F.create_map(*[x for key, rgb in merged.items() for x in (F.lit(key), F.array(*map(F.lit, rgb)))])
    found = F.try_element_at(table, name)
    if default is not None:
        found = F.coalesce(found, F.array(*map(F.lit, default)))
    return [F.get(found, F.lit(k)) for k in range(3)]


def _op(kind: str, schema: str, **values) -> Column:
    names = [x.split(":")[0] for x in schema[len("struct<") : -1].split(",")]
    kinds = [x.split(":")[1] for x in schema[len("struct<") : -1].split(",")]
    values["type"] = F.lit(kind)
    return F.struct(*[(values[n] if n in values else F.lit(None)).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


def _list(*pairs) -> Column:
    """The operations whose condition holds, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), op) for cond, op in pairs]), lambda x: x.isNotNull())


def plan(prompt: Column) -> Column:
    """struct<colour, texture, geometry> of a prompt; null prompts have empty plans."""
    return _bound(F.trim(F.lower(F.coalesce(prompt, F.lit("")))), _plan)


def _plan(text: Column) -> Column:
    rgb = c.hex_channels(text)
    metal = F.coalesce(_group(text, METAL, 1), _group(text, METAL, 2))
    is_metal = text.rlike(r"\bmetallic\b")
    colour = named(text)
    tinted = _group(text, TINT, 1)
    base, sheen = channels(metal, (fixed.NAMED_COLOURS,), (200, 200, 200)), channels(metal, (fixed.METALLIC_SHEEN,), fixed.METALLIC_SHEEN["silver"])
    of = lambda v: dict(zip("rgb", v, strict=True))
    colours = _list(
        (text.rlike(GREY), _op("desaturate", COLOUR)),
        (rgb[0].isNotNull(), _op("recolour", COLOUR, **of(rgb))),
        (is_metal, _op("metallic", COLOUR, **of(base), sr=sheen[0], sg=sheen[1], sb=sheen[2])),
        (~is_metal & colour.isNotNull(), _op("recolour", COLOUR, **of(channels(colour, (fixed.NAMED_COLOURS,))))),
        (tinted.isin(*fixed.NAMED_COLOURS), _op("tint", COLOUR, **of(channels(tinted, (fixed.NAMED_COLOURS,))), amount=F.lit(0.45))),
        (text.rlike(BRIGHT), _op("brightness", COLOUR, amount=F.least(_number(text, BRIGHT, 2, 1.3), F.lit(3.0)))),
        (text.rlike(DARK), _op("brightness", COLOUR, amount=F.greatest(_number(text, DARK, 2, 0.7), F.lit(0.1)))),
    )
    texture = first_of(text, list(fixed.TEXTURE_PALETTES))
    turn = _number(text, ROTATE, 1, 0.0) * F.when(_group(text, ROTATE, 2).isin("clockwise", "cw"), -1).otherwise(1)
    by_degrees, by_scale = text.rlike(ROTATE), text.rlike(SCALE)
    zero = F.lit(0.0)
    geometry = _list(
        (by_scale, _op("scale_uniform", GEOMETRY, amount=c.clamp(_number(text, SCALE, 2, 1.0), 0.1, 10.0))),
        (~by_scale & text.rlike(BIGGER), _op("scale_uniform", GEOMETRY, amount=F.lit(1.5))),
        (~by_scale & ~text.rlike(BIGGER) & text.rlike(SMALLER), _op("scale_uniform", GEOMETRY, amount=F.lit(0.67))),
        (text.rlike(TALLER), _op("scale_axis", GEOMETRY, axis=F.lit("y"), amount=F.lit(1.4))),
        (text.rlike(WIDER), _op("scale_axis", GEOMETRY, axis=F.lit("x"), amount=F.lit(1.4))),
        (text.rlike(FLAT), _op("scale_axis", GEOMETRY, axis=F.lit("y"), amount=F.lit(0.5))),
        (by_degrees, _op("rotate_y", GEOMETRY, amount=turn)),
        (~by_degrees & text.rlike(QUARTER), _op("rotate_y", GEOMETRY, amount=F.lit(90.0))),
        (~by_degrees & ~text.rlike(QUARTER) & (text.rlike(HALF) | text.rlike(FLIP)), _op("rotate_y", GEOMETRY, amount=F.lit(180.0))),
        (text.rlike(UP), _op("translate", GEOMETRY, dx=zero, dy=_number(text, UP, 1, 0.2), dz=zero)),
        (text.rlike(DOWN), _op("translate", GEOMETRY, dx=zero, dy=-_number(text, DOWN, 1, 0.2), dz=zero)),
        (text.rlike(SMOOTH), _op("smooth", GEOMETRY, amount=F.lit(2.0))),
    )
    return F.struct(colours.alias("colour"), F.filter(F.array(texture), lambda x: x.isNotNull()).alias("texture"), geometry.alias("geometry"))


def parse(spark, prompt: str):
    """The plan of one prompt as a Row."""
    return spark.createDataFrame([(prompt,)], "prompt string").select(plan(F.col("prompt")).alias("p")).first()["p"]


def merge_llm_plan(answer: Column, prompt: Column, schema: str) -> Column:
    """A plan written as JSON, with or without code fences; the rules' plan where it can't be read."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(F.from_json(plain, schema), prompt)


def apply(points: DataFrame, p) -> DataFrame:
    """points (point_id, x, y, z, r, g, b) after a plan: colours, then texture, then geometry about the first centroid."""
    rgb = [F.col(k) for k in "rgb"]
    for op in p["colour"]:
        colour = (op["r"], op["g"], op["b"])
        rgb = {
            "recolour": lambda: c.recolour(rgb, colour), "tint": lambda: c.tint(rgb, colour, op["amount"]), "desaturate": lambda: c.desaturate(rgb),  # noqa: B023
            "brightness": lambda: c.brightness(rgb, op["amount"]), "metallic": lambda: c.metallic(rgb, colour, (op["sr"], op["sg"], op["sb"])),  # noqa: B023
        }[op["type"]]()
        points = points.withColumns(dict(zip("rgb", rgb, strict=True)))
        rgb = [F.col(k) for k in "rgb"]
    for name in p["texture"]:
        points = points.withColumns(dict(zip("rgb", c.texture_colour(F.col("point_id"), name, noise=0.12), strict=True)))
    if not p["geometry"]:
        return points
    centre = points.agg(*[F.avg(k).alias(f"m{k}") for k in "xyz"])
    names = points.columns
    points = points.crossJoin(F.broadcast(centre))
    x, y, z, mx, my, mz = (F.col(k) for k in ("x", "y", "z", "mx", "my", "mz"))
    for op in p["geometry"]:
        n = op["amount"]
        if op["type"] == "scale_uniform":
            new = {"x": mx + (x - mx) * n, "y": my + (y - my) * n, "z": mz + (z - mz) * n}
        elif op["type"] == "scale_axis":
            k = op["axis"]
            new = {k: F.col(f"m{k}") + (F.col(k) - F.col(f"m{k}")) * n}
        elif op["type"] == "rotate_y":
            co, si = F.cos(F.radians(F.lit(n))), F.sin(F.radians(F.lit(n)))
            new = {"x": mx + co * (x - mx) + si * (z - mz), "z": mz - si * (x - mx) + co * (z - mz)}
        elif op["type"] == "translate":
            new = {"x": x + op["dx"], "y": y + op["dy"], "z": z + op["dz"]}
        else:
            from orrery.operators.spatial import smooth

            moved = smooth(points.select("point_id", "x", "y", "z"), int(n), 7, 1.0)
            points = points.drop("x", "y", "z").join(moved, "point_id")
            continue
        points = points.withColumns(new)
    return points.select(*names)


def labelled_edits(prompt: Column) -> Column:
    """map<label, edit> of "label: edit; label: edit". A clause without a label is for __all__; later clauses win."""
    parts = F.filter(F.transform(F.split(prompt, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pair = lambda x: F.when(x.contains(":"), F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v"))).otherwise(F.struct(F.lit("__all__").alias("k"), x.alias("v")))
    pairs = F.when(F.size(parts) > 0, F.transform(parts, pair)).otherwise(F.array(F.struct(F.lit("__all__").alias("k"), F.trim(prompt).alias("v"))))
    # the last entry of each label, whatever the session's policy on repeated keys is
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def image_colour(prompt: Column) -> list[Column]:
    """Target channels of an image edit: metal, then hex, then the first named colour."""
    text = F.trim(F.lower(prompt))
    metal = F.coalesce(_group(text, METAL, 1), _group(text, METAL, 2), F.when(text.rlike(r"\bmetallic\b"), F.lit("silver")))
    of_metal = channels(metal, (fixed.METALLIC_BASE, fixed.NAMED_COLOURS), (192, 192, 192))
    return [F.when(metal.isNotNull(), m).otherwise(F.coalesce(h, n)) for m, h, n in zip(of_metal, c.hex_channels(text), channels(named(text), (fixed.NAMED_COLOURS,)), strict=True)]


def image_brightness(prompt: Column) -> Column:
    text = F.lower(prompt)
    return F.when(text.rlike(BRIGHT), _number(text, BRIGHT, 2, 1.35)).when(text.rlike(DARK), _number(text, DARK, 2, 0.65))
