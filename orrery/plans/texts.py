"""Queries on prompts, labels and JSON (STR, JSN, ARR, MAP)."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.functions import fixed
from orrery.operators import edits as e
from orrery.plans import tables as t
from orrery.plans.registry import query, rd, rounded

# Prompts that the grammar is tried on.
PROMPTS = (
    "make it bright red", "tint it red", "metallic gold", "rotate 90 degrees clockwise", "scale down by 2", "desaturate", "turn it grey", "paint #ff3300 and brighten by 2.5",
    "copper metallic, please", "metallic", "make the chair bigger and smoother", "smaller", "darker", "darken by 0.05", "wood", "rusty", "rust and blue", "taller and wider", "flatten it", "rotate half",
    "flip it", "move up by 0.5", "move down", "smooth", "remove color", "resize 20x", "rotate 45 deg cw", "", "navy marble, scale 1.5", "Brighten by 9 and move up",
)
_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PROMPTS) + "]"
SQL = f"pr AS (SELECT p_partkey AS id, ({_LIST})[CAST(p_partkey % {len(PROMPTS)} AS INTEGER) + 1] AS prompt FROM part), tx AS (SELECT id, prompt, trim(lower(prompt)) AS s FROM pr)"


def prompts(spark, d):
    k = F.col("p_partkey")
    return t.table(spark, d, "part").select(k.alias("id"), F.element_at(F.array(*map(F.lit, PROMPTS)), (k % len(PROMPTS) + 1).cast("int")).alias("prompt"))


def _re(p: str) -> str:
    return "'" + p + "'"


def _first(names) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(s, '\\b{n}\\b') THEN '{n}'" for n in names) + " END"


def _n(p: str, k: int, default: float) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract(s, {_re(p)}, {k}), '') AS DOUBLE), {default})"


def _has(p: str) -> str:
    return f"regexp_matches(s, {_re(p)})"


@query(
    "STR01_prompt_colours",
    f"""WITH {SQL}, m AS (SELECT *, coalesce(nullif(regexp_extract(s, {_re(e.METAL)}, 1), ''), nullif(regexp_extract(s, {_re(e.METAL)}, 2), '')) AS metal, {_has(chr(92) + 'bmetallic' + chr(92) + 'b')} AS is_metal, {_first(fixed.NAMED_COLOURS)} AS colour, nullif(regexp_extract(s, {_re(e.TINT)}, 1), '') AS tint FROM tx)
 SELECT id, CAST({_has(e.GREY)}::INT + (regexp_extract(s, '#([0-9a-f]{{6}})', 1) <> '')::INT + is_metal::INT + (NOT is_metal AND colour IS NOT NULL)::INT + coalesce(tint IN ({', '.join(repr(x) for x in fixed.NAMED_COLOURS)}), false)::INT + {_has(e.BRIGHT)}::INT + {_has(e.DARK)}::INT AS BIGINT) AS n_colour,
 {_has(e.GREY)} AS grey, is_metal, CASE WHEN NOT is_metal THEN colour END AS colour, CASE WHEN {_has(e.BRIGHT)} THEN least({_n(e.BRIGHT, 2, 1.3)}, 3.0) WHEN {_has(e.DARK)} THEN greatest({_n(e.DARK, 2, 0.7)}, 0.1) END AS factor FROM m""",
)
def str01_colours(spark, d):
    p = prompts(spark, d).withColumn("p", e.plan(F.col("prompt")))
    of = lambda kind: F.filter("p.colour", lambda x: x["type"] == kind)
    text = F.trim(F.lower("prompt"))
    metal = F.size(of("metallic")) > 0
    return p.select(
        "id", F.size("p.colour").cast("long").alias("n_colour"), (F.size(of("desaturate")) > 0).alias("grey"), metal.alias("is_metal"), F.when(~metal, e.named(text)).alias("colour"), F.get(of("brightness"), F.lit(0))["amount"].alias("factor")
    )


@query(
    "STR01_prompt_geometry",
    f"""WITH {SQL} SELECT id, {_first(fixed.TEXTURE_PALETTES)} AS texture,
 CASE WHEN {_has(e.SCALE)} THEN least(greatest({_n(e.SCALE, 2, 1.0)}, 0.1), 10.0) WHEN {_has(e.BIGGER)} THEN 1.5 WHEN {_has(e.SMALLER)} THEN 0.67 END::DOUBLE AS scale,
 CASE WHEN {_has(e.ROTATE)} THEN {_n(e.ROTATE, 1, 0.0)} * CASE WHEN regexp_extract(s, {_re(e.ROTATE)}, 2) IN ('clockwise', 'cw') THEN -1 ELSE 1 END WHEN {_has(e.QUARTER)} THEN 90.0 WHEN {_has(e.HALF)} OR {_has(e.FLIP)} THEN 180.0 END::DOUBLE AS turn,
 CAST({_has(e.TALLER)}::INT + {_has(e.WIDER)}::INT + {_has(e.FLAT)}::INT AS BIGINT) AS n_axes, CASE WHEN {_has(e.UP)} THEN {_n(e.UP, 1, 0.2)} WHEN {_has(e.DOWN)} THEN -{_n(e.DOWN, 1, 0.2)} END::DOUBLE AS dy, {_has(e.SMOOTH)} AS smooths FROM tx""",
)
def str01_geometry(spark, d):
    p = prompts(spark, d).withColumn("p", e.plan(F.col("prompt")))
    of = lambda kind: F.filter("p.geometry", lambda x: x["type"] == kind)
    first = lambda kind, field: F.get(of(kind), F.lit(0))[field]
    return p.select(
        "id", F.get("p.texture", F.lit(0)).alias("texture"), first("scale_uniform", "amount").alias("scale"), first("rotate_y", "amount").alias("turn"),
        F.size(of("scale_axis")).cast("long").alias("n_axes"), first("translate", "dy").alias("dy"), (F.size(of("smooth")) > 0).alias("smooths"),
    )


@query("STR01_plan_execution")
def str01_execution(spark, d):
    """A prompt compiled and run over the points: colours, then geometry about the first centroid."""
    out = e.apply(t.points(spark, d), e.parse(spark, "metallic gold, scale up by 2, rotate 90 degrees clockwise and move up"))
    return out.select("point_id", *[rounded(F.col(k), 5).alias(k) for k in "xyz"], "r", "g", "b")


EDITS = "(CASE p_partkey % 4 WHEN 0 THEN 'bottle: gold; Table: wood' WHEN 1 THEN 'make it red' WHEN 2 THEN 'A: x; a: y; plain' ELSE ' ; lamp : dim: 2 ' END)"


@query("STR02_labelled_edits", f"WITH k AS (SELECT p_partkey AS id, p_partkey % 4 AS m FROM part) SELECT id, CASE m WHEN 0 THEN 'bottle=gold|table=wood' WHEN 1 THEN '__all__=make it red' WHEN 2 THEN '__all__=plain|a=y' ELSE 'lamp=dim: 2' END AS edits FROM k")
def str02(spark, d):
    k = F.col("p_partkey")
    text = F.element_at(F.array(*map(F.lit, ("bottle: gold; Table: wood", "make it red", "A: x; a: y; plain", " ; lamp : dim: 2 "))), (k % 4 + 1).cast("int"))
    m = t.table(spark, d, "part").select(k.alias("id"), e.labelled_edits(text).alias("m"))
    return m.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), "|").alias("edits"))


@query("STR03_image_extractors", f"WITH {SQL} SELECT id, CASE WHEN {_has(e.BRIGHT)} THEN {_n(e.BRIGHT, 2, 1.35)} WHEN {_has(e.DARK)} THEN {_n(e.DARK, 2, 0.65)} END::DOUBLE AS brightness, {_first(fixed.TEXTURE_PALETTES)} AS texture, {_has(e.GREY)} AS grey FROM tx")
def str03(spark, d):
    text = F.trim(F.lower("prompt"))
    return prompts(spark, d).select("id", e.image_brightness(F.col("prompt")).alias("brightness"), F.get(e.plan(F.col("prompt"))["texture"], F.lit(0)).alias("texture"), text.rlike(e.GREY).alias("grey"))


@query("STR04_safe_labels", "SELECT p_partkey AS id, regexp_replace(p_name || '/x', '[ /]', '_', 'g') AS label FROM part")
def str04(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), c.safe_label(F.concat("p_name", F.lit("/x"))).alias("label"))


@query("STR05_label_list", "SELECT n_nationkey AS id, len(list_filter(list_transform(string_split(n_name || ', ,' || n_name, ','), lambda x: trim(x)), lambda x: x <> '')) AS n FROM nation")
def str05(spark, d):
    text = F.concat("n_name", F.lit(", ,"), "n_name")
    labels = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return t.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.size(labels).cast("long").alias("n"))


@query("STR06_hex_colours", "WITH k AS (SELECT p_partkey AS id, substr(md5(p_name), 1, 6) AS h FROM part) SELECT id, CAST(('0x' || substr(h, 1, 2))::INT AS INTEGER) AS r, CAST(('0x' || substr(h, 3, 2))::INT AS INTEGER) AS g, CAST(('0x' || substr(h, 5, 2))::INT AS INTEGER) AS b FROM k")
def str06(spark, d):
    text = F.concat(F.lit("paint it #"), F.substring(F.md5("p_name"), 1, 6))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[x.alias(n) for x, n in zip(c.hex_channels(text), "rgb", strict=True)])


@query("STR07_project_ids", "SELECT p_partkey AS id, CASE WHEN trim(p_name) = '' THEN 'proj_' || substr(md5(p_name), 1, 8) ELSE replace(lower(p_name), ' ', '_') END AS project FROM part")
def str07(spark, d):
    name = F.when(F.trim("p_name") == "", F.concat(F.lit("proj_"), F.substring(F.md5("p_name"), 1, 8))).otherwise(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("project"))


@query("STR08_enum_and_percent", "SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN upper(event_type) ELSE 'UNKNOWN' END AS status, coalesce(TRY_CAST(replace(CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(event_id % 101 AS VARCHAR) || '%' END, '%', '') AS DOUBLE) / 100, 0) AS progress FROM events")
def str08(spark, d):
    text = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.concat((F.col("event_id") % 101).cast("string"), F.lit("%")))
    status = F.when(F.col("event_type").isin("view", "click", "signup"), F.upper("event_type")).otherwise(F.lit("UNKNOWN"))
    return t.table(spark, d, "events").select("event_id", status.alias("status"), F.coalesce(F.replace(text, F.lit("%"), F.lit("")).try_cast("double") / 100, F.lit(0.0)).alias("progress"))


@query("STR09_frame_numbers", "SELECT p_partkey AS id, CAST(regexp_extract('DSC' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '.JPG', 'DSC(\\d+)', 1) AS BIGINT) AS frame FROM part")
def str09(spark, d):
    name = F.concat(F.lit("DSC"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit(".JPG"))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_extract(name, r"DSC(\d+)", 1).cast("long").alias("frame"))


@query("STR10_caption_spans", "WITH k AS (SELECT n_regionkey AS image, n_name, lower(n_name) AS w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation), s AS (SELECT *, coalesce(sum(length(w) + 3) OVER (PARTITION BY image ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM k) SELECT n_name, CAST(a AS BIGINT) AS start, CAST(a + length(w) AS BIGINT) AS stop FROM s")
def str10(spark, d):
    from orrery.operators.text import caption_spans

    return caption_spans(t.table(spark, d, "nation").select(F.col("n_regionkey").alias("image"), F.col("n_nationkey").alias("idx"), F.col("n_name").alias("word"))).select(F.col("word").alias("n_name"), "start", "stop")


@query("STR11_token_classes", "WITH l AS (SELECT user_id AS q, length(event_type) AS tok, max(value) / 200 AS p FROM events GROUP BY 1, 2), m AS (SELECT tok, cls, 1.0 / (1 + abs(tok - cls)) AS w FROM (SELECT unnest(range(4, 9)) AS tok), (SELECT unnest(range(4, 7)) AS cls)) SELECT q, cls AS class, " + rd("sum(CASE WHEN p > 0.3 THEN p * w ELSE 0 END)", 9) + " AS score FROM l JOIN m USING (tok) GROUP BY 1, 2")
def str11(spark, d):
    from orrery.operators.text import token_classes

    logits = t.table(spark, d, "events").groupBy(F.col("user_id").alias("q"), F.length("event_type").cast("long").alias("tok")).agg((F.max("value") / 200).alias("p"))
    tokens = spark.range(4, 9).toDF("tok").crossJoin(spark.range(4, 7).toDF("class")).withColumn("w", 1.0 / (1 + F.abs(F.col("tok") - F.col("class"))))
    return token_classes(logits, tokens, 0.3).withColumn("score", rounded(F.col("score"), 9))


@query("JSN01_fenced_json", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def jsn01(spark, d):
    answer = F.when(F.col("event_id") % 5 == 0, F.lit("sorry, no json")).otherwise(F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
    plan = e.merge_llm_plan(answer, F.struct(F.lit(None).cast("long").alias("k")), "struct<k:bigint>")
    return t.table(spark, d, "events").select("event_id", F.coalesce(plan["k"], F.lit(-1)).cast("long").alias("k"))


@query("JSN02_batch_edits", "SELECT r_name AS label, lower(r_name) || ' edit' AS prompt FROM region WHERE r_regionkey <> 2")
def jsn02(spark, d):
    from orrery.operators.text import batch_edits

    known = t.table(spark, d, "region").select(F.col("r_name").alias("label"))
    body = known.filter("label <> 'ASIA'").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", F.concat(F.lower("label"), F.lit(" edit")))))).alias("body"))
    return batch_edits(body, known)


@query("ARR01_push", "SELECT p_partkey AS id, len(list_append([p_name, p_brand], p_type)) AS n, list_append([p_name, p_brand], p_type)[3] AS last FROM part")
def arr01(spark, d):
    a = F.array_append(F.array("p_name", "p_brand"), F.col("p_type"))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(a).cast("long").alias("n"), F.element_at(a, -1).alias("last"))


@query("MAP01_nested_masks", "SELECT l_linenumber AS label, l_suppkey AS image, count(*) AS n FROM lineitem GROUP BY 1, 2")
def map01(spark, d):
    """Nested maps label -> image -> mask as rows."""
    per = t.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("label"), F.col("l_suppkey").alias("image")).agg(F.count("*").alias("n"))
    nested = per.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("image", "n"))).alias("m"))
    return nested.select("label", F.explode("m").alias("image", "n"))
