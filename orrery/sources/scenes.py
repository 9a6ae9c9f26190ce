"""Scene files in JSON: readers to one table of frames, and JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_INTRINSICS = "fl_x double, fl_y double, cx double, cy double, w double, h double"
TRANSFORMS = f"{_INTRINSICS}, ply_file_path string, camera_angle_x double, frames array<struct<file_path:string, transform_matrix:array<array<double>>, {_INTRINSICS.replace(' double', ':double')}>>"
SHOT = "struct<rotation:array<double>, translation:array<double>, camera:string>"
CAMERA = "struct<projection_type:string, width:double, height:double, focal:double, focal_x:double>"


def projects(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """The parsed projects p of the files at a path: each file is one, or with lines each line."""
    return spark.read.text(path, wholetext=not lines).select(F.from_json("value", schema).alias("p"))


def transforms(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Frames by path; a frame's own intrinsics, or the file's where it has none or 0."""
    rows = projects(spark, path, TRANSFORMS, lines).select("p.*").withColumn("f", F.explode("frames"))
    own = lambda n: F.coalesce(F.nullif(F.col(f"f.{n}"), F.lit(0.0)), F.col(n)).alias(n)
    return rows.select(F.col("f.file_path").alias("file_path"), F.col("f.transform_matrix").alias("matrix"), *[own(n) for n in ("fl_x", "fl_y", "cx", "cy", "w", "h")]).orderBy("file_path")


def blender(spark: SparkSession, path: str, width: float, lines: bool = False) -> DataFrame:
    focal = 0.5 * width / F.tan(0.5 * F.col("camera_angle_x"))
    return projects(spark, path, TRANSFORMS, lines).select("p.*").select(focal.alias("focal"), F.explode("frames").alias("f")).select(F.col("f.file_path").alias("file_path"), "focal", F.col("f.transform_matrix").alias("matrix"))


def shots(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Shots of each project's first reconstruction with their camera; the focal length is relative to the larger side."""
    first = projects(spark, path, f"array<struct<cameras:map<string,{CAMERA}>,shots:map<string,{SHOT}>>>", lines).select(F.get("p", F.lit(0)).alias("p"))
    each = first.select("p.cameras", F.explode("p.shots").alias("name", "s")).withColumn("c", F.try_element_at("cameras", F.col("s.camera")))
    ok = each.filter(F.col("c.projection_type").isin("perspective", "brown"))
    return ok.select("name", (F.coalesce("c.focal_x", "c.focal") * F.greatest("c.width", "c.height")).alias("focal"), F.col("s.rotation").alias("rotation"), F.col("s.translation").alias("translation"))


def sfm_data(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Views by their project's intrinsics and poses; a view without either is an error."""
    kinds = "views array<struct<key:bigint, value:struct<ptr_wrapper:struct<data:struct<filename:string, id_intrinsic:bigint, id_pose:bigint>>>>>, intrinsics array<struct<key:bigint, value:struct<ptr_wrapper:struct<data:struct<focal_length:double, width:bigint, height:bigint>>>>>, extrinsics array<struct<key:bigint, value:struct<rotation:array<array<double>>, center:array<double>>>>"
    one = projects(spark, path, kinds, lines).select("p.*")
    keyed = lambda name: F.map_from_entries(F.transform(name, lambda x: F.struct(x["key"], x["value"])))
    v = one.select(keyed("intrinsics").alias("i"), keyed("extrinsics").alias("e"), F.explode("views").alias("v")).select("i", "e", "v.value.ptr_wrapper.data.*")
    found = v.select("filename", F.try_element_at("i", F.col("id_intrinsic"))["ptr_wrapper"]["data"]["focal_length"].alias("focal"), F.try_element_at("e", F.col("id_pose"))["center"].alias("center"))
    missing = F.raise_error(F.lit("a view has no intrinsics or no pose"))
    return found.select("filename", F.coalesce("focal", missing.cast("double")).alias("focal"), F.coalesce("center", missing.cast("array<double>")).alias("center"))


KINDS = {"transforms.json": transforms, "reconstruction.json": shots, "sfm_data.json": sfm_data}


#: In the order in which they count.
PROJECTS = ("transforms.json", "sparse", "reconstruction.json", "opensfm", "sfm_data.json")
MODELS = ("cameras.bin", "cameras.txt")


def detect(names: list[str], kinds: tuple[str, ...] = PROJECTS) -> str | None:
    """The kind of a project by the files that it has, in a fixed order."""
    return next((k for k in kinds if k in names), None)


def detected(names: Column, kinds: tuple[str, ...] = PROJECTS) -> Column:
    """The same of an array of names; null without any."""
    return F.coalesce(*[F.when(F.array_contains(names, k), F.lit(k)) for k in kinds])


def sequences(rows: DataFrame, least: float) -> DataFrame:
    """Annotated sequences with a viewpoint quality above the limit."""
    return rows.filter(F.col("quality") > least)


def to_json_map(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """One JSON object by key, keys in order."""
    entry = F.struct(F.col(key).cast("string").alias("k"), F.struct(*columns).alias("v"))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))).alias("body"))


def write_json(rows: DataFrame, path: str, key: str, *columns: str) -> None:
    to_json_map(rows, key, *columns).select(F.col("body").alias("value")).write.text(path)
