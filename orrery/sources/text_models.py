"""Camera models, images and points as text: readers and writers on spark.read.text and write.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor comments, as token arrays."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.split(F.trim("value"), r"\s+").alias("w"))


def cameras(spark: SparkSession, path: str) -> DataFrame:
    w = lambda k: F.get("w", F.lit(k))
    params = F.transform(F.slice("w", 5, F.greatest(F.size("w") - 4, F.lit(0))), lambda x: x.cast("double"))
    return _lines(spark, path).select(w(0).cast("int").alias("camera_id"), w(1).alias("model"), w(2).cast("long").alias("width"), w(3).cast("long").alias("height"), params.alias("params"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Two lines for each image; the second may be blank. A file is one row, so that lines stay together: these files hold
    one record per image, while points, which are many, are read line by line."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: ~x.startswith("#"))
    at = F.sequence(F.lit(0), F.greatest(F.size("ls") - 1, F.lit(0)), F.lit(2))
    pairs = whole.select(lines.alias("ls")).select(F.explode(F.transform(at, lambda i: F.struct(F.get("ls", i).alias("head"), F.get("ls", i + 1).alias("obs")))).alias("p"))
    w = lambda k: F.get("w", F.lit(k))
    rows = pairs.select(F.split(F.trim("p.head"), r"\s+").alias("w"), F.split(F.trim(F.coalesce("p.obs", F.lit(""))), r"\s+").alias("o")).filter(F.size("w") >= 10)
    triples = F.when(F.size("o") >= 3, F.transform(F.sequence(F.lit(0), F.floor(F.size("o") / 3).cast("int") - 1), lambda i: F.struct(F.get("o", 3 * i).cast("double").alias("x"), F.get("o", 3 * i + 1).cast("double").alias("y"), F.get("o", 3 * i + 2).cast("long").alias("point3d_id"))))
    none = F.array().cast("array<struct<x:double,y:double,point3d_id:bigint>>")
    return rows.select(
        w(0).cast("int").alias("image_id"), F.transform(F.slice("w", 2, 4), lambda x: x.cast("double")).alias("qvec"), F.transform(F.slice("w", 6, 3), lambda x: x.cast("double")).alias("tvec"), w(8).cast("int").alias("camera_id"), w(9).alias("name"), F.coalesce(triples, none).alias("obs")
    )


def points(spark: SparkSession, path: str) -> DataFrame:
    w = lambda k: F.get("w", F.lit(k))
    n = F.floor((F.size("w") - 8) / 2).cast("int")
    track = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("w", 8 + 2 * i).cast("int").alias("image_id"), F.get("w", 9 + 2 * i).cast("int").alias("point2d_idx"))))
    return _lines(spark, path).select(
        w(0).cast("long").alias("point_id"), *[w(k + 1).cast("double").alias(a) for k, a in enumerate("xyz")], *[w(k + 4).cast("int").alias(a) for k, a in enumerate("rgb")], w(7).cast("double").alias("error"),
        F.coalesce(track, F.array().cast("array<struct<image_id:int,point2d_idx:int>>")).alias("track"),
    )


def known_observations(rows: DataFrame) -> DataFrame:
    """(image_id, idx, point_id): observations of points, without those of none (-1)."""
    return rows.select("image_id", F.posexplode("obs").alias("idx", "o")).select("image_id", "idx", F.col("o.point3d_id").alias("point_id")).filter("point_id <> -1")


def write_cameras(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws(" ", "camera_id", "model", "width", "height", F.array_join(F.transform("params", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)


def write_images(rows: DataFrame, path: str) -> None:
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    obs = F.array_join(F.transform("obs", lambda o: F.concat_ws(" ", o["x"], o["y"], o["point3d_id"])), " ")
    rows.coalesce(1).orderBy("image_id").select(F.concat(F.concat_ws(" ", "image_id", join("qvec"), join("tvec"), "camera_id", "name"), F.lit("\n"), obs).alias("value")).write.text(path)


def write_points(rows: DataFrame, path: str) -> None:
    """Six decimals, in the order of ids over the files."""
    track = F.array_join(F.transform("track", lambda o: F.concat_ws(" ", o["image_id"], o["point2d_idx"])), " ")
    line = F.format_string("%d %.6f %.6f %.6f %d %d %d %.6f %s", "point_id", "x", "y", "z", "r", "g", "b", "error", track)
    rows.orderBy("point_id").select(F.rtrim(line).alias("value")).write.text(path)


def relative_poses(spark: SparkSession, path: str) -> DataFrame:
    """name1 name2 qw qx qy qz tx ty tz."""
    w = lambda k: F.get("w", F.lit(k))
    return _lines(spark, path).select(w(0).alias("name1"), w(1).alias("name2"), *[w(k + 2).cast("double").alias(n) for k, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))])


def with_new_images(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """(name, image_id): known images, and names of pairs that are not known yet with ids after the largest."""
    from pyspark.sql import Window

    names = pairs.select(F.explode(F.array("name1", "name2")).alias("name")).distinct()
    top = images.agg(F.coalesce(F.max("image_id"), F.lit(0)).alias("top"))
    new = names.join(images, "name", "left_anti").withColumn("k", F.row_number().over(Window.orderBy("name"))).crossJoin(F.broadcast(top))
    return images.select("name", F.col("image_id").cast("long").alias("image_id")).unionByName(new.select("name", (F.col("top") + F.col("k")).cast("long").alias("image_id")))


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select("a", "b").distinct().orderBy("a", "b").withColumn("score", F.lit(1.0)).write.csv(path)


def write_rotations(rows: DataFrame, path: str) -> None:
    rows.orderBy("name").select(F.concat_ws(" ", "name", "qw", "qx", "qy", "qz").alias("value")).write.text(path)


def write_clusters(rows: DataFrame, path: str) -> None:
    """One folder for each cluster_id; -1 where a row has none."""
    rows.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).write.partitionBy("cluster_id").parquet(path)


def newest_iteration(names: DataFrame) -> DataFrame:
    """The largest number of names like iteration_7000."""
    return names.agg(F.max(F.regexp_extract("name", r"_(\d+)$", 1).try_cast("long")).alias("iteration"))


def image_files(names: DataFrame) -> DataFrame:
    return names.filter(F.lower("name").rlike(r"\.(jpg|jpeg|png|webp)$"))
