"""Parts that the driver's tables play: points, cameras, gaussians, edges, observations, votes. SQL has the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("point_id"),
        (k % 37 - 18).cast("double").alias("x"), ((k * 7) % 41 - 20).cast("double").alias("y"), (1 + F.col("p_size") / 10.0).alias("z"),
        ((k * 53) % 256).alias("r"), ((k * 101) % 256).alias("g"), ((k * 197) % 256).alias("b"),
    )


POINTS = """points AS (SELECT p_partkey AS point_id, CAST(p_partkey % 37 - 18 AS DOUBLE) AS x, CAST((p_partkey * 7) % 41 - 20 AS DOUBLE) AS y,
 1 + p_size / 10.0::DOUBLE AS z, (p_partkey * 53) % 256 AS r, (p_partkey * 101) % 256 AS g, (p_partkey * 197) % 256 AS b FROM part)"""


def cameras(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("image_id"), (F.col("n_regionkey") - 2).cast("double").alias("tx"), F.lit(0.0).alias("ty"), (F.col("n_nationkey") / 10.0).alias("tz"),
        F.lit(100.0).alias("f"), F.lit(320.0).alias("c"), F.lit(640).alias("size"), F.col("n_name").alias("name"),
    )


CAMERAS = """cameras AS (SELECT CAST(n_nationkey AS BIGINT) AS image_id, CAST(n_regionkey - 2 AS DOUBLE) AS tx, 0.0::DOUBLE AS ty, n_nationkey / 10.0::DOUBLE AS tz,
 100.0::DOUBLE AS f, 320.0::DOUBLE AS c, 640 AS size, n_name AS name FROM nation)"""


def views(spark: SparkSession, d: str) -> DataFrame:
    """Points seen by cameras: the projection join. Cameras are few by nature and broadcast after a check of their number."""
    from orrery.operators.joins import projection_join

    return projection_join(points(spark, d), cameras(spark, d))


VIEWS = f"""{POINTS}, {CAMERAS}, projected AS (SELECT p.*, c.image_id, c.size, x + tx AS xc, y + ty AS yc, z + tz AS depth, f, c.c FROM points p CROSS JOIN cameras c),
 pixels AS (SELECT *, f * xc / (depth + 1e-8) + c AS u, f * yc / (depth + 1e-8) + c AS v FROM projected),
 views AS (SELECT * FROM pixels WHERE depth > 0.01 AND trunc(u) >= 0 AND trunc(u) < size AND trunc(v) >= 0 AND trunc(v) < size)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """An undirected graph without loops on customers' and suppliers' keys, from orders and lines."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 97).alias("p"), (F.col("l_partkey") % 89).alias("q"), "l_quantity")
    return rows.filter("p <> q").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("l_quantity").alias("w"), F.count("*").alias("n"))


EDGES = """edges AS (SELECT least(p, q) AS a, greatest(p, q) AS b, sum(l_quantity) AS w, count(*) AS n FROM
 (SELECT l_suppkey % 97 AS p, l_partkey % 89 AS q, l_quantity FROM lineitem) WHERE p <> q GROUP BY 1, 2)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Tracks (parts) seen in images (suppliers), with a pixel."""
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("track_id"), F.col("l_suppkey").alias("image_id")).agg(F.min("l_quantity").alias("px"), F.max("l_discount").alias("py"))


OBSERVATIONS = "observations AS (SELECT l_partkey AS track_id, l_suppkey AS image_id, min(l_quantity) AS px, max(l_discount) AS py FROM lineitem GROUP BY 1, 2)"


def votes(spark: SparkSession, d: str) -> DataFrame:
    """Scores of labels (event types) for points (users)."""
    return table(spark, d, "events").select(F.col("user_id").alias("point_id"), F.col("event_type").alias("label"), F.col("value").alias("score"), "event_id", "ts")


VOTES = "votes AS (SELECT user_id AS point_id, event_type AS label, value AS score, event_id, ts FROM events)"


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Double vectors with their label."""
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))


DESCRIPTORS = "descriptors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS BIGINT) AS label FROM embeddings)"
