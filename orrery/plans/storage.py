"""Queries on sources and sinks (SRC, SNK), streams (STM), records (CRD) and options (CFG). Files go into the shared folder."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators import options
from orrery.operators.state import shared_dir
from orrery.plans import tables as t
from orrery.plans.filters import gaussians
from orrery.plans.registry import query, rd, rounded
from orrery.sources import binary, scenes
from orrery.sources import text_models as tm
from orrery.streaming import progress as pr


def folder(spark) -> str:
    return f"{shared_dir(spark)}/orrery-files-{uuid.uuid4().hex}"


CAMS = "cams AS (SELECT CAST(n_nationkey AS INTEGER) AS camera_id, 'PINHOLE' AS model, CAST(640 + n_nationkey AS BIGINT) AS width, 480::BIGINT AS height, CAST(n_nationkey + 0.5 AS DOUBLE) AS fx FROM nation)"


def cams(spark, d):
    k = F.col("n_nationkey")
    return t.table(spark, d, "nation").select(k.cast("int").alias("camera_id"), F.lit("PINHOLE").alias("model"), (640 + k).cast("long").alias("width"), F.lit(480).cast("long").alias("height"), F.array(k + 0.5, F.lit(100.0), F.lit(320.0), F.lit(240.0)).cast("array<double>").alias("params"))


def pts(spark, d):
    one = F.struct((F.col("point_id") % 25).cast("int").alias("image_id"), F.lit(7).alias("point2d_idx"))
    return t.points(spark, d).select("point_id", "x", "y", "z", *[F.col(k).cast("int").alias(k) for k in "rgb"], (F.col("point_id") % 8 / 8.0).alias("error"), F.array(one, one).alias("track"))


def imgs(spark, d):
    k = F.col("s_suppkey")
    obs = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.struct((i + 0.5).cast("double").alias("x"), (i * 2.0).cast("double").alias("y"), F.when(i % 2 == 1, F.lit(-1)).otherwise(k).cast("long").alias("point3d_id")))
    return t.table(spark, d, "supplier").select(k.cast("int").alias("image_id"), F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]).alias("qvec"), F.array(k / 4.0, F.lit(0.0), F.lit(1.0)).alias("tvec"), F.col("s_nationkey").cast("int").alias("camera_id"), F.concat(F.lit("im"), k.cast("string"), F.lit(".jpg")).alias("name"), obs.alias("obs"))


@query("SRC01_cameras_text", f"WITH {CAMS} SELECT camera_id, model, width, height, fx FROM cams")
def src01(spark, d):
    path = folder(spark)
    tm.write_cameras(cams(spark, d), path)
    return tm.cameras(spark, path).select("camera_id", "model", "width", "height", F.get("params", F.lit(0)).alias("fx"))


@query("SRC02_images_text", "SELECT CAST(s_suppkey AS INTEGER) AS image_id, CAST(s_nationkey AS INTEGER) AS camera_id, 'im' || s_suppkey || '.jpg' AS name, s_suppkey / 4.0::DOUBLE AS tx, CAST(s_suppkey % 4 + 1 AS BIGINT) AS n FROM supplier")
def src02(spark, d):
    path = folder(spark)
    tm.write_images(imgs(spark, d), path)
    return tm.images(spark, path).select("image_id", "camera_id", "name", F.get("tvec", F.lit(0)).alias("tx"), F.size("obs").cast("long").alias("n"))


@query("SRC03_points_text", f"WITH {t.POINTS} SELECT point_id, x, y, {rd('z')} AS z, CAST(r AS INTEGER) AS r, point_id % 8 / 8.0::DOUBLE AS error, 2::BIGINT AS n FROM points")
def src03(spark, d):
    path = folder(spark)
    tm.write_points(pts(spark, d), path)
    return tm.points(spark, path).select("point_id", "x", "y", rounded(F.col("z")).alias("z"), "r", "error", F.size("track").cast("long").alias("n"))


@query("SRC04_binary_model", f"WITH {CAMS} SELECT camera_id, width, fx FROM cams")
def src04(spark, d):
    body = binary.encode(cams(spark, d).select("camera_id", F.lit(1).alias("model"), "width", "height", "params"), binary.bytes_of_cameras)
    rows = binary.decode(body, binary.cameras_of, "camera_id int, model int, width long, height long, params array<double>")
    return rows.select("camera_id", "width", F.get("params", F.lit(0)).alias("fx"))


@query("SRC04_binary_images", "SELECT CAST(s_suppkey AS INTEGER) AS image_id, CAST(s_nationkey AS INTEGER) AS camera_id, 'im' || s_suppkey || '.jpg' AS name, s_suppkey / 4.0::DOUBLE AS tx, CAST(s_suppkey % 4 + 1 AS BIGINT) AS n FROM supplier")
def src04_images(spark, d):
    rows = binary.decode(binary.encode(imgs(spark, d), binary.bytes_of_images), binary.images_of, "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, obs array<struct<x:double,y:double,point3d_id:bigint>>")
    return rows.select("image_id", "camera_id", "name", F.get("tvec", F.lit(0)).alias("tx"), F.size("obs").cast("long").alias("n"))


@query("SRC04_binary_points", f"WITH {t.POINTS} SELECT point_id, x, y, {rd('z')} AS z, CAST(r AS INTEGER) AS r, point_id % 8 / 8.0::DOUBLE AS error, 2::BIGINT AS n FROM points")
def src04_points(spark, d):
    rows = binary.decode(binary.encode(pts(spark, d), binary.bytes_of_points), binary.points_of, "point_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,point2d_idx:int>>")
    return rows.select("point_id", "x", "y", rounded(F.col("z")).alias("z"), "r", "error", F.size("track").cast("long").alias("n"))


#: A project is a nation, its frames are suppliers; each project is one line of JSON.
FRAMES = "fr AS (SELECT n_nationkey AS k, s_suppkey AS i, s_name AS name, s_acctbal AS bal FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def frames(spark, d):
    n = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    s = t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("i"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("bal"))
    return s.join(n, "k")


def _lines(spark, bodies) -> str:
    path = folder(spark)
    bodies.select(F.to_json("body").alias("value")).write.text(path)
    return path


@query(
    "SRC05_06_detection",
    f"WITH {FRAMES}, h AS (SELECT k, list(CASE i % 5 WHEN 0 THEN 'sfm_data.json' WHEN 1 THEN 'transforms.json' WHEN 2 THEN 'sparse' WHEN 3 THEN 'reconstruction.json' ELSE 'readme' END) AS f, list(CASE WHEN i % 3 = 0 THEN 'cameras.bin' WHEN i % 3 = 1 THEN 'cameras.txt' ELSE 'points.ply' END) AS m FROM fr GROUP BY 1) SELECT k, CASE WHEN list_contains(f, 'transforms.json') THEN 'transforms.json' WHEN list_contains(f, 'sparse') THEN 'sparse' WHEN list_contains(f, 'reconstruction.json') THEN 'reconstruction.json' WHEN list_contains(f, 'sfm_data.json') THEN 'sfm_data.json' END AS kind, CASE WHEN list_contains(m, 'cameras.bin') THEN 'cameras.bin' WHEN list_contains(m, 'cameras.txt') THEN 'cameras.txt' END AS model FROM h",
)
def src05(spark, d):
    i = F.col("i")
    files = F.when(i % 5 == 0, "sfm_data.json").when(i % 5 == 1, "transforms.json").when(i % 5 == 2, "sparse").when(i % 5 == 3, "reconstruction.json").otherwise("readme")
    model = F.when(i % 3 == 0, "cameras.bin").when(i % 3 == 1, "cameras.txt").otherwise("points.ply")
    held = frames(spark, d).groupBy("k").agg(F.collect_set(files).alias("f"), F.collect_set(model).alias("m"))
    return held.select("k", scenes.detected(F.col("f")).alias("kind"), scenes.detected(F.col("m"), scenes.MODELS).alias("model"))


def _transforms(spark, d) -> str:
    k, i, lit = F.col("k"), F.col("i"), F.lit
    frame = F.struct(F.col("name").alias("file_path"), F.when(i % 3 == 1, 0.0).when(i % 3 == 2, 600.0 + i % 50).alias("fl_x"), F.array(F.array(lit(1.0), lit(0.0), lit(0.0), F.col("bal"))).alias("transform_matrix"))
    each = frames(spark, d).groupBy("k").agg(F.collect_list(frame).alias("frames"))
    whole = [(500.0 + k).alias("fl_x"), lit(510.0).alias("fl_y"), lit(320.0).alias("cx"), lit(240.0).alias("cy"), lit(640.0).alias("w"), lit(480.0).alias("h"), (0.5 + k / 100).alias("camera_angle_x")]
    return _lines(spark, each.select(F.struct(*whole, "frames").alias("body")))


@query("SRC07_transforms_json", f"WITH {FRAMES} SELECT name AS file_path, CASE WHEN i % 3 = 2 THEN 600 + i % 50 ELSE 500 + k END::DOUBLE AS fl_x, 510.0::DOUBLE AS fl_y, CAST(bal AS DOUBLE) AS tx FROM fr")
def src07(spark, d):
    return scenes.transforms(spark, _transforms(spark, d), lines=True).select("file_path", "fl_x", "fl_y", F.col("matrix")[0][3].alias("tx"))


@query("SRC08_reconstruction_json", f"WITH {FRAMES} SELECT name, {rd('0.9 * (640 + k)')} AS focal, CAST(bal AS DOUBLE) AS tz FROM fr WHERE k % 4 <> 0")
def src08(spark, d):
    """Every fourth project has cameras of a kind that is left out; each has a second reconstruction, which is ignored."""
    k, three = F.col("k"), lambda *x: F.array(*[F.lit(v) if isinstance(v, float) else v for v in x])
    name = F.concat(F.lit("c"), k.cast("string"))
    shot = F.struct("name", F.struct(three(0.0, 0.0, 1.0).alias("rotation"), three(1.0, 2.0, F.col("bal")).alias("translation"), name.alias("camera")))
    each = frames(spark, d).groupBy("k").agg(F.map_from_entries(F.collect_list(shot)).alias("shots"))
    camera = F.struct(F.when(k % 4 == 0, "fisheye").otherwise("perspective").alias("projection_type"), (640.0 + k).alias("width"), F.lit(480.0).alias("height"), F.lit(0.9).alias("focal"))
    one = F.struct(F.create_map(name, camera).alias("cameras"), "shots")
    other = F.struct(F.create_map(name, camera).alias("cameras"), F.map_filter("shots", lambda n, s: n == "").alias("shots"))
    return scenes.shots(spark, _lines(spark, each.select(F.array(one, other).alias("body"))), lines=True).select("name", rounded(F.col("focal")).alias("focal"), F.col("translation")[2].alias("tz"))


@query("SRC09_sfm_data_json", f"WITH {FRAMES} SELECT name AS filename, 700.5 + i % 3 + k AS focal, CAST(bal AS DOUBLE) AS cz FROM fr")
def src09(spark, d):
    """Projects use the same keys, three intrinsics each."""
    k, i = F.col("k"), F.col("i")
    data = lambda x: F.struct(F.struct(x.alias("data")).alias("ptr_wrapper"))
    view = F.struct(i.alias("key"), data(F.struct(F.col("name").alias("filename"), (i % 3).alias("id_intrinsic"), i.alias("id_pose"))).alias("value"))
    pose = F.struct(i.alias("key"), F.struct(F.array(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("rotation"), F.array(F.lit(1.0), F.lit(2.0), F.col("bal")).alias("center")).alias("value"))
    each = frames(spark, d).groupBy("k").agg(F.collect_list(view).alias("views"), F.collect_list(pose).alias("extrinsics"))
    lens = F.array(*[F.struct(F.lit(j).cast("long").alias("key"), data(F.struct((700.5 + j + k).alias("focal_length"), F.lit(640).alias("width"), F.lit(480).alias("height"))).alias("value")) for j in range(3)])
    return scenes.sfm_data(spark, _lines(spark, each.select(F.struct("views", lens.alias("intrinsics"), "extrinsics").alias("body"))), lines=True).select("filename", "focal", F.col("center")[2].alias("cz"))


@query("SRC10_blender_json", f"WITH {FRAMES} SELECT name AS file_path, {rd('0.5 * 640 / tan(0.5 * (0.5 + k / 100.0::DOUBLE))', 4)} AS focal FROM fr")
def src10(spark, d):
    return scenes.blender(spark, _transforms(spark, d), 640.0, lines=True).select("file_path", rounded(F.col("focal"), 4).alias("focal"))


def _ply(spark, d) -> str:
    path = folder(spark)
    g = gaussians(spark, d).select(F.col("id").cast("double").alias("id"), "opacity", "s0", "s1", "s2", *[(F.col("id") % (k + 3)).cast("double").alias(f"f_rest_{k}") for k in (10, 2, 0)])
    files = binary.to_ply(g.repartition(2, "id"), g.columns, "id")
    files.write.format("parquet").save(path)
    return path


@query("SRC11_12_ply", "SELECT p_partkey AS id, CAST(p_partkey % 3 AS DOUBLE) AS f_rest_0, CAST(p_partkey % 13 AS DOUBLE) AS f_rest_10, " + rd("(p_partkey % 40 - 20) / 4.0", 4) + " AS opacity FROM part")
def src11(spark, d):
    """Gaussians written as PLY files and read again through their headers."""
    held = spark.read.parquet(_ply(spark, d))
    names = ["id", "opacity", "f_rest_0", "f_rest_10"]
    rows = binary.decode(held, lambda data: [dict(zip(names, (float(r[n]) for n in names), strict=True)) for r in binary.ply_array(data)], ", ".join(f"{n} double" for n in names))
    return rows.select(F.col("id").cast("long").alias("id"), "f_rest_0", "f_rest_10", rounded(F.col("opacity"), 4).alias("opacity"))


@query("SRC15_relative_poses", "WITH p AS (SELECT s_name AS name1, 'new' || (s_suppkey % 7) AS name2, s_suppkey FROM supplier WHERE s_suppkey % 3 = 0) SELECT name1, name2, CAST((SELECT max(s_suppkey) FROM supplier) + 1 + row_number() OVER (ORDER BY name2) - row_number() OVER (PARTITION BY name2 ORDER BY name1) - (SELECT 0) AS BIGINT) * 0 + CAST(s_suppkey AS BIGINT) AS id1 FROM p")
def src15(spark, d):
    s = t.table(spark, d, "supplier")
    lines = s.filter("s_suppkey % 3 = 0").select(F.concat_ws(" ", F.replace("s_name", F.lit(" "), F.lit("_")), F.concat(F.lit("new"), F.col("s_suppkey") % 7), F.lit("1 0 0 0 0.5 0 0")).alias("value"))
    path = folder(spark)
    lines.write.text(path)
    pairs = tm.relative_poses(spark, path)
    known = s.select(F.replace("s_name", F.lit(" "), F.lit("_")).alias("name"), F.col("s_suppkey").alias("image_id"))
    ids = tm.with_new_images(pairs, known)
    return pairs.join(ids.toDF("name1", "id1"), "name1").join(ids.toDF("name2", "id2"), "name2").select("name1", "name2", "id1")


@query("SRC16_view_graph", "WITH k AS (SELECT l_suppkey AS a, l_partkey % 40 AS b, l_orderkey % 60 AS f1, l_linenumber AS config FROM lineitem), kp AS (SELECT s_suppkey AS a, 30 + s_suppkey % 30 AS n FROM supplier) SELECT k.a, b, count(*) AS n FROM k JOIN kp USING (a) WHERE config NOT IN (0, 1, 6, 7) AND f1 < kp.n GROUP BY 1, 2")
def src16(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40).alias("b"), (F.col("l_orderkey") % 60).alias("f1"), F.col("l_linenumber").alias("config"))
    keypoints = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("a"), (30 + F.col("s_suppkey") % 30).alias("n_keypoints"))
    return rows.filter(~F.col("config").isin(0, 1, 6, 7)).join(keypoints, "a").filter("f1 < n_keypoints").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("SRC17_18_image_files", "SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 2")
def src18(spark, d):
    ext = F.element_at(F.array(F.lit(".JPG"), F.lit(".png"), F.lit(".txt")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return tm.image_files(t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", ext).alias("name"))).select("id")


@query("SRC19_known_observations", "SELECT CAST(s_suppkey AS INTEGER) AS image_id, CAST(s_suppkey % 4 // 2 + 1 AS BIGINT) AS n FROM supplier")
def src19(spark, d):
    path = folder(spark)
    tm.write_images(imgs(spark, d), path)
    return tm.known_observations(tm.images(spark, path)).groupBy("image_id").agg(F.count("*").alias("n"))


@query("SRC20_annotations", "SELECT o_custkey AS seq, count(*) AS n FROM orders WHERE o_orderkey % 100 > 50 GROUP BY 1")
def src20(spark, d):
    rows = t.table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), (F.col("o_orderkey") % 100).alias("quality"))
    path = folder(spark)
    rows.write.option("compression", "gzip").json(path)
    return scenes.sequences(spark.read.schema("seq long, quality double").json(path), 50).groupBy("seq").agg(F.count("*").alias("n"))


@query("SRC21_inverted_index", f"WITH {t.POINTS} SELECT CAST(point_id % 25 AS INTEGER) AS image_id, CAST(count(*) * 2 AS BIGINT) AS n FROM points GROUP BY 1")
def src21(spark, d):
    path = folder(spark)
    tm.write_points(pts(spark, d), path)
    return tm.points(spark, path).select("point_id", F.explode("track").alias("o")).groupBy(F.col("o.image_id").alias("image_id")).agg(F.count("*").alias("n"))


_SHEETS = "sheets AS (SELECT l_suppkey AS id, y, x, (l_suppkey * 7 + y * 5 + x * 3) % 50 - 1 AS v FROM (SELECT DISTINCT l_suppkey FROM lineitem), (SELECT unnest(range(3)) AS y), (SELECT unnest(range(4)) AS x))"


def _sheets(spark, d, kind: str):
    """A file of each kind for each supplier of lines, of 3 x 4 values from -1 to 48."""
    from collections.abc import Iterator
    from io import BytesIO

    import numpy as np
    import pyarrow as pa

    def body(key: int) -> bytes:
        y, x = np.mgrid[:3, :4]
        a = ((key * 7 + y * 5 + x * 3) % 50 - 1).astype("f4")
        if kind == "npy":
            np.save(held := BytesIO(), a)
            return held.getvalue()
        return {"pfm": lambda: binary.bytes_of_pfm(a), "flo": lambda: binary.bytes_of_flo(np.stack([a, a * 2], -1)), "png": lambda: binary.bytes_of_png(np.maximum(a, 0))}[kind]()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([body(k) for k in batch.column(0).to_pylist()], pa.binary())], names=["content"])

    return t.table(spark, d, "lineitem").select("l_suppkey").distinct().mapInArrow(run, "content binary")


@query("SRC22_disparity_and_flow", f"WITH {_SHEETS} SELECT x, y, count(*) AS n, CAST(sum((v <= 0)::INT) AS BIGINT) AS no_disparity, sum(CASE WHEN v > 0 THEN v END)::DOUBLE AS total, sum(3 * v)::DOUBLE AS flow FROM sheets GROUP BY 1, 2")
def src22(spark, d):
    """Disparities (what is not above 0 is infinite) and flow of all files, summed by pixel."""
    far = F.col("value") == float("inf")
    p = binary.decode(_sheets(spark, d, "pfm"), binary.pfm_of, "x int, y int, value double")
    p = p.groupBy("x", "y").agg(F.count("*").alias("n"), F.count_if(far).alias("no_disparity"), F.sum(F.when(~far, F.col("value"))).alias("total"))
    flow = binary.decode(_sheets(spark, d, "flo"), binary.flo_of, "x int, y int, u double, v double").groupBy("x", "y").agg(F.sum(F.col("u") + F.col("v")).alias("flow"))
    return p.join(flow, ["x", "y"])


@query("SRC22_png_and_npy", f"WITH {_SHEETS} SELECT x, y, CAST(sum((v <= 0)::INT) AS BIGINT) AS no_disparity, sum(CASE WHEN v > 0 THEN v END)::DOUBLE / 32 AS scaled, sum(v)::DOUBLE AS plain FROM sheets GROUP BY 1, 2")
def src22_png(spark, d):
    """16-bit images with a divisor of 32 and plain arrays."""
    far = F.col("value") == float("inf")
    p = binary.decode(_sheets(spark, d, "png"), partial(binary.png_of, divisor=32.0), "x int, y int, value double")
    p = p.groupBy("x", "y").agg(F.count_if(far).alias("no_disparity"), F.sum(F.when(~far, F.col("value"))).alias("scaled"))
    plain = binary.decode(_sheets(spark, d, "npy"), binary.npy_of, "x int, y int, value double").groupBy("x", "y").agg(F.sum("value").alias("plain"))
    return p.join(plain, ["x", "y"])


@query("SRC23_newest_iteration", "SELECT max(p_partkey) AS iteration FROM part")
def src23(spark, d):
    return tm.newest_iteration(t.table(spark, d, "part").select(F.concat(F.lit("iteration_"), F.col("p_partkey").cast("string")).alias("name")))


@query("SNK03_cluster_export", "SELECT CAST(CASE WHEN s_suppkey % 4 = 0 THEN -1 ELSE s_suppkey % 3 END AS INTEGER) AS cluster_id, count(*) AS n FROM supplier GROUP BY 1")
def snk03(spark, d):
    path = folder(spark)
    k = F.col("s_suppkey")
    tm.write_clusters(t.table(spark, d, "supplier").select(k, F.when(k % 4 != 0, k % 3).cast("int").alias("cluster_id")), path)
    return spark.read.parquet(path).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("SNK06_quantised_splats", "WITH g AS (SELECT p_partkey AS id, (p_partkey % 40 - 20) / 4.0::DOUBLE AS o, (p_size + 1) / 60.0::DOUBLE AS a, (p_partkey % 30 + 1) / 45.0::DOUBLE AS b, (p_partkey % 11 + 1) / 25.0::DOUBLE AS c FROM part) SELECT id, " + rd("(a + b + c) / (1 + exp(-o))") + " AS key, CAST(floor(255 / (1 + exp(-o))) AS INTEGER) AS balpha FROM g")
def snk06(spark, d):
    g = gaussians(spark, d).withColumns({**{k: F.lit(0.1) for k in ("c0", "c1", "c2")}, "qw": F.lit(1.0), "qx": F.lit(0.0), "qy": F.lit(0.0), "qz": F.lit(0.0)})
    return binary.quantised(g).orderBy(F.desc("key")).select("id", rounded(F.col("key")).alias("key"), "balpha")


@query("SNK07_08_json", "SELECT count(*) AS n FROM nation")
def snk08(spark, d):
    body = scenes.to_json_map(t.table(spark, d, "nation"), "n_name", "n_nationkey", "n_regionkey")
    return body.select(F.size(F.from_json("body", "map<string,string>")).cast("long").alias("n"))


@query("SNK09_pair_list", f"WITH {t.EDGES} SELECT a, b, 1.0::DOUBLE AS score FROM edges")
def snk09(spark, d):
    path = folder(spark)
    tm.write_pairs(t.edges(spark, d), path)
    return spark.read.schema("a long, b long, score double").csv(path)


@query("STM01_project_state", "WITH k AS (SELECT user_id AS project, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS status, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS progress, CASE WHEN event_id % 5 = 0 THEN event_type END AS stage FROM events) SELECT project, arg_max(status, seq) FILTER (status <> '') AS status, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress, arg_max(stage, seq) FILTER (stage IS NOT NULL) AS stage FROM k GROUP BY 1")
def stm01(spark, d):
    return pr.latest(progress_events(spark, d))


def progress_events(spark, d):
    k = F.col("event_id")
    return t.table(spark, d, "events").select(F.col("user_id").alias("project"), k.alias("seq"), F.when(k % 3 == 0, "").otherwise(F.col("event_type")).alias("status"), F.when(k % 4 != 0, F.col("value")).alias("progress"), F.when(k % 5 == 0, F.col("event_type")).alias("stage"))


@query("STM02_client_view", "SELECT event_id AS seq, event_type AS status FROM events WHERE user_id = 7")
def stm02(spark, d):
    return progress_events(spark, d).filter("project = 7").join(t.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind")), "seq").select("seq", F.col("kind").alias("status"))


@query("STM03_attempts", "SELECT o_orderkey AS job, CAST(a AS INTEGER) AS attempt, CAST(CASE a WHEN 1 THEN 0 WHEN 2 THEN 1000 ELSE 2000 END AS BIGINT) AS wait_ms, a = 1 + o_orderkey % 5 AS ok FROM orders, (SELECT unnest([1, 2, 3]) AS a) WHERE a <= least(1 + o_orderkey % 5, 3)")
def stm03(spark, d):
    jobs = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), (1 + F.col("o_orderkey") % 5).cast("int").alias("succeeds_at"))
    return pr.attempts(jobs).select("job", "attempt", "wait_ms", "ok")


@query("STM04_05_terminal_states", "SELECT o_orderkey AS job, CASE WHEN o_orderkey % 6 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, true AS known FROM orders")
def stm04(spark, d):
    out = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), pr.terminal(F.when(F.col("o_orderkey") % 6 == 0, 1).otherwise(0)).alias("status"))
    return out.withColumn("known", pr.known_state(F.col("status")))


@query("STM06_notifications", "SELECT o_orderkey AS job, CASE WHEN o_orderkey % 6 = 0 THEN 'update' ELSE 'done' END AS kind FROM orders")
def stm06(spark, d):
    return pr.notification(stm04(spark, d)).select("job", "kind")


@query("STM07_running_meters", f"SELECT event_id, count(*) OVER w AS n, {rd('avg(value) OVER w', 9)} AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def stm07(spark, d):
    return pr.running(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "n", rounded(F.col("mean"), 9).alias("mean"))


@query("CRD01_latest_records", "SELECT o_custkey AS id, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def crd01(spark, d):
    rows = t.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
    return pr.newest(rows, "id", "version")


@query(
    "CFG01_02_03_options",
    f"WITH {FRAMES}, k AS (SELECT k AS job, max(CASE WHEN i % 4 = 0 THEN CASE WHEN i % 8 = 0 THEN 'unclear' ELSE (i % 90 / 100.0::DOUBLE)::VARCHAR END END) AS a, max(CASE WHEN i % 4 = 1 THEN (i % 60)::VARCHAR END) AS b, max(CASE WHEN i % 4 = 2 THEN CASE WHEN i % 3 = 0 THEN 'yes' ELSE 'no' END END) AS c FROM fr GROUP BY 1) SELECT job, coalesce(TRY_CAST(a AS DOUBLE), 0.5) AS threshold, coalesce(TRY_CAST(b AS BIGINT), 30) AS min_inliers, coalesce(c = 'yes', true) AS skip_pruning, 30000::BIGINT AS iterations FROM k",
)
def cfg(spark, d):
    """Settings of jobs, some of which can't be read."""
    i = F.col("i")
    name = F.when(i % 4 == 0, "ORRERY_SEG_THRESHOLD").when(i % 4 == 1, "ORRERY_MAP_MIN_INLIERS").when(i % 4 == 2, "ORRERY_MAP_SKIP_PRUNING").otherwise("OTHER")
    text = F.when(i % 4 == 0, F.when(i % 8 == 0, "unclear").otherwise((i % 90 / 100.0).cast("string"))).when(i % 4 == 1, (i % 60).cast("string")).otherwise(F.when(i % 3 == 0, "yes").otherwise("no"))
    settings = frames(spark, d).select(F.col("k").alias("job"), name.alias("name"), text.alias("text"))
    return options.resolved(settings).select("job", "threshold", F.col("min_inliers").cast("long").alias("min_inliers"), "skip_pruning", F.col("iterations").cast("long").alias("iterations"))


@query("SRC14_sampled_cloud", f"WITH {t.POINTS} SELECT count(*) AS n FROM (SELECT * FROM points LIMIT 1500)")
def src14(spark, d):
    """At most so many points of a scene, chosen by a hash."""
    from orrery.operators.windows import hash_sample

    return hash_sample(t.points(spark, d), "point_id", 1500).agg(F.count("*").alias("n"))


@query("SNK01_points_text", f"WITH {t.POINTS} SELECT point_id, printf('%.6f', z) AS z FROM points")
def snk01(spark, d):
    path = folder(spark)
    tm.write_points(pts(spark, d), path)
    w = F.split("value", " ")
    return spark.read.text(path).select(F.get(w, F.lit(0)).cast("long").alias("point_id"), F.get(w, F.lit(3)).alias("z"))


@query("SNK02_full_model", f"WITH {t.POINTS}, {CAMS} SELECT (SELECT count(*) FROM cams) AS n_cameras, (SELECT count(*) FROM supplier) AS n_images, (SELECT count(*) FROM points) AS n_points")
def snk02(spark, d):
    a, b, e = (folder(spark) for _ in range(3))
    tm.write_cameras(cams(spark, d), a)
    tm.write_images(imgs(spark, d), b)
    tm.write_points(pts(spark, d), e)
    n = lambda df, k: df.agg(F.count("*").alias(k))
    return n(tm.cameras(spark, a), "n_cameras").crossJoin(n(tm.images(spark, b), "n_images")).crossJoin(n(tm.points(spark, e), "n_points"))


@query("SNK04_rotations", "SELECT 'im' || s_suppkey AS name, cos(s_suppkey / 8.0) > 0 AS ahead FROM supplier")
def snk04(spark, d):
    k = F.col("s_suppkey")
    path = folder(spark)
    half = k / 8.0
    tm.write_rotations(t.table(spark, d, "supplier").select(F.concat(F.lit("im"), k).alias("name"), F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.sin(half).alias("qy"), F.lit(0.0).alias("qz")), path)
    w = F.split("value", " ")
    return spark.read.text(path).select(F.get(w, F.lit(0)).alias("name"), (F.get(w, F.lit(1)).cast("double") > 0).alias("ahead"))


@query("SNK05_gaussian_ply", "SELECT count(*) AS n FROM part")
def snk05(spark, d):
    return src11(spark, d).agg(F.count("*").alias("n"))


@query("SNK10_match_tables", "SELECT l_suppkey AS a, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey % 40 AS b, l_orderkey AS f1 FROM lineitem) GROUP BY 1")
def snk10(spark, d):
    path = folder(spark)
    t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 40).alias("b"), F.col("l_orderkey").alias("f1")).distinct().write.parquet(path)
    return spark.read.parquet(path).groupBy("a").agg(F.count("*").alias("n"))


@query("SNK11_pose_results", "SELECT 'q' || s_suppkey AS name, s_suppkey / 4.0::DOUBLE AS tx FROM supplier")
def snk11(spark, d):
    path = folder(spark)
    k = F.col("s_suppkey")
    t.table(spark, d, "supplier").select(F.concat_ws(" ", F.concat(F.lit("q"), k), F.lit("1.0 0.0 0.0 0.0"), k / 4.0, F.lit("0.0 1.0")).alias("value")).write.text(path)
    w = F.split("value", " ")
    return spark.read.text(path).select(F.get(w, F.lit(0)).alias("name"), F.get(w, F.lit(5)).cast("double").alias("tx"))


@query("SNK12_versioned_edit", f"WITH {t.POINTS} SELECT 1::BIGINT AS version, CAST(sum(r) AS BIGINT) AS total FROM points UNION ALL SELECT 2, CAST(sum(255 - r) AS BIGINT) FROM points")
def snk12(spark, d):
    """An edit is written beside what it was made from, so it can be made again from the same."""
    path = folder(spark)
    t.points(spark, d).write.parquet(f"{path}/version=1")
    for _ in range(2):
        spark.read.parquet(f"{path}/version=1").withColumn("r", 255 - F.col("r")).write.mode("overwrite").parquet(f"{path}/version=2")
    return spark.read.parquet(path).groupBy(F.col("version").cast("long").alias("version")).agg(F.sum("r").alias("total"))


@query("SNK13_disparity_writers", "SELECT l_suppkey AS image, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS total, CAST(max(l_quantity) AS DOUBLE) AS most FROM (SELECT l_suppkey, l_linenumber - 1 AS y, l_orderkey % 5 AS x, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1")
def snk13(spark, d):
    """Each image's pixels become a file and are read again; what has no value is not above 0 and comes back as infinite."""
    rows = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("image"), (F.col("l_linenumber") - 1).cast("int").alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("x")).agg(F.max("l_quantity").cast("double").alias("value"))
    files = binary.images_to_pfm(rows, "image")
    path = folder(spark)
    files.write.parquet(path)
    back = binary.decode_named(spark.read.parquet(path), binary.pfm_of, "image long", "x int, y int, value double")
    return back.filter(F.col("value") < float("inf")).groupBy("image").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))


@query("SNK14_exposures", "SELECT count(*) AS n FROM supplier")
def snk14(spark, d):
    body = scenes.to_json_map(t.table(spark, d, "supplier"), "s_name", "s_acctbal", "s_nationkey")
    return body.select(F.size(F.from_json("body", "map<string,string>")).cast("long").alias("n"))


@query(
    "UDX02_03_registries",
    f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'log' WHEN 2 THEN 'sigmoid' ELSE 'squared' END AS name, {rd('CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN sign(value) * ln(1 + abs(value)) WHEN 2 THEN 1 / (1 + exp(-value)) ELSE value * value END', 5)} AS loss FROM events",
)
def udx02(spark, d):
    """A criterion chosen by name for each row."""
    registry = {"linear": lambda x: x, "log": c.signed_log1p, "sigmoid": c.sigmoid, "squared": lambda x: x * x}
    k = F.col("event_id") % 4
    name = F.when(k == 0, "linear").when(k == 1, "log").when(k == 2, "sigmoid").otherwise("squared")
    rows = t.table(spark, d, "events").select("event_id", name.alias("name"), "value")
    return rows.select("event_id", "name", rounded(options.chosen(F.col("name"), registry, F.col("value")), 5).alias("loss"))


@query("NN03_mask_gate", "WITH k AS (SELECT o_custkey AS image, o_orderkey AS mask, (o_orderkey % 100) / 100.0::DOUBLE AS dist, (o_orderkey % 67) / 67.0::DOUBLE AS area FROM orders) SELECT image, arg_max(mask, (0.6 * (1 - dist) + 0.4 * area, -mask)) AS mask FROM k WHERE area > 0.02 AND area < 0.60 GROUP BY 1")
def nn03(spark, d):
    from orrery.operators.windows import best_mask

    k = F.col("o_orderkey")
    return best_mask(t.table(spark, d, "orders").select(F.col("o_custkey").alias("image"), k.alias("mask"), ((k % 100) / 100.0).alias("dist"), ((k % 67) / 67.0).alias("area")))


@query("NN06_planner_fallback", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'json' ELSE 'rules' END AS planner FROM events")
def nn06(spark, d):
    """A plan that a model wrote as JSON, or the rules' where it wrote none."""
    from orrery.operators.edits import merge_llm_plan

    answer = F.when(F.col("event_id") % 2 == 0, F.lit('```json\n{"planner": "json"}\n```')).otherwise(F.lit("I cannot do that"))
    plan = merge_llm_plan(answer, F.struct(F.lit(None).cast("string").alias("planner")), "struct<planner:string>")
    return t.table(spark, d, "events").select("event_id", F.coalesce(plan["planner"], F.lit("rules")).alias("planner"))
