"""Known answers and properties of operators that SQL doesn't check."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators import aggregates as a
from orrery.operators import edits, graph, images, joins, options, sets, spatial, windows
from orrery.sources import binary, scenes
from orrery.streaming import progress


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


def cloud(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(k, r.uniform(0, 10), r.uniform(0, 10), r.uniform(0, 10)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "point_id long, x double, y double, z double")


def test_visibility_truncates(spark):
    v = lambda u: c.visible(F.lit(u), F.lit(1.0), F.lit(1.0), 10, 10)
    r = one(spark, inside=v(-0.5), out=v(-1.5), edge=v(9.99), past=v(10.0), behind=c.visible(F.lit(1.0), F.lit(1.0), F.lit(0.01), 10, 10))
    assert (r.inside, r.out, r.edge, r.past, r.behind) == (True, False, True, False, False)


def test_hsv_of_grey_has_two_variants(spark):
    grey = [F.lit(128)] * 3
    r = one(spark, h=c.hsv(*grey)[0], raw=c.hsv(*grey, False)[0])
    assert r.h == 0 and abs(r.raw - 4 / 6) < 1e-6


def test_compositing(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 0.5, 1.0), (0, 2, 2.0, 0.5, 0.5), (0, 3, 3.0, 0.9, 0.2)], "tile int, id int, depth double, alpha double, c double")
    r = windows.composite(rows).first()
    assert abs(r.colour - 0.67) < 1e-9 and abs(r.rest - 0.025) < 1e-9


def test_compositing_drops_what_crosses_the_cutoff(spark):
    rows = spark.createDataFrame([(0, k, float(k), 0.99, 1.0) for k in range(4)] + [(0, 9, 9.0, 0.1, 1.0)], "tile int, id int, depth double, alpha double, c double")
    assert windows.composite(rows).first().n == 2  # two leave just 1e-4, the third would leave less


def test_moving_average(spark):
    rows = spark.createDataFrame([(0, k, float(k)) for k in (1, 2, 3)], "k int, i int, v double")
    assert abs(windows.ema(rows, "k", ["i"], "v", 0.4).first().ema - 1.824) < 1e-9


@pytest.mark.parametrize("prompt, colour, texture, geometry", [
    ("make it bright red", ["recolour", "brightness"], [], []),
    ("tint it red", ["recolour", "tint"], [], []),
    ("metallic gold", ["metallic"], [], []),
    ("rotate 90 degrees clockwise", [], [], [("rotate_y", -90.0)]),
    ("scale down by 2", [], [], [("scale_uniform", 2.0)]),
    ("desaturate", [], [], []),
    ("rusty", [], [], []),
    (None, [], [], []),
])
def test_prompts(spark, prompt, colour, texture, geometry):
    p = edits.parse(spark, prompt)
    assert ([x["type"] for x in p["colour"]], list(p["texture"]), [(x["type"], x["amount"]) for x in p["geometry"]]) == (colour, texture, geometry)


def test_plan_keeps_the_centroid(spark):
    rows, points = cloud(spark, 60)
    points = points.withColumns({k: F.lit(100) for k in "rgb"})
    out = edits.apply(points, edits.parse(spark, "scale up by 2 and rotate 45 degrees and make it blue"))
    m = out.agg(F.avg("x"), F.avg("y"), F.avg("z")).first()
    assert np.allclose(list(m), np.mean([r[1:] for r in rows], axis=0))
    assert out.select("r").distinct().count() == 1


def test_nearest_is_brute_force(spark):
    rows, points = cloud(spark, 150)
    got = {(r.a, r["rank"]): r.b for r in joins.nearest(points, points, 4, 0.3, skip_self=True).collect()}
    xyz = np.array([r[1:] for r in rows])
    for k in range(len(rows)):
        d2 = ((xyz - xyz[k]) ** 2).sum(1)
        d2[k] = np.inf
        assert [got[k, j + 1] for j in range(4)] == np.lexsort((np.arange(len(rows)), d2))[:4].tolist()


def test_dbscan(spark):
    rows = [(k, 0.1 * k, 0.0, 0.0) for k in range(6)] + [(k, 50 + 0.1 * k, 0.0, 0.0) for k in range(6, 12)] + [(99, 200.0, 0.0, 0.0)]
    got = {r.point_id: r.cluster for r in spatial.dbscan(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 0.25, 3).collect()}
    assert got == {**{k: 0 for k in range(6)}, **{k: 6 for k in range(6, 12)}, 99: -1}


def test_components_and_tree(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80), float(r.randrange(1, 1000))) for _ in range(70)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    got = {x.node: x.component for x in graph.components(df.select("a", "b")).collect()}
    parent = {}

    def find(x, p=parent):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    best = {}
    for p, q, w in sorted(edges, key=lambda e: -e[2]):
        if find(p) != find(q):
            parent[max(find(p), find(q))] = min(find(p), find(q))
            best[p, q] = w
    assert got == {x: find(x) for x in list(parent)}
    assert graph.maximum_spanning_tree(df).agg(F.sum("w")).first()[0] == sum(best.values())


def walked(edges, root):
    """{node: (parent, level)}, each with the least parent of the level before."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, front = {root: (None, 0)}, [root]
    while front:
        level, found = seen[front[0]][1] + 1, {}
        for a in sorted(front):
            for b in near.get(a, ()):
                if b not in seen:
                    found.setdefault(b, (a, level))
        seen, front = {**seen, **found}, list(found)
    return seen


def centred(edges):
    """The same from the middle of the longest path, by three walks."""
    farthest = lambda seen: min(seen, key=lambda v: (-seen[v][1], v))
    seen = walked(edges, farthest(walked(edges, min(a for a, _ in edges))))
    node = farthest(seen)
    for _ in range(seen[node][1] // 2):
        node = seen[node][0]
    return walked(edges, node)


def test_centred_tree_against_three_walks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_ARCS", 16)
    r = random.Random(5)
    grown = [(r.randrange(max(0, k - 3), k), k) for k in range(1, 30)]
    trees = {"one": [(3, 9)], "star": [(7, k) for k in range(20) if k != 7], "forest": grown + [(50 + a, 50 + b) for a, b in grown], "path": [(k, k + 1) for k in range(64)]}
    for name, edges in trees.items():
        spark.sparkContext.setJobGroup(f"centred {name}", name)
        got = {x.node: (x.parent, x.level) for x in graph.centred_tree(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == centred(edges), name
    # a path of 64 edges takes as many jobs as any tree of its size, not one or more for each level
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("centred path")) < 100
    spark.sparkContext.setJobGroup("", "")
    for edges, want in (([], {}), ([(4, 4)], {4: (None, 0)})):
        assert {x.node: (x.parent, x.level) for x in graph.centred_tree(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_breadth_first_reads_its_levels_at_once(spark):
    r = random.Random(8)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(75)] + [(0, 0), (0, 1), (1, 2)]
    df = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = graph.breadth_first(df(edges), 0, df([(1, 0)]))
    assert {x.node: (x.parent, x.level) for x in got.collect()} == walked([e for e in edges if set(e) != {0, 1}], 0)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tracks_with_far_features_go(spark):
    matches = spark.createDataFrame([(1, 0, 2, 0), (1, 1, 2, 0), (3, 0, 4, 0)], "i1 long, f1 long, i2 long, f2 long")
    pixels = spark.createDataFrame([(i, f, 20.0 * f, 0.0) for i in range(5) for f in range(2)], "image long, feature long, x double, y double")
    got = {(r.image, r.feature) for r in graph.establish_tracks(matches, pixels, 10.0).collect()}
    assert got == {(3, 0), (4, 0)}


def test_window_pairs(spark):
    ids = lambda n: spark.range(n)
    assert graph.complete_pairs(ids(4)).count() == 6
    assert graph.window_pairs(ids(5), 3, False).count() == 9
    assert graph.window_pairs(ids(5), 3, True).count() == 10
    assert graph.window_pairs(ids(3), 3, True).count() == 6  # with pairs of itself


def test_complete_pairs_repeat_few_values_within_a_page(spark):
    assert {n: sorted(map(tuple, graph.complete_pairs(spark.range(n)).collect())) for n in (0, 1, 2, 257)} == {n: [(i, j) for i in range(n) for j in range(i)] for n in (0, 1, 2, 257)}
    n, page = 3000, 20_000
    pairs = graph.complete_pairs(spark.range(n)).withColumn("task", F.spark_partition_id()).withColumn("page", F.floor((F.monotonically_increasing_id() % (1 << 33)) / page))
    pages = pairs.groupBy("task", "page").agg(F.count_distinct("i").alias("i"), F.count_distinct("j").alias("j"), F.count("*").alias("n"))
    most = pages.agg(F.max(F.col("i") + F.col("j")), F.sum("n")).first()
    assert most[0] <= 2 * graph.STRIP + 2 * page // graph.STRIP and most[1] == n * (n - 1) // 2


def test_ssim_of_equal_images_is_one():
    img = np.random.default_rng(0).random((16, 16))
    assert abs(images.structural_similarity(img, img) - 1) < 1e-12


def test_rank_and_prefix_sums_over_partitions(spark):
    df = spark.range(1000).repartition(7)
    got = sorted((r.id, r.place) for r in sets.global_rank(df, "id").collect())
    assert got == [(k, k) for k in range(1000)]
    assert all(r.start == r.id * (r.id - 1) // 2 for r in windows.prefix_sum(df.withColumn("v", F.col("id")), "id", "v").collect())


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert a.upper_median(df, "v", "m").first().m == 3.0


def test_binary_round_trips():
    cameras = [{"camera_id": 3, "model": 1, "width": 640, "height": 480, "params": [1.0, 2.0, 3.0, 4.0]}]
    assert list(binary.cameras_of(binary.bytes_of_cameras(cameras))) == cameras
    points = [{"point_id": 9, "x": 1.5, "y": 2.0, "z": -1.0, "r": 1, "g": 2, "b": 3, "error": 0.5, "track": [{"image_id": 1, "point2d_idx": 2}]}]
    assert list(binary.points_of(binary.bytes_of_points(points))) == points
    image = np.arange(6, dtype="f4").reshape(2, 3)
    assert [r["value"] for r in binary.pfm_of(binary.bytes_of_pfm(image))] == [float("inf"), 1, 2, 3, 4, 5]
    assert [r["v"] for r in binary.flo_of(binary.bytes_of_flo(np.stack([image, image + 1], -1)))] == [1, 2, 3, 4, 5, 6]


def test_ply_ascii_and_schema(spark, tmp_path):
    (tmp_path / "a.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float f_rest_10\nproperty float f_rest_2\nend_header\n1 2 3\n4 5 6\n")
    rows = binary.read_ply(spark, str(tmp_path)).orderBy("vertex")
    assert rows.columns == ["path", "vertex", "x", "f_rest_2", "f_rest_10"]
    assert [(r.x, r.f_rest_2) for r in rows.collect()] == [(1, 3), (4, 6)]


def test_project_detection_order():
    assert scenes.detect(["sparse", "transforms.json"]) == "transforms.json"
    assert scenes.detect([]) is None


def test_options():
    o = options.Options.from_environment({"ORRERY_SEG_THRESHOLD": "0.65", "ORRERY_TRAIN_ITERATIONS": "many", "ORRERY_MAP_SKIP_PRUNING": "no"})
    assert (o.segmentation.threshold, o.training.iterations, o.mapper.skip_pruning) == (0.65, 30_000, False)


def test_stream_folds_like_batch(spark, tmp_path):
    schema = "project long, seq long, status string, progress double, stage string"
    batches = [[(1, 1, "PENDING", 10.0, "a"), (2, 1, "PENDING", None, None)], [(1, 2, None, 0.0, ""), (2, 2, "FAILED", 5.0, "z")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}

    def keep(df, _):
        seen.update({r.project: (r.status, r.progress, r.stage) for r in df.collect()})

    progress.stream(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    every = [r for rows in batches for r in rows]
    want = {r.project: (r.status, r.progress, r.stage) for r in progress.latest(spark.createDataFrame(every, schema)).collect()}
    assert seen == want == {1: ("PENDING", 0.0, "a"), 2: ("FAILED", 5.0, "z")}


def test_ward_tree_against_one_merge_after_the_other(spark):
    import random

    r = random.Random(6)
    n = 14
    s = {(i, j): r.random() for i in range(n) for j in range(i) if r.random() < 0.6}
    sim = lambda i, j: 1.0 if i == j else s.get((max(i, j), min(i, j)), 0.0)
    d = {frozenset((i, j)): 1 - sim(i, j) if sim(i, j) else 2.0 for i in range(n) for j in range(i)}
    size, rep = dict.fromkeys(range(n), 1), {i: i for i in range(n)}
    rows, want, fresh = {i: [sim(i, j) for j in range(n)] for i in range(n)}, set(), n
    while len(size) > 1:
        pair = min(d, key=d.get)
        i, j = pair
        for k in size:
            if k not in pair:
                a, b = d.pop(frozenset((i, k))), d.pop(frozenset((j, k)))
                d[frozenset((fresh, k))] = (((size[k] + size[i]) * a**2 + (size[k] + size[j]) * b**2 - size[k] * d[pair] ** 2) / (size[i] + size[j] + size[k])) ** 0.5
        p, q = rep.pop(i), rep.pop(j)
        want.add((min(p, q), max(p, q), round(d.pop(pair), 6)))
        best = p if sum(rows[p]) > sum(rows[q]) else q if sum(rows[q]) > sum(rows[p]) else max(p, q)
        rows[best] = [max(x, y) for x, y in zip(rows[p], rows[q])]
        size[fresh], rep[fresh] = size.pop(i) + size.pop(j), best
        fresh += 1
    found = graph.ward_tree(spark.createDataFrame([(i, j, x) for (i, j), x in s.items()], "a long, b long, s double")).collect()
    assert {(x.a, x.b, round(x.d, 6)) for x in found} == want


def crowd(spark, n=200, places=5):
    """n copies in each of some places, ids dealt over them, and single points beside them."""
    rows = [(k, float(k % places), 0.0, 0.0) for k in range(n * places)] + [(100_000 + k, 0.3 * k, 1.0 + k % 3, 0.5) for k in range(40)]
    return rows, spark.createDataFrame(rows, "point_id long, x double, y double, z double").repartition(3, "point_id")


def counted(monkeypatch, module):
    """Rows of pairs that a search makes."""
    found, inner = [], joins.near_pairs

    def pairs(*args):
        out = inner(*args)
        found.append(out.count())
        return out

    monkeypatch.setattr(module, "near_pairs", pairs)
    return found


def test_nearest_of_copies(spark, monkeypatch):
    rows, points = crowd(spark)
    pairs = counted(monkeypatch, joins)
    got = {(r.a, r["rank"]): r.b for r in joins.nearest(points, points, 4, 0.5, skip_self=True).collect()}
    ids, xyz = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    for k in range(len(rows)):
        d2 = ((xyz - xyz[k]) ** 2).sum(1)
        d2[k] = np.inf
        assert [got[ids[k], j + 1] for j in range(4)] == ids[np.lexsort((ids, d2))[:4]].tolist()
    assert len(got) == 4 * len(rows)
    # not the 200 * 200 pairs of each place
    assert max(pairs) < 20_000


def test_neighbours_are_not_collected_on_the_driver(spark):
    _, points = crowd(spark)
    assert "Broadcast" not in joins.near_pairs(points, points, 1.0)._jdf.queryExecution().executedPlan().toString()


def test_edits_of_copies(spark, monkeypatch):
    rows, points = crowd(spark)
    points = points.withColumn("r", F.col("point_id") % 256)
    edited = points.filter("point_id % 4 = 0").select("point_id", (F.col("x") + 0.1).alias("x"), "y", "z", (255 - F.col("r")).alias("r"), (F.col("point_id") % 3).alias("seq"))
    pairs = counted(monkeypatch, spatial)
    got = {r.point_id: r.r for r in spatial.merge_edited(points, edited, 0.5).collect()}
    for k, *at in rows:
        near = [(e % 3, e, 255 - e % 256) for e, *to in rows if e % 4 == 0 and (at[0] - to[0] - 0.1) ** 2 + (at[1] - to[1]) ** 2 + (at[2] - to[2]) ** 2 <= 0.25]
        assert got[k] == (max(near)[2] if near else k % 256)
    assert len(got) == len(rows) and max(pairs) < 2_000


def test_dbscan_of_copies(spark, monkeypatch):
    rows = [(k, float(k % 2) * 50, 0.0, 0.0) for k in range(400)] + [(1000, 0.2, 0.0, 0.0), (1001, 90.0, 0.0, 0.0), (1002, 90.0, 0.0, 0.0), (1003, None, 0.0, 0.0)]
    pairs = counted(monkeypatch, spatial)
    got = {r.point_id: r.cluster for r in spatial.dbscan(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 0.25, 3).collect()}
    # copies count as neighbours of each other: 200 make a core, two don't
    assert got == {**{k: k % 2 for k in range(400)}, 1000: 0, 1001: -1, 1002: -1, 1003: -1}
    assert max(pairs) < 20


def test_scale_of_exactly_the_limit(spark):
    """In SQL exp(ln(0.05)) is above 0.05, and exp(ln(0.3)) is not above 0.3."""
    from orrery.operators import splats

    rows = spark.createDataFrame([(1, np.log(0.05).item(), 1.0), (2, np.nextafter(np.log(0.05), -9).item(), 1.0)], "id long, s0 double, grad double").withColumns({"s1": F.lit(-9.0), "s2": F.lit(-9.0)})
    assert sorted((r.id, r.kind) for r in splats.densify(rows, 0.5, 0.05, 2).collect()) == [(1, "split"), (1, "split"), (2, "clone"), (2, "keep")]
    assert [r.x for r in rows.select(splats.above(0.3).alias("x"), F.lit(1)).limit(1).collect()] == [False]
    assert rows.limit(1).withColumn("s0", F.lit(float(np.log(0.3)))).select(splats.above(0.3).alias("x")).first().x is False


def test_files_hold_few_rows(spark):
    cams = spark.range(12_000).repartition(1).select(F.col("id").cast("int").alias("camera_id"), F.lit(1).alias("model"), F.lit(4).cast("long").alias("width"), F.lit(3).cast("long").alias("height"), F.array(*[F.lit(1.0)] * 4).alias("params"))
    files = binary.encode(cams, binary.bytes_of_cameras)
    assert files.count() >= 12_000 // binary.FILE_ROWS
    got = binary.decode(files, binary.cameras_of, "camera_id int, model int, width long, height long, params array<double>")
    assert got.select("camera_id").distinct().count() == got.count() == 12_000


def test_detections_pass_by(spark):
    r = random.Random(5)
    rows = [(i, d, g, (d * 7 % 5) / 5.0, r.randrange(10) / 10.0) for i in range(6) for d in range(12) for g in range(100, 109)] + [(0, 50, 100, float("nan"), 0.9), (0, 51, 101, 0.9, float("nan"))]
    df = spark.createDataFrame(rows, "image long, det long, gt long, score double, iou double").repartition(5)
    want = []
    for i in range(6):
        taken = set()
        for d in sorted({x[1] for x in rows if x[0] == i}, key=lambda d: min((x[3] != x[3], -x[3], d) for x in rows if x[0] == i and x[1] == d)):
            free = sorted((-x[4], x[2]) for x in rows if x[0] == i and x[1] == d and x[4] >= 0.3 and x[2] not in taken)
            if free:
                taken.add(free[0][1])
                want.append((i, d, free[0][1]))
    got = images.match_detections(df, 0.3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # no call of Python for each image
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


def test_quota_passes_by(spark):
    r = random.Random(6)
    seen = sorted({(t, r.randrange(40)) for t in range(300) for _ in range(3 + t % 9)})
    by = {t: {i for u, i in seen if u == t} for t in range(300)}
    order = sorted((t for t in by if len(by[t]) >= 3), key=lambda t: (-len(by[t]), -t))
    have, want, every = {}, [], {i for t in order for i in by[t]}
    for t in order:
        if all(have.get(i, 0) > 4 for i in every) or len(want) > 30:
            break
        if not all(have.get(i, 0) > 4 for i in by[t]):
            want.append(t)
            have |= {i: have.get(i, 0) + 1 for i in by[t]}
    got = windows.quota_selection(spark.createDataFrame(seen, "track_id long, image_id long").repartition(4), 4, 3, 30)
    assert sorted({x.track_id for x in got.collect()}) == sorted(want)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_a_search_are_bounded():
    assert joins.QUERY_BLOCK * joins.MEET * 8 <= 16 << 20


def test_counts_in_boxes_of_copies(spark, monkeypatch):
    points = spark.range(600).select("id", (F.col("id") % 2).alias("sheet"), (F.col("id") % 3 / 1.0).alias("x"), F.lit(0.5).alias("y"))
    boxes = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 4).alias("sheet"), F.lit(0.0).alias("ax0"), F.lit(0.0).alias("ay0"), F.lit(2.0).alias("ax1"), F.lit(1.0).alias("ay1"))
    rows, inner = [], joins.points_in_boxes
    monkeypatch.setattr(joins, "points_in_boxes", lambda *x: rows.append(inner(*x).count()) or inner(*x))
    got = {r.a: r.n for r in joins.counts_in_boxes(boxes, points, 1.0, ["sheet"]).collect()}
    assert got == {k: 200 for k in range(100) if k % 4 < 2}
    # two sheets, one kind of box, two places in it: not 50 * 200 pairs
    assert rows == [4]


def test_info_nce_sums_blocks_of_rows(spark, monkeypatch):
    """Against numpy, over many blocks, with ids that repeat, without a vector, with a null and with fewer components: a null counts as nothing."""
    import numpy as np
    from orrery.operators import joins, splats

    monkeypatch.setattr(splats, "LOSS_ROWS", 16)
    monkeypatch.setattr(joins, "QUERY_BLOCK", 4)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(90, 3)), 3)
    x[7, 1], x[8, 2], x[20, 1], x[30, 2] = 0, 0, 0, 0
    vectors = x.tolist()
    vectors[7][1], vectors[20][1] = None, None
    vectors[8], vectors[30] = vectors[8][:2], vectors[30][:2]
    ids = [k if k != 41 else 40 for k in range(90)]
    df = spark.createDataFrame([*zip(ids, vectors), (50, None), (None, [1.0, 2.0, 3.0])], "id long, v array<double>").repartition(5)
    x, ids = np.concatenate([x, [[1, 2, 3]]]), np.array([*ids, -1])
    each = []
    for i in range(0, 90, 10):
        of = ids == i
        s = np.round(x[of] @ x.T, 6) / 2
        each.append(np.log(np.exp(s).sum()) - s[:, of].max())
    got = splats.info_nce(df.filter("id % 10 = 0"), df, 2.0).first()["loss"]
    assert abs(got - np.mean(each)) < 1e-9
    assert splats.info_nce(df.limit(0), df, 2.0).first()["loss"] is None


def test_covisible_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from collections import Counter
    from itertools import combinations

    monkeypatch.setattr(graph, "TASK_PAIRS", 500)
    tracks = {k: sorted({(k * 7 + j * (k % 3 + 1)) % 90 for j in range(40)}) for k in range(6)} | {9: [1, 2]}
    obs = spark.createDataFrame([(k, i) for k, images in tracks.items() for i in [*images, images[0]]], "track_id long, image_id long")
    found = graph.covisibility(obs, 2)
    want = Counter(pair for images in tracks.values() if len(images) > 2 for pair in combinations(images, 2))
    assert {(r.a, r.b): r.shared for r in found.collect()} == want
    n = sum(want.values()) // 500 + 1
    assert n > 5 and f", {n}\n" in found._jdf.queryExecution().optimizedPlan().toString()
    assert graph.covisibility(obs.limit(0), 2).isEmpty()


def test_many_edges_are_dealt_by_their_number(spark, monkeypatch):
    """Regions and components are the same when Spark's own number of partitions is not used, and then no task has more rows than meant."""
    px = spark.createDataFrame([(i, x, y) for i in range(3) for x in range(12) for y in range(12) if (x * 5 + y * 3 + i) % 4 < 2], "image long, x long, y long")
    want = {(r.image, r.n) for r in graph.largest_region(px).collect()}
    written, keep = {}, graph.materialize
    monkeypatch.setattr(graph, "TASK_EDGES", 16)
    monkeypatch.setattr(graph, "materialize", lambda df, what="state": written.setdefault(what, df) and keep(df, what))
    assert {(r.image, r.n) for r in graph.largest_region(px).collect()} == want
    n = 4 * px.count() // 16
    assert f", {n}\n" in written["edges"]._jdf.queryExecution().optimizedPlan().toString() and "RepartitionByExpression" in written["large"]._jdf.queryExecution().optimizedPlan().toString()
