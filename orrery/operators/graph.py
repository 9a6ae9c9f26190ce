"""Operators on view graphs: pairs, components, trees, tracks and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators.state import discard, fresh_path, materialize


#: So many pairs are made in one task.
TASK_PAIRS = 1 << 22


def covisibility(observations: DataFrame, more_than: int = 2, key: str = "image_id") -> DataFrame:
    """(a, b, shared): images with the number of tracks that both see. A track lists its images once, sorted, and pairs come from that list.
    Lists are written and dealt by their first images, by the number of their pairs: Spark sizes tasks by the bytes of the lists, not by what comes of them."""
    lists = observations.groupBy("track_id").agg(F.array_sort(F.collect_set(key)).alias("s")).filter(F.size("s") > more_than)
    seen = materialize(lists.select("s", F.get("s", F.lit(0)).alias("first"), F.xxhash64("track_id").alias("place")), "lists")
    n = F.size("s").cast("long")
    pairs = seen.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0)).alias("n")).first()["n"]
    dealt = seen.repartitionByRange(int(pairs // TASK_PAIRS) + 1, "first", "place")
    first = dealt.select("s", F.posexplode("s").alias("k", "a"))
    return first.select("a", F.explode(F.expr("slice(s, k + 2, size(s))")).alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _stars(edges: DataFrame) -> bool:
    """Has every node one parent at most, and is no parent a child?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    odd = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).filter("child > 1 OR child = 1 AND parent = 1")
    return odd.isEmpty()


def _dealt(n: int):
    """Deals rows by keys to as many tasks as n edges need; few are left to Spark."""
    parts = n // TASK_EDGES
    return lambda df, *keys: df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


#: So many edges are in one task.
TASK_EDGES = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b); loops keep lonely nodes, null ends are ignored. Alternates
    large and small stars until the edges are stars: each step is a partial aggregation and an equi-join, which Spark may split
    for a node with many edges, and is written, its input deleted."""
    held = materialize(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    loops = held.filter("a = b").select("a", "b")
    now, spent = held.filter("a <> b"), None
    # many edges are dealt by their number, as Spark's number of partitions need not grow with them; no step has more of them
    dealt = _dealt(held.count())
    while not _stars(now):
        both = dealt(now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), "a")
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour of u points to the least of u's neighbourhood
        large = materialize(dealt(both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")), "a", "b").distinct(), "large")
        if spent is not None:
            discard(spent)
        if _stars(large):
            now = large
            break
        # small star: u and its smaller neighbours point to the least of these
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        linked = large.join(small, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = spent = materialize(linked.unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "small")
        discard(large)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).unionByName(loops.select(F.col("a").alias("node"), F.col("b").alias("component")))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def indexed(rows: DataFrame) -> DataFrame:
    """(id, i): ids by their rank."""
    from orrery.operators.sets import global_rank

    return materialize(global_rank(rows, "id").select("id", F.col("place").cast("long").alias("i")))


#: Complete pairs come in strips of so many j; so many places for pairs, half of them empty, are dealt to a task.
STRIP, TASK_PLACES = 256, 1 << 25


def complete_pairs(rows: DataFrame) -> DataFrame:
    """(i, j) of all j below i. There are half as many as the square of the rows, so they come in an order that takes little room where
    they are written: j stays within a strip of few values while i runs through it, so i comes in runs and j repeats one short list.
    Row by row of i, j hardly repeats within a page. Tasks are dealt by the number of pairs, not by that of i."""
    n = rows.count()
    spark = rows.sparkSession
    places = -(-n // STRIP) * n * STRIP
    at = spark.range(0, places, 1, max(places // TASK_PLACES + 1, spark.sparkContext.defaultParallelism))
    i, j = f"id div {STRIP}L % {max(n, 1)}L", f"id div {max(n, 1) * STRIP}L * {STRIP}L + id % {STRIP}L"
    return at.select(F.expr(i).alias("i"), F.expr(j).alias("j")).filter("i > j")


def _indices(rows: DataFrame) -> tuple[DataFrame, int]:
    n = rows.count()
    return rows.sparkSession.range(n).select(F.col("id").alias("i")), n


def window_pairs(rows: DataFrame, width: int, cyclic: bool) -> DataFrame:
    """(i, j) at most width apart. Cyclic windows wrap around, and meet themselves where the width reaches the number of rows."""
    i, n = _indices(rows)
    k = i.select("i", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(width).cast("long"))).alias("w"))
    if not cyclic:
        return k.filter(F.col("i") + F.col("w") < n).select("i", (F.col("i") + F.col("w")).alias("j"))
    j = (F.col("i") + F.col("w")) % n
    return k.select(F.least("i", j).alias("i"), F.greatest("i", j).alias("j")).distinct()


def log_window_pairs(rows: DataFrame, powers: int) -> DataFrame:
    i, n = _indices(rows)
    steps = F.array(*[F.lit(s * 2**k).cast("long") for k in range(powers) for s in (1, -1)])
    k = i.select("i", F.explode(steps).alias("s")).select("i", (F.col("i") + F.col("s")).alias("j")).filter((F.col("j") >= 0) & (F.col("j") < n))
    return k.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def star_pairs(rows: DataFrame, centre: int) -> DataFrame:
    i, _ = _indices(rows)
    return i.filter(F.col("i") != centre).select(F.lit(centre).alias("i"), F.col("i").alias("j"))


def retrieval_pairs(rows: DataFrame, anchors: int, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Anchors by farthest points, complete among each other; every other row (id, v) with its nearest anchor; each query with its k
    nearest rows, by default all rows."""
    from orrery.operators.joins import search
    from orrery.operators.windows import farthest_points

    held = materialize(rows.select("id", "v"))
    chosen = [r["i"] for r in farthest_points(held, anchors).collect()]
    a = rows.sparkSession.createDataFrame([(i, j) for i in chosen for j in chosen if i < j], "i long, j long")
    anchor_rows = [(r["id"], r["v"]) for r in held.filter(F.col("id").isin(chosen)).collect()]
    dot = lambda v: F.round(F.aggregate(F.zip_with("v", F.array(*map(F.lit, v)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)
    best = F.array_max(F.array(*[F.struct(dot(v).alias("s"), F.lit(-i).cast("long").alias("j")) for i, v in anchor_rows])) if anchor_rows else None
    to = held.filter(~F.col("id").isin(chosen)).select(F.col("id").alias("i"), (-best["j"]).alias("j")) if anchor_rows else a.limit(0)
    near = search(held if queries is None else queries, held, k).select("i", "j")
    every = a.unionByName(to).unionByName(near)
    return every.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("near"))


def keep_largest(edges: DataFrame) -> DataFrame:
    """(node, is_registered): whether a node is in the largest component; ties go to the component of the least node."""
    found = materialize(components(edges))
    top = found.groupBy("component").agg(F.count("*").alias("n")).agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("top"))
    return found.crossJoin(F.broadcast(top)).select("node", (F.col("component") == F.col("top")).alias("is_registered"))


def rank_components(edges: DataFrame, least: int) -> DataFrame:
    """(node, cluster_id): components by falling size from 0, -1 for those below the least size."""
    found = materialize(components(edges))
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    from orrery.operators.sets import global_rank

    ranked = global_rank(sizes.withColumn("fewer", -F.col("n")), "fewer", "component").withColumnRenamed("place", "cluster_id")
    return found.join(ranked.select("component", "cluster_id"), "component", "left").select("node", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def feature_key(image, feature):
    return F.shiftleft(image.cast("long"), 32).bitwiseOR(feature.cast("long"))


def establish_tracks(matches: DataFrame, pixels: DataFrame, apart: float) -> DataFrame:
    """(track_id, image, feature) of matches (i1, f1, i2, f2): components of features, without the tracks that hold two
    features of one image further apart than the limit. pixels: image, feature, x, y."""
    edges = matches.select(feature_key(F.col("i1"), F.col("f1")).alias("a"), feature_key(F.col("i2"), F.col("f2")).alias("b"))
    found = components(edges).select(F.col("component").alias("track_id"), F.shiftright("node", 32).alias("image"), F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)).alias("feature"))
    found = materialize(found.join(pixels, ["image", "feature"]))
    # two points of a set are more than r apart only if its box has a diagonal above r, so most images are settled by their box
    box = found.groupBy("track_id", "image").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    wide = box.filter((F.col("w") > apart) | (F.col("h") > apart)).select("track_id").distinct()
    unsure = box.filter((F.col("n") > 1) & (F.col("w") <= apart) & (F.col("h") <= apart) & (F.sqrt(F.col("w") ** 2 + F.col("h") ** 2) > apart)).select("track_id", "image")
    p = found.join(unsure, ["track_id", "image"], "left_semi")
    q = p.select("track_id", "image", F.col("feature").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    far = p.join(q, ["track_id", "image"]).filter((F.col("feature") < F.col("other")) & (F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2) > apart)).select("track_id").distinct()
    return found.join(wide.unionByName(far).distinct(), "track_id", "left_anti").select("track_id", "image", "feature")


def merged_tracks(matches: DataFrame, least: int) -> DataFrame:
    """(track, image, feature): components of features with at least so many of them, numbered from 0 by their least feature."""
    edges = matches.select(feature_key(F.col("i1"), F.col("f1")).alias("a"), feature_key(F.col("i2"), F.col("f2")).alias("b"))
    found = materialize(components(edges))
    from orrery.operators.sets import global_rank

    long = found.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("component")
    numbered = global_rank(long, "component").select("component", F.col("place").cast("long").alias("track"))
    return found.join(numbered, "component").select("track", F.shiftright("node", 32).alias("image"), F.col("node").bitwiseAND(F.lit(0xFFFFFFFF)).alias("feature"))


def maximum_spanning_tree(edges: DataFrame) -> DataFrame:
    """(a, b, w) of a maximum spanning forest, by Boruvka rounds: each component takes its heaviest outgoing edge; ties go to the least (a, b)."""
    held = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").filter("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")))
    nodes = held.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels, tree = materialize(nodes.select("node", F.col("node").alias("label"))), None
    while True:
        out = held.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la <> lb")
        ends = out.select(F.explode(F.array("la", "lb")).alias("label"), "a", "b", "w")
        best = ends.groupBy("label").agg(F.max_by(F.struct("a", "b", "w"), F.struct("w", -F.col("a"), -F.col("b"))).alias("e")).select("e.*").distinct()
        best = materialize(best)
        if best.isEmpty():
            break
        tree = best if tree is None else tree.unionByName(best)
        loops = nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))
        found = components(tree.select("a", "b").unionByName(loops))
        labels = materialize(found.select("node", F.col("component").alias("label")))
    return held.limit(0) if tree is None else tree.distinct()


def breadth_first(edges: DataFrame, root: int, banned: DataFrame | None = None) -> DataFrame:
    """(node, parent, level) from the root, level by level; the least parent of the level before is taken. Neighbours of a level are in it
    or in one next to it, so a step looks at two levels, however many there are; levels are parts of one folder."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if banned is not None:
        no = banned.unionByName(banned.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.join(no, ["a", "b"], "left_anti")
    both = materialize(both)
    spark = edges.sparkSession
    path, level = fresh_path(spark, "levels"), 0
    front = materialize(spark.createDataFrame([(root, None)], "node long, parent long"), path=f"{path}/level=0")
    near = front.select("node")
    while not front.isEmpty():
        level += 1
        reached = front.select(F.col("node").alias("a")).join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")).join(near, "node", "left_anti")
        before, front = front, materialize(reached.select("node", "parent"), path=f"{path}/level={level}")
        near = before.select("node").unionByName(front.select("node"))
    return spark.read.schema("node long, parent long, level int").parquet(path)


def chained_poses(tree: DataFrame) -> DataFrame:
    """(node, rot, shift, scale) from the root's frame, for rows (node, parent, level, rot, shift, scale) with the similarity of each node
    in its parent's frame: x -> scale * rot x + shift, rot a row-major 3 x 3. Each level is one join with the level before."""
    held = materialize(tree)
    eye = F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)])
    front = held.filter("level = 0").select("node", eye.alias("rot"), F.array(*[F.lit(0.0)] * 3).alias("shift"), F.lit(1.0).alias("scale"))
    out, level = front, 0
    while True:
        level += 1
        step = held.filter(F.col("level") == level).select("node", "parent", F.col("rot").alias("r"), F.col("shift").alias("t"), F.col("scale").alias("s"))
        at = lambda name, k: F.get(name, F.lit(k))
        turned = F.array(*[sum((at("rot", 3 * i + m) * at("r", 3 * m + j) for m in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])
        moved = F.array(*[at("shift", i) + F.col("scale") * sum((at("rot", 3 * i + m) * at("t", m) for m in range(3)), F.lit(0.0)) for i in range(3)])
        front = materialize(front.withColumnRenamed("node", "parent").join(step, "parent").select("node", turned.alias("rot"), moved.alias("shift"), (F.col("scale") * F.col("s")).alias("scale")), "poses")
        if front.isEmpty():
            return out
        out = out.unionByName(front)


def spectral_embedding(edges: DataFrame, k: int, rounds: int = 60) -> DataFrame:
    """(node, x0 .. x of k - 1): the eigenvectors of the normalised Laplacian of edges (a, b, w) with the least eigenvalues, by orthogonal
    iteration on half of identity plus normalised adjacency. A round is one join on the edges and a sum by node; what crosses the
    driver are the k x k products of the vectors. x0 belongs to the eigenvalue 0 and is set, not iterated."""
    import numpy as np

    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    scaled = both.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b").select("a", "b", (F.col("w") / F.sqrt(F.col("da") * F.col("db"))).alias("w"))
    scaled = materialize(scaled, "adjacency")
    names = [f"x{j}" for j in range(k)]
    now = materialize(degree.select("node", F.sqrt("degree").alias("x0"), *[(c.draw(F.col("node"), f"start {j} ") - 0.5).alias(f"x{j}") for j in range(1, k)]), "vectors")
    for turn in range(rounds + 1):
        products = now.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        gram = np.array([[products[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        mix = np.linalg.inv(np.linalg.cholesky(gram)).T  # Gram-Schmidt in order, so x0 stays the first
        fresh = [sum((float(mix[i, j]) * F.col(names[i]) for i in range(j + 1)), F.lit(0.0)).alias(names[j]) for j in range(k)]
        now = now.select("node", *fresh)
        if turn == rounds:
            return materialize(now, "vectors")
        pulled = scaled.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(*[F.sum(F.col("w") * F.col(x)).alias(f"y{x}") for x in names])
        spent = now
        now = materialize(spent.join(pulled, "node").select("node", *[((F.col(x) + F.col(f"y{x}")) / 2).alias(x) for x in names]), "vectors")


def ward_tree(similarities: DataFrame) -> DataFrame:
    """(a, b, d): the tree of representatives by Ward's clustering of similarities (a, b, s), s from 0 to 1; pairs without one are
    2 apart, others 1 - s. Each round merges all pairs of clusters that are nearest to each other, which gives the same tree as
    one merge after the other, as merging brings no third cluster nearer. A merged cluster is represented by the one of its two
    representatives with more similarity in all (the larger id in a tie), which takes the larger of both similarities to each node.
    Distances are a table of all pairs, as many as the method needs, and are never in one task."""
    one = similarities.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("s", F.lit(1.0)).alias("s")).filter("a <> b").groupBy("a", "b").agg(F.max("s").alias("s"))
    both = materialize(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")), "similar")
    nodes = both.select("a").distinct()
    far = nodes.join(nodes.toDF("b"), F.col("a") != F.col("b")).join(both, ["a", "b"], "left")
    d = materialize(far.select("a", "b", F.when(F.col("s") > 0, 1 - F.col("s")).otherwise(2.0).alias("d")), "distances")
    size = materialize(nodes.select(F.col("a").alias("c"), F.lit(1).cast("long").alias("n"), F.col("a").alias("rep")), "clusters")
    rows = materialize(both.select(F.col("a").alias("rep"), F.col("b").alias("node"), "s").unionByName(nodes.select(F.col("a").alias("rep"), F.col("a").alias("node"), F.lit(1.0).alias("s"))), "rows")
    tree = None

    def merged(table: DataFrame, pairs: DataFrame, of_a: DataFrame, of_b: DataFrame) -> DataFrame:
        """The distances after the clusters of column a are merged, by Ward's update."""
        new = table.join(pairs.toDF("a", "p", "dd"), "a", "left").withColumn("p", F.coalesce("p", "a"))
        new = new.join(of_a.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(of_b.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
        two = F.sqrt((F.sum((F.col("na") + F.col("nb")) * F.col("d") ** 2) - F.first("nb") * F.first("dd") ** 2) / (F.first("nb") + F.sum("na")))
        return new.groupBy(F.col("p").alias("a"), "b").agg(F.when(F.count("*") == 2, two).otherwise(F.first("d")).alias("d"))

    while True:
        nearest = d.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", "x.b", "x.d")
        back = nearest.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merges = materialize(nearest.join(back, ["a", "b"]).filter("a < b"), "merges")
        if merges.isEmpty():
            return similarities.select("a", "b", F.col("s").alias("d")).limit(0) if tree is None else tree
        # the cluster with the smaller id lives on
        pairs = merges.select("a", F.col("a").alias("p"), "d").unionByName(merges.select(F.col("b").alias("a"), F.col("a").alias("p"), "d"))
        inner = pairs.select("a", "p")
        apart = d.join(inner, "a", "left").join(inner.toDF("b", "q"), "b", "left").filter("p IS NULL OR q IS NULL OR p <> q").select("a", "b", "d")
        grown = materialize(size.join(inner.toDF("c", "p"), "c", "left").groupBy(F.coalesce("p", "c").alias("c")).agg(F.sum("n").alias("n")), "sizes")
        half = merged(apart, pairs, size, size).select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
        d = materialize(merged(half, pairs, size, grown), "distances")
        # representatives
        total = rows.groupBy("rep").agg(F.sum("s").alias("total"))
        reps = size.select("c", "rep").join(total, "rep")
        two = merges.join(reps.toDF("ra", "a", "ta"), "a").join(reps.toDF("rb", "b", "tb"), "b").select("a", "d", F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high"), "ra", "rb", "ta", "tb")
        two = materialize(two.withColumn("best", F.when(F.col("ta") > F.col("tb"), F.col("ra")).when(F.col("tb") > F.col("ta"), F.col("rb")).otherwise(F.col("high"))), "two")
        found = two.select(F.col("low").alias("a"), F.col("high").alias("b"), "d")
        tree = found if tree is None else tree.unionByName(found)
        now = two.select(F.col("low").alias("rep"), "best").unionByName(two.select(F.col("high").alias("rep"), "best"))
        rows = materialize(rows.join(now, "rep", "left").groupBy(F.coalesce("best", "rep").alias("rep"), "node").agg(F.max("s").alias("s")), "rows")
        size = materialize(grown.join(two.select(F.col("a").alias("c"), "best"), "c", "left").join(size.select("c", "rep"), "c").select("c", "n", F.coalesce("best", "rep").alias("rep")), "clusters")


def tour(tree: DataFrame, start: int) -> tuple[DataFrame, int]:
    """(a, b, pos, back) of both arcs of each edge of start's tree, and their number: the places of an arc and of its way back on a
    walk around the tree, which comes back to start. After an arc to b follows the arc out of b that is next after the way back, in a
    circle. Places are found by doubling: each round an arc learns what follows twice as far, so rounds grow with the logarithm
    of the arcs, not with the depth. Arcs of other trees never meet the end and go."""
    from orrery.operators.sets import global_rank

    arcs = tree.select("a", "b").unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    out = materialize(global_rank(arcs, "a", "b").select("a", "b", F.col("place").cast("long").alias("arc")), "arcs")
    bounds = out.groupBy("a").agg(F.min("arc").alias("low"), F.max("arc").alias("high"))
    back = out.join(bounds, "a").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("arc").alias("back"), F.when(F.col("arc") < F.col("high"), F.col("arc") + 1).otherwise(F.col("low")).alias("next"))
    held = materialize(out.join(back, ["a", "b"]), "arcs")
    n, first = held.agg(F.count("*"), F.min(F.when(F.col("a") == start, F.col("arc")))).first()
    end = F.coalesce(F.col("next") == first, F.lit(False))
    now = materialize(held.select("arc", F.when(~end, F.col("next")).alias("next"), F.when(end, 0).otherwise(1).cast("long").alias("left")), "places")
    for _ in range((n - 1).bit_length() if n else 0):
        # arcs at the end wait, so that no key is null and each is one arc's
        step = now.filter("next IS NOT NULL").toDF("arc", "at", "so_far").join(now.withColumnRenamed("arc", "at"), "at")
        spent, now = now, materialize(now.filter("next IS NULL").unionByName(step.select("arc", "next", (F.col("so_far") + F.col("left")).alias("left"))), "places")
        discard(spent)
    done = now.filter("next IS NULL").select("arc", "left")
    met = materialize(held.join(done, "arc").join(done.toDF("back", "back_left"), "back").select("a", "b", "left", "back_left"), "tour")
    n = met.count()
    return met.select("a", "b", (n - 1 - F.col("left")).alias("pos"), (n - 1 - F.col("back_left")).alias("back")), n


#: So many arcs of a tour are summed in one task.
TASK_ARCS = 1 << 16


def tree_from(arcs: DataFrame, n: int, root: int) -> DataFrame:
    """(node, parent, level, enter, leave) of all nodes but the root, from the n arcs of a tour. Started at the root, the tour goes down an
    edge before it comes back; levels are its running sums, within pieces of the tour and over the pieces' sums."""
    first = arcs.filter(F.col("a") == root).agg(F.min("pos")).first()[0]
    turned = arcs.select("a", "b", *[F.pmod(F.col(k) - first, F.lit(n)).alias(k) for k in ("pos", "back")])
    steps = turned.withColumn("step", F.when(F.col("pos") < F.col("back"), 1).otherwise(-1)).withColumn("piece", F.floor(F.col("pos") / TASK_ARCS))
    within = steps.withColumn("own", F.sum("step").over(Window.partitionBy("piece").orderBy("pos")))
    # one row for each piece
    sums = steps.groupBy("piece").agg(F.sum("step").alias("sum"))
    before = sums.select("piece", F.coalesce(F.sum("sum").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    levels = within.filter("step = 1").join(before, "piece").withColumn("level", (F.col("before") + F.col("own")).cast("int"))
    return levels.select(F.col("b").alias("node"), F.col("a").alias("parent"), "level", F.col("pos").alias("enter"), F.col("back").alias("leave"))


def centred_tree(tree: DataFrame) -> DataFrame:
    """The tree as (node, parent, level) from its centre: the middle of its longest path, which leads from the node that is farthest
    from any start to the farthest one from there. Of a forest, it is the tree of the least a."""
    held = materialize(tree.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    start = held.agg(F.min("a")).first()[0]
    spark, columns = tree.sparkSession, "node long, parent long, level int"
    if start is None:
        return spark.createDataFrame([], columns)
    arcs, n = tour(held, start)
    if not n:
        return spark.createDataFrame([(start, None, 0)], columns)
    farthest = lambda walk: walk.agg(F.max_by(F.struct("node", "level", "enter"), F.struct("level", -F.col("node"))).alias("x")).select("x.*").first()
    walk = materialize(tree_from(arcs, n, farthest(tree_from(arcs, n, start))["node"]))
    last = farthest(walk)
    # its ancestors are entered before it and left after it
    middle = walk.filter((F.col("level") == last["level"] - last["level"] // 2) & (F.col("enter") <= last["enter"]) & (F.col("leave") > last["enter"])).first()["node"]
    root = spark.createDataFrame([(middle, None, 0)], columns)
    return root.unionByName(tree_from(arcs, n, middle).select("node", "parent", "level"))


def sparsify(edges: DataFrame, expected: int, strength: float) -> DataFrame:
    """Edges stay if one end has few edges, and else by a hash with the chance strength * mean degree / (ka * kb)."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("k"))
    mean = degree.agg(F.avg("k").alias("mean"))
    both = edges.join(degree.toDF("a", "ka"), "a").join(degree.toDF("b", "kb"), "b").crossJoin(F.broadcast(mean))
    draw = c.draw(F.concat_ws(" ", "a", "b"))
    return both.filter((F.col("ka") <= expected) | (F.col("kb") <= expected) | (draw < strength * F.col("mean") / (F.col("ka") * F.col("kb"))))


def strong_clusters(edges: DataFrame, threshold: float, rounds: int = 10) -> DataFrame:
    """(node, cluster): components of strong edges; then clusters with two edges of three quarters of that between them merge."""
    held = materialize(edges)
    nodes = held.select(F.explode(F.array("a", "b")).alias("node")).distinct().select(F.col("node").alias("a"), F.col("node").alias("b"))
    links = held.filter(F.col("w") > threshold).select("a", "b").unionByName(nodes)
    labels = materialize(components(links))
    for _ in range(rounds):
        two = held.filter(F.col("w") >= 0.75 * threshold).join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la <> lb")
        merge = materialize(two.groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("n")).filter("n >= 2").select("a", "b"))
        if merge.isEmpty():
            break
        up = components(merge).toDF("component", "top")
        labels = materialize(labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component")))
    return labels.select("node", F.col("component").alias("cluster"))


def prune_weak(observations: DataFrame, least: int) -> DataFrame:
    """(node, cluster): images clustered by shared points, with the limit from the upper median and deviation of all weights."""
    from orrery.operators.aggregates import median_mad

    w = materialize(covisibility(observations).filter(F.col("shared") >= least).select("a", "b", F.col("shared").cast("double").alias("w")))
    row = median_mad(w, "w", 20.0).first()
    return strong_clusters(w, row["threshold"] if row and row["threshold"] is not None else 20.0)


def fixed_offsets(frames: DataFrame, n: int, most: int, step: int) -> DataFrame:
    """(sequence, i, j) of the first n frames (sequence, frame) of each sequence by rank: pairs whose ranks differ by a multiple of step, most at most."""
    ranked = frames.withColumn("i", F.row_number().over(Window.partitionBy("sequence").orderBy("frame")).cast("long") - 1).filter(F.col("i") < n)
    held = ranked.groupBy("sequence").agg(F.count("*").alias("held"))
    pairs = ranked.join(held, "sequence").select("sequence", "i", "held", F.explode(F.sequence(F.lit(step).cast("long"), F.lit(most).cast("long"), F.lit(step).cast("long"))).alias("s"))
    return pairs.select("sequence", "i", (F.col("i") + F.col("s")).alias("j"), "held").filter(F.col("j") < F.col("held")).drop("held")


def largest_region(pixels: DataFrame) -> DataFrame:
    """(image, n): size of the largest 8-connected region of each image. pixels: image, x, y."""
    key = lambda x, y: (F.col("image") * (1 << 40) + y * (1 << 20) + x)
    px = materialize(pixels.withColumn("k", key(F.col("x"), F.col("y"))), "pixels")
    dealt = _dealt(4 * px.count())
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (-1, 1))])
    near = px.select("image", "k", F.explode(steps).alias("s"), "x", "y").select(F.col("k").alias("a"), key(F.col("x") + F.col("s.dx"), F.col("y") + F.col("s.dy")).alias("b"))
    edges = dealt(near, "b").join(dealt(px.select(F.col("k").alias("b")), "b"), "b", "left_semi").unionByName(px.select(F.col("k").alias("a"), F.col("k").alias("b")))
    n = components(edges).groupBy("component").agg(F.count("*").alias("n"))
    return n.select(F.floor(F.col("component") / (1 << 40)).alias("image"), "n").groupBy("image").agg(F.max("n").alias("n"))
