"""Ordered operators: top rows, strides, prefix sums, compositing, averages, samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import columns as c
from orrery.operators.joins import small
from orrery.operators.sets import global_rank
from orrery.operators.state import materialize


def top_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps only n rows of a key in a task before it shuffles."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def top_share(rows: DataFrame, key: str, order: list, share: float) -> DataFrame:
    n = rows.groupBy(key).agg(F.floor(share * F.count("*")).alias("most"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.join(n, key).filter("rn <= most").drop("rn", "most")


def stride(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Up to n rows of each key, a fixed step apart."""
    by = Window.partitionBy(key)
    k = rows.withColumn("i", F.row_number().over(by.orderBy(order)) - 1).withColumn("step", F.greatest(F.floor(F.count("*").over(by) / n), F.lit(1)))
    return k.filter((F.col("i") % F.col("step") == 0) & (F.floor(F.col("i") / F.col("step")) < n)).drop("i", "step")


def even_frames(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """n rows of each key at rounded, evenly spaced ranks."""
    by = Window.partitionBy(key)
    k = rows.withColumn("i", (F.row_number().over(by.orderBy(order)) - 1).cast("long"))
    total = rows.groupBy(key).agg(F.count("*").alias("total"))
    spots = total.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"), "total").select(key, F.rint(F.col("j") * ((F.col("total") - 1) / float(n - 1))).cast("long").alias("i")).distinct()
    return k.join(spots, [key, "i"], "left_semi").drop("i")


def prefix_sum(rows: DataFrame, order: str, value: str) -> DataFrame:
    """Adds start: the sum of value over all rows before, by sums of range partitions and sums within them."""
    spread = materialize(rows.repartitionByRange(order).withColumn("chunk", F.spark_partition_id()))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = spread.groupBy("chunk").agg(F.sum(value).alias("n"))
    # one row for each range partition
    before = sums.select("chunk", F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return spread.withColumn("start", own).join(F.broadcast(before), "chunk").withColumn("start", (F.col("start") + F.col("before")).cast("long")).drop("chunk", "before")


def cumulative_lookup(queries: DataFrame, parts: DataFrame) -> DataFrame:
    """queries (id, at) by the part (scene, n, start) that holds the place at."""
    hit = queries.join(small(parts), (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("n")))
    return hit.select("id", "scene", (F.col("at") - F.col("start")).alias("place"))


def tile_ranges(rows: DataFrame) -> DataFrame:
    """(tile, first, stop) of rows sorted by tile."""
    n = rows.groupBy("tile").agg(F.count("*").alias("n"))
    return prefix_sum(n, "tile", "n").select("tile", F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("stop"))


def composite(rows: DataFrame, faintest: float = 1 / 255.0, cutoff: float = 1e-4) -> DataFrame:
    """(tile, colour, rest, n): front-to-back blending; the row that would leave less than the cutoff and all behind it are dropped."""
    front = Window.partitionBy("tile").orderBy("depth", "id").rowsBetween(Window.unboundedPreceding, -1)
    k = rows.filter(F.col("alpha") >= faintest).withColumn("before", F.coalesce(F.exp(F.sum(F.ln(1 - F.col("alpha"))).over(front)), F.lit(1.0)))
    k = k.withColumn("after", F.col("before") * (1 - F.col("alpha"))).filter(F.col("after") >= cutoff)
    return k.groupBy("tile").agg(F.sum(F.col("c") * F.col("alpha") * F.col("before")).alias("colour"), F.min("after").alias("rest"), F.count("*").alias("n"))


def ema(rows: DataFrame, key: str, order: list[str], value: str, weight: float) -> DataFrame:
    """(key, ema): the average from 0 that gives each new value the weight, after a key's last value. Each step is affine, so a value counts weight * (1 - weight) ** (values after it):
    a sum that Spark adds up in parts, with places from range partitions, whatever share of the rows a key has."""
    placed = global_rank(rows.select(key, *order, F.col(value).alias("v")), key, *order)
    last = placed.groupBy(key).agg(F.max("place").alias("last"))
    behind = (F.col("last") - F.col("place")).cast("double")
    return placed.join(last, key).groupBy(key).agg(F.sum(weight * F.pow(F.lit(1.0 - weight), behind) * F.col("v")).alias("ema"))


def smoothed(rows: DataFrame, key: str, order: list[str], value: str, size: int) -> DataFrame:
    """Adds the lower median, mean and maximum of the last size values, and the mean of all so far."""
    by = Window.partitionBy(key).orderBy(*order)
    last = by.rowsBetween(1 - size, 0)
    held = F.array_sort(F.collect_list(value).over(last))
    return rows.withColumn("held", held).withColumns({
        "med": F.element_at("held", F.floor((F.size("held") + 1) / 2).cast("int")), "mean": F.avg(value).over(last), "top": F.max(value).over(last), "overall": F.avg(value).over(by.rowsBetween(Window.unboundedPreceding, 0)),
    }).drop("held")


def sliding_pairs(rows: DataFrame, order: str, width: int) -> DataFrame:
    """(a, b): each row with the width rows after it."""
    k = global_rank(rows, order)
    left = k.select(F.col(order).alias("a"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + width)).alias("place"))
    return left.join(k.select(F.col(order).alias("b"), "place"), "place").select("a", "b")


def best_mask(masks: DataFrame) -> DataFrame:
    score = 0.6 * (1 - F.col("dist")) + 0.4 * F.col("area")
    return masks.filter("area > 0.02 AND area < 0.60").groupBy("image").agg(F.max_by("mask", F.struct(score.alias("s"), (-F.col("mask")).alias("m"))).alias("mask"))


def quota_selection(observations: DataFrame, quota: int, least: int, most: int) -> DataFrame:
    """Tracks by falling length until each image has more than its quota or most tracks are chosen. The choice depends on all
    before it, so the sorted tracks pass through one task, which holds a batch of them and a count for each image that was chosen;
    tracks shorter than least never get there, and a track is one row."""
    tracks = observations.groupBy("track_id").agg(F.collect_set("image_id").alias("images")).filter(F.size("images") >= least)
    tracks = materialize(tracks.withColumn("n", F.size("images")), "tracks")
    n_images = tracks.select(F.explode("images").alias("image")).agg(F.count_distinct("image")).first()[0]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, int] = {}
        chosen, still_open = 0, n_images
        for batch in batches:
            out = []
            for track, own in zip(batch.column(0), batch.column(1), strict=True):
                if not still_open or chosen > most:
                    break
                own = own.as_py()
                if all(have.get(i, 0) > quota for i in own):
                    continue
                out.append(track.as_py())
                chosen += 1
                for i in own:
                    have[i] = have.get(i, 0) + 1
                    still_open -= have[i] == quota + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["track_id"])

    ordered = tracks.repartition(1).sortWithinPartitions(F.desc("n"), F.desc("track_id")).select("track_id", "images")
    return observations.join(ordered.mapInArrow(choose, "track_id long"), "track_id", "left_semi")


def farthest_points(rows: DataFrame, n: int) -> DataFrame:
    """(i, place): from the least id on, the row (id, v) with the least similarity to the most similar of those taken before. Each
    pick is one pass over the rows, which meet the vectors taken so far (n at most) as literals."""
    held = materialize(rows.select("id", "v"))
    pick = held.orderBy("id").first()
    taken = []
    while pick is not None:
        taken.append((pick["id"], [float(x) for x in pick["v"]]))
        if len(taken) == n:
            break
        dots = [F.aggregate(F.zip_with("v", F.array(*map(F.lit, v)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for _, v in taken]
        near = F.round(dots[0] if len(dots) == 1 else F.greatest(*dots), 6)
        pick = held.filter(~F.col("id").isin([i for i, _ in taken])).withColumn("s", near).orderBy("s", "id").first()
    return rows.sparkSession.createDataFrame([(i, k) for k, (i, _) in enumerate(taken)], "i long, place int")


def greedy_cover(weights: DataFrame, share: float) -> DataFrame:
    """(crop, gain): crops by the weight that they add, until the share of what all together cover is reached; one round for each."""
    left = materialize(weights)
    total = left.groupBy("pixel").agg(F.max("w").alias("w")).agg(F.sum("w")).first()[0] or 0.0
    out, got = [], 0.0
    while got < share * total:
        best = left.groupBy("crop").agg(F.sum("w").alias("gain")).orderBy(F.desc("gain"), "crop").first()
        if best is None or best["gain"] <= 1e-12:
            break
        out.append((best["crop"], best["gain"]))
        got += best["gain"]
        used = left.filter(F.col("crop") == best["crop"]).select("pixel", F.col("w").alias("used"))
        left = materialize(left.join(used, "pixel", "left").select("crop", "pixel", F.greatest(F.col("w") - F.coalesce("used", F.lit(0.0)), F.lit(0.0)).alias("w")).filter("w > 0"))
    return weights.sparkSession.createDataFrame(out, "crop long, gain double")


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of a hash: the same ones each time."""
    return rows.orderBy(c.draw(F.col(key)), key).limit(n)


def batches(rows: DataFrame, key: str, size: int, features: int, epoch: int, seed: int = 777) -> DataFrame:
    """Rows in the epoch's order, in batches of one feature each."""
    ranked = global_rank(rows.withColumn("h", c.draw(F.col(key), f"{seed + epoch} ")), "h", key)
    batch = F.floor(F.col("place") / size)
    return ranked.withColumn("batch", batch).withColumn("feature", F.floor(c.draw(F.col("batch"), f"{seed + epoch} batch ") * features)).drop("h", "place")
