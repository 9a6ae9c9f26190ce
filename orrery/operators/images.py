"""Operators that need a whole image or detection list at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kernel(size: int = 11, sigma: float = 1.5) -> np.ndarray:
    x = np.arange(size) - size // 2
    g = np.exp(-(x**2) / (2 * sigma**2))
    return g / g.sum()


def blur(img: np.ndarray) -> np.ndarray:
    """Separable 11x11 Gaussian with zero padding."""
    g = kernel()
    half = len(g) // 2
    pad = np.pad(img, half)
    rows = sum(w * pad[:, k : k + img.shape[1]] for k, w in enumerate(g))
    return sum(w * rows[k : k + img.shape[0]] for k, w in enumerate(g))


def structural_similarity(p: np.ndarray, q: np.ndarray, c1: float = 0.01**2, c2: float = 0.03**2) -> float:
    mp, mq = blur(p), blur(q)
    vp, vq, cov = blur(p * p) - mp**2, blur(q * q) - mq**2, blur(p * q) - mp * mq
    return float((((2 * mp * mq + c1) * (2 * cov + c2)) / ((mp**2 + mq**2 + c1) * (vp + vq + c2))).mean())


def ssim(pixels: DataFrame) -> DataFrame:
    """(image, ssim) of pixels (image, x, y, p, q); a task holds one image."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf.y.max()) + 1, int(pdf.x.max()) + 1)
        p, q = np.zeros(shape), np.zeros(shape)
        p[pdf.y, pdf.x], q[pdf.y, pdf.x] = pdf.p, pdf.q
        return pd.DataFrame({"image": [pdf.image.iloc[0]], "ssim": [structural_similarity(p, q)]})

    return pixels.groupBy("image").applyInPandas(one, "image long, ssim double")


def match_detections(pairs: DataFrame, least: float) -> DataFrame:
    """(image, det, gt): detections by falling score each take the free box that they overlap most, if enough. Images lie sorted in
    partitions and pass by in batches; a task holds the boxes that are taken in one image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, taken = None, None, set()
        for batch in batches:
            out = []
            for image, det, gt in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if image != now:
                    now, done, taken = image, None, set()
                if det != done and gt not in taken:
                    done = det
                    taken.add(gt)
                    out.append((image, det, gt))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, names=["image", "det", "gt"])

    key = [F.col(k).cast("long").alias(k) for k in ("image", "det", "gt")]
    near = pairs.filter((F.col("iou") >= least) & ~F.isnan("iou")).select(*key, "score", "iou")
    order = ["image", F.isnan("score"), F.desc("score"), "det", F.desc("iou"), "gt"]
    return near.repartition("image").sortWithinPartitions(*order).select("image", "det", "gt").mapInArrow(run, "image long, det long, gt long")
