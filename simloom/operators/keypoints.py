"""Pair features of duplicate images from their keypoints.

A table of keypoints is (uid, kp, x, y, desc); of pairs (a, b).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import vectors as V

# Thresholds in pixels, and the one whose boxes are kept.
PIXELS, MAIN, LEAST_MATCHES = (1.0, 2.0, 5.0, 10.0, 20.0), 5.0, 10
VALID_PIXELS, VALID_INLIERS = 15.0, 15


def mutual_nearest(keypoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, x1, y1, x2, y2): keypoints of a pair that are each other's nearest (Euclidean; ties to the lower number)."""
    one = keypoints.select(F.col("uid").alias("a"), F.col("kp").alias("k1"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("desc").alias("d1"))
    two = keypoints.select(F.col("uid").alias("b"), F.col("kp").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("desc").alias("d2"))
    each = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").withColumn("d", F.round(V.distance(F.col("d1"), F.col("d2")), 9))
    there = F.row_number().over(Window.partitionBy("a", "b", "k1").orderBy("d", "k2"))
    back = F.row_number().over(Window.partitionBy("a", "b", "k2").orderBy("d", "k1"))
    return each.withColumn("r", there).withColumn("s", back).where("r = 1 and s = 1").select("a", "b", "k1", "x1", "y1", "x2", "y2")


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The projective map of at least four points by the direct linear transform; None if degenerate."""
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    _, s, vt = np.linalg.svd(np.array(rows))
    if s[min(7, len(s) - 1)] < 1e-9 or abs(vt[-1, 8]) < 1e-12:
        return None
    return vt[-1].reshape(3, 3) / vt[-1, 8]


def residuals(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Distance of each mapped point from its partner."""
    p = np.concatenate([src, np.ones((len(src), 1))], axis=1) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.sqrt((((p[:, :2] / p[:, 2:]) - dst) ** 2).sum(axis=1))
    return np.where(np.isfinite(out), out, np.inf)


def consensus(src: np.ndarray, dst: np.ndarray, pixels: float, rounds: int = 200, seed: int = 5) -> np.ndarray:
    """Inliers of the best homography of seeded draws of four points, refitted to its inliers; none for ten matches or fewer."""
    best = np.zeros(len(src), bool)
    if len(src) <= LEAST_MATCHES:
        return best
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        at = rng.choice(len(src), 4, replace=False)
        h = homography(src[at], dst[at])
        if h is not None and (good := residuals(h, src, dst) <= pixels).sum() > best.sum():
            best = good
    if best.sum() >= 4 and (h := homography(src[best], dst[best])) is not None:
        best = residuals(h, src, dst) <= pixels
    return best


def pair_features(keypoints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, f array of 10 doubles or null, box_a, box_b): sizes of the two sets, candidates, spreads and inlier ratios.

    Null features where there is no inlier at the main threshold. Spread is the
    greater side of the inliers' box over that of all keypoints' box.
    """
    extent = keypoints.groupBy("uid").agg(F.count("*").alias("n"), F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    listed = mutual_nearest(keypoints, pairs).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("k1", "x1", "y1", "x2", "y2"))).alias("m"))
    each = pairs.select("a", "b").distinct().join(listed, ["a", "b"], "left")
    for end in ("a", "b"):
        each = each.join(extent.select(F.col("uid").alias(end), F.struct("n", "lx", "hx", "ly", "hy").alias("e" + end)), end, "left")
    each = each.select("a", "b", "m", "ea", "eb")

    def run(batches):
        for batch in batches:
            out = {"f": [], "box_a": [], "box_b": []}
            for r in batch.to_pylist():
                m = np.array([[p["x1"], p["y1"], p["x2"], p["y2"]] for p in r["m"] or []], float).reshape(-1, 4)
                src, dst = m[:, :2], m[:, 2:]
                good = consensus(src, dst, MAIN)
                if not good.any() or not r["ea"] or not r["eb"]:
                    for c in out.values():
                        c.append(None)
                    continue
                spread, boxes = [], []
                for p, e in ((src[good], r["ea"]), (dst[good], r["eb"])):
                    low, high = p.min(axis=0), p.max(axis=0)
                    boxes.append({"x": float(low[0]), "y": float(low[1]), "w": float(high[0] - low[0]), "h": float(high[1] - low[1])})
                    spread.append(float(max(high - low) / max(e["hx"] - e["lx"], e["hy"] - e["ly"], 1e-9)))
                ratios = [float(consensus(src, dst, t).sum() / len(m)) for t in PIXELS]
                n = sorted((r["ea"]["n"], r["eb"]["n"]))
                out["f"].append([float(n[0]), float(n[1]), float(len(m)), min(spread), max(spread), *ratios])
                out["box_a"].append(boxes[0])
                out["box_b"].append(boxes[1])
            box = pa.struct([(k, pa.float64()) for k in "xywh"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out["f"], pa.list_(pa.float64())), pa.array(out["box_a"], box), pa.array(out["box_b"], box)], names=["a", "b", "f", "box_a", "box_b"])

    kind, box = dict(pairs.dtypes)["a"], "struct<x: double, y: double, w: double, h: double>"
    return each.mapInArrow(run, f"a {kind}, b {kind}, f array<double>, box_a {box}, box_b {box}")


def valid_transitions(residual: DataFrame) -> DataFrame:
    """(a, b, valid): whether more than 15 matches of (a, b, residual) lie within 15 pixels."""
    return residual.groupBy("a", "b").agg((F.count_if(F.col("residual") <= VALID_PIXELS) > VALID_INLIERS).alias("valid"))


def detail_flags(pairs: DataFrame) -> DataFrame:
    """Rows (f, is_duplicate) with detail_wide and detail: few candidates or a small spread, of duplicates."""
    few = F.col("f")[2] <= 10
    return pairs.withColumn("detail_wide", (few | (F.col("f")[3] < 0.3)) & F.col("is_duplicate")).withColumn("detail", few & F.col("is_duplicate"))
