"""Robust geometry as grouped maps: a pair, an image or a point is a group, so groups are small and run side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import kernels


def verified_pairs(matches: DataFrame, threshold: float | None, min_inliers: int = 15) -> DataFrame:
    """matches (image1, image2, k1, k2, x1, y1, x2, y2; normalised) -> image1, image2, rotation (9), translation (3), inliers
    (array of k1, k2). threshold None: it is a column of matches. For pairs with max(min_inliers, 8) matches and min_inliers inliers at least."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["k1", "k2"])
        out = None
        if len(g) >= max(min_inliers, 8):
            out = kernels.two_view(g[["x1", "y1"]].to_numpy(), g[["x2", "y2"]].to_numpy(), g.threshold.iloc[0] if threshold is None else threshold)
        if out is None or out[2].sum() < min_inliers:
            return pd.DataFrame(columns=["image1", "image2", "rotation", "translation", "inliers"], dtype=object)
        kept = g[out[2]]
        return pd.DataFrame({"image1": [g.image1.iloc[0]], "image2": [g.image2.iloc[0]], "rotation": [out[0].ravel().tolist()], "translation": [out[1].tolist()],
                             "inliers": [[{"k1": int(a), "k2": int(b)} for a, b in zip(kept.k1, kept.k2)]]})

    return matches.groupBy("image1", "image2").applyInPandas(run, "image1 long, image2 long, rotation array<double>, translation array<double>, inliers array<struct<k1:long,k2:long>>")


def triangulated(observations: DataFrame) -> DataFrame:
    """observations (point, image, x, y normalised, rotation, translation) -> point, x, y, z, n_views; a point of fewer than two views or at
    infinity is left out."""

    views = observations.groupBy("point").agg(F.array_sort(F.collect_list(F.struct("image", "x", "y", "rotation", "translation"))).alias("v")).where(F.size("v") > 1)
    # a track has one view an image, so a row is bounded; points of a batch with equally many views are solved as one stack
    flat = views.select("point", F.size("v").cast("long").alias("n"), F.flatten(F.transform("v", lambda v: F.concat(F.array(v["x"], v["y"]), v["rotation"], v["translation"]))).alias("a"))

    def run(frames):
        for f in frames:
            for n, g in f.groupby("n"):
                a = np.stack(g.a.to_numpy()).reshape(len(g), n, 14)
                p = np.concatenate([a[:, :, 2:11].reshape(len(g), n, 3, 3), a[:, :, 11:, None]], axis=3)
                rows = np.concatenate([a[:, :, 0, None] * p[:, :, 2] - p[:, :, 0], a[:, :, 1, None] * p[:, :, 2] - p[:, :, 1]], axis=1)
                h = np.linalg.svd(rows, full_matrices=False)[2][:, -1]
                ok = np.abs(h[:, 3]) >= 1e-12
                x = h[ok, :3] / h[ok, 3:]
                yield pd.DataFrame({"point": g.point.to_numpy()[ok], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "n_views": n})

    return flat.mapInPandas(run, "point long, x double, y double, z double, n_views long")


def resected(correspondences: DataFrame, threshold: float, min_correspondences: int = 12) -> DataFrame:
    """correspondences (image, kp, px, py, x, y, z) -> image, rotation, translation, n_inliers."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("kp")
        out = kernels.pnp(g[["x", "y", "z"]].to_numpy(), g[["px", "py"]].to_numpy(), threshold) if len(g) >= min_correspondences else None
        if out is None:
            return pd.DataFrame(columns=["image", "rotation", "translation", "n_inliers"], dtype=object)
        return pd.DataFrame({"image": [g.image.iloc[0]], "rotation": [out[0].ravel().tolist()], "translation": [out[1].tolist()], "n_inliers": [int(out[2].sum())]})

    return correspondences.groupBy("image").applyInPandas(run, "image long, rotation array<double>, translation array<double>, n_inliers long")
