"""Queries that run whole engines on scenes made from table rows; their SQL states what the scene holds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import averaging, bundle, imaging
from tessella.functions.kernels import rotation_vector
from tessella.operators import estimation, features, matching, reconstruct
from tessella.plans.catalog import query, table
from tessella.sources import synthetic
from tessella.storage import staged

IMAGES = "image_id long, capture_id long, width int, height int, channels int, data binary"
VIEWS = 4
CAMERA = [750.0, 320.0, 240.0]


def _pictures(s, d, draw) -> DataFrame:
    """Gray pictures, some for each nation: draw gives (image_id, capture_id, values 0 to 1)."""

    def run(frames):
        for f in frames:
            for k in f.n_nationkey:
                for image, capture, img in draw(int(k)):
                    a = np.clip(np.rint(img * 255), 0, 255).astype(np.uint8)
                    yield pd.DataFrame({"image_id": [image], "capture_id": [capture], "width": [a.shape[1]], "height": [a.shape[0]], "channels": [1], "data": [a.tobytes()]})

    return table(s, d, "nation").select("n_nationkey").mapInPandas(run, IMAGES)


@query("SELECT CAST(n_nationkey AS BIGINT) AS image, CAST(n_nationkey % 3 AS BIGINT) AS capture, CAST(2 * n_nationkey + m AS INTEGER) AS marker, CAST(4 AS BIGINT) AS corners FROM nation, (VALUES (0), (1)) AS v(m)")
def detected_markers(s, d):
    found = features.detect(_pictures(s, d, lambda k: [(k, k % 3, synthetic.scene([2 * k, 2 * k + 1]))]), "aruco")
    return found.groupBy(F.col("image_id").alias("image"), F.col("desc_m.capture_id").alias("capture"), F.col("desc_m.marker_id").alias("marker")).agg(F.count_distinct("desc_m.corner_index").alias("corners"))


def _texture(k: int):
    """A picture and its window eight pixels further to the right and down."""
    g = np.random.default_rng(k)
    img = imaging.blur(g.random((168, 208)), 1.6)
    img = (img - img.min()) / (img.max() - img.min())
    return [(2 * k, 0, img[:160, :200]), (2 * k + 1, 0, img[8:, 8:])]


def _found_again(s, d, detector):
    """Pictures whose keypoints, but for those near the border, are found again where the window has moved them to, within a pixel and a half (coarser levels have larger pixels)."""
    k = staged(features.detect(_pictures(s, d, _texture), detector), "keypoints").select("image_id", "x", "y")
    first = k.where("image_id % 2 = 0 AND x BETWEEN 48 AND 160 AND y BETWEEN 48 AND 120").select(F.expr("image_id div 2").alias("n"), "x", "y").withColumn("id", F.monotonically_increasing_id())
    again = k.where("image_id % 2 = 1").select(F.expr("image_id div 2").alias("n"), (F.col("x") + 8).alias("u"), (F.col("y") + 8).alias("v"))
    near = first.join(again, "n").where("abs(x - u) < 1.5 AND abs(y - v) < 1.5").select("n", "id").distinct().groupBy("n").count()
    return first.groupBy("n").agg(F.count("*").alias("all")).join(near, "n").select(F.col("n").alias("picture"), F.expr("count >= 0.8 * all AND all >= 10").alias("repeatable"))


REPEATABLE = "SELECT CAST(n_nationkey AS BIGINT) AS picture, TRUE AS repeatable FROM nation"


@query(REPEATABLE)
def sift_repeatability(s, d):
    return _found_again(s, d, "sift")


@query(REPEATABLE)
def orb_repeatability(s, d):
    return _found_again(s, d, "orb")


def _rig():
    out = []
    for i in range(VIEWS):
        r = rotation_vector(np.array([0.02 * i, -0.08 * i, 0.01 * i]))
        out.append((r, -r @ np.array([0.6 * i, 0.25 * (i % 3), 0.2 * (i % 2)])))
    return out


def _points(s, d):
    return table(s, d, "nation").select(F.explode(F.sequence(F.col("n_nationkey").cast("long") * 4, F.col("n_nationkey").cast("long") * 4 + 3)).alias("kp"))


def _capture(s, d):
    """Cameras, images, keypoints of four points a nation in all views, and verified pairs."""
    k = F.col("kp")
    scene = _points(s, d).select(k, (0.8 * F.sin(k * 0.37)).alias("x"), (0.6 * F.cos(k * 0.53)).alias("y"), (4 + k % 97 * 0.03).alias("z"))

    def run(frames):
        for f in frames:
            for i, (r, t) in enumerate(_rig()):
                p = bundle.project("SIMPLE_PINHOLE", np.array(CAMERA), f[["x", "y", "z"]].to_numpy() @ r.T + t, False)
                yield pd.DataFrame({"image_id": i, "kp": f.kp, "x": p[:, 0], "y": p[:, 1]})

    cameras = s.createDataFrame([(1, "SIMPLE_PINHOLE", 640, 480, CAMERA)], "camera_id long, model string, width int, height int, params array<double>")
    images = s.createDataFrame([(i, 1, f"{i}.png") for i in range(VIEWS)], "image_id long, camera_id long, name string")
    keypoints = staged(scene.mapInPandas(run, "image_id long, kp int, x double, y double"), "keypoints")
    n = reconstruct.normalised(keypoints, images, cameras)
    a, b = (n.select(F.col("image_id").alias(f"image{i}"), F.col("kp").cast("long").alias("kp"), F.col("nx").alias(f"x{i}"), F.col("ny").alias(f"y{i}")) for i in (1, 2))
    pairs = matching.exhaustive_pairs(images, "image_id").select(F.col("i").alias("image1"), F.col("j").alias("image2"))
    matches = pairs.join(a, "image1").join(b, ["image2", "kp"]).withColumn("k1", F.col("kp")).withColumn("k2", F.col("kp"))
    return cameras, images, keypoints, staged(estimation.verified_pairs(matches, 0.004), "pairs")


def _judged(s, d, model):
    """For each image whether its turn against the model's first image is the rig's, and whether the model's points are right and nearly all there."""
    _, images, points = model
    n = _points(s, d).count()
    found = points.agg(F.count("*").alias("n"), F.max("error").alias("e")).first()
    whole, rows = found.n >= 0.9 * n and found.e < 0.5, images.select("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz").orderBy("image_id").collect()
    rot = {r.image_id: averaging.rotation_of(np.array([r.qw, r.qx, r.qy, r.qz])) for r in rows}
    rig, first = _rig(), min(rot)
    off = [(i, averaging.angle(r @ rot[first].T @ (rig[i][0] @ rig[first][0].T).T) < 0.5, bool(whole)) for i, r in rot.items()]
    return s.createDataFrame(off, "image long, turned boolean, whole boolean")


POSED = "SELECT CAST(i AS BIGINT) AS image, TRUE AS turned, TRUE AS whole FROM (VALUES (0), (1), (2), (3)) AS v(i)"


@query(POSED)
def global_reconstruction(s, d):
    cameras, images, keypoints, pairs = _capture(s, d)
    return _judged(s, d, reconstruct.global_model(images, cameras, keypoints, pairs))


@query(POSED)
def incremental_reconstruction(s, d):
    cameras, images, keypoints, pairs = _capture(s, d)
    return _judged(s, d, reconstruct.incremental_model(images, cameras, keypoints, pairs))
