"""transforms.json: cameras and camera-to-world poses."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.averaging import quaternion

INTRINSICS = ("fl_x", "fl_y", "cx", "cy", "w", "h", "k1", "k2", "p1", "p2")
_TOP, _FRAME = (", ".join(f"{n}{sep}double" for n in INTRINSICS) for sep in (" ", ":"))
SCHEMA = f"camera_angle_x double, {_TOP}, frames array<struct<file_path:string, transform_matrix:array<array<double>>, {_FRAME}>>"


def frames(text: DataFrame) -> DataFrame:
    """value (one JSON document) -> one row per frame: pos, name, matrix, the ten intrinsics with the document's defaults filled in, camera_id.

    A focal length may come from camera_angle_x; frames of equal (fl_x, fl_y, w, h) share a camera, ids from 1 in order of first
    appearance. A frame without file_path, matrix or focal length is an error."""
    top = text.select(F.from_json("value", SCHEMA).alias("t")).select("t.*")
    f = top.select(F.posexplode("frames").alias("pos", "f"), *(F.col(n).alias(f"t_{n}") for n in INTRINSICS), "camera_angle_x")
    own = lambda n, default=None: F.coalesce(F.col(f"f.{n}"), F.col(f"t_{n}"), *([] if default is None else [default]))
    zero = F.lit(0.0)
    f = f.withColumn("w", own("w", zero)).withColumn("h", own("h", zero))
    f = f.withColumn("fl_x", own("fl_x", 0.5 * F.col("w") / F.tan(0.5 * F.col("camera_angle_x")))).withColumn("fl_y", own("fl_y", F.col("fl_x")))
    f = f.withColumn("cx", own("cx", F.col("w") / 2)).withColumn("cy", own("cy", F.col("h") / 2))
    for n in ("k1", "k2", "p1", "p2"):
        f = f.withColumn(n, own(n, zero))
    bad = F.when(F.col("f.file_path").isNull() | F.col("f.transform_matrix").isNull() | F.col("fl_x").isNull(),
                 F.raise_error(F.concat(F.lit("frame without path, matrix or focal length: "), F.col("pos").cast("string"))).cast("string")).otherwise(F.col("f.file_path"))
    f = f.select("pos", bad.alias("name"), F.flatten("f.transform_matrix").alias("matrix"), *INTRINSICS)
    key = Window.partitionBy("fl_x", "fl_y", "w", "h")
    f = f.withColumn("first", F.min("pos").over(key))
    ids = f.select("first").distinct().withColumn("camera_id", F.row_number().over(Window.orderBy("first")).cast("long"))
    return f.join(ids, "first").drop("first")


def read_transforms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """-> cameras (OPENCV) and images (image_id from 1 in file order, pose as quaternion and translation, world to camera)."""
    f = frames(spark.read.text(path, wholetext=True))
    cams = f.groupBy("camera_id").agg(F.min_by(F.struct(*INTRINSICS), "pos").alias("i")).select(
        "camera_id", F.lit("OPENCV").alias("model"), F.col("i.w").cast("int").alias("width"), F.col("i.h").cast("int").alias("height"),
        F.array(*(F.col(f"i.{n}") for n in ("fl_x", "fl_y", "cx", "cy", "k1", "k2", "p1", "p2"))).alias("params"))

    def pose(batches):
        for b in batches:
            b = b.copy()
            m = np.array(b.matrix.tolist(), float).reshape(-1, 4, 4)
            r = np.swapaxes(m[:, :3, :3] * np.array([1, -1, -1]), 1, 2)
            t = -np.einsum("nij,nj->ni", r, m[:, :3, 3])
            q = np.array([quaternion(x) for x in r]).reshape(-1, 4)
            for k, v in zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), np.hstack([q, t]).T):
                b[k] = v
            yield b.drop(columns=["matrix"])

    images = f.select((F.col("pos") + 1).cast("long").alias("image_id"), "camera_id", "name", "matrix").mapInPandas(
        pose, "image_id long, camera_id long, name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    return cams, images


def frame_rows(cameras: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, file_path, transform_matrix (4 rows) and the camera's fl_x, fl_y, cx, cy, w, h, k1, k2, p1, p2 (null without a camera)."""
    m, p = F.col("model"), F.col("params")
    (fx, fy), (cx, cy), d = G.focal_lengths(m, p), G.principal_point(m, p), G.opencv_distortion(m, p)
    cams = cameras.select("camera_id", fx.alias("fl_x"), fy.alias("fl_y"), cx.alias("cx"), cy.alias("cy"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"),
                          *(F.get(d, F.lit(i)).alias(n) for i, n in enumerate(("k1", "k2", "p1", "p2"))))
    c2w = G.nerf_c2w([F.col(c) for c in ("qw", "qx", "qy", "qz")], [F.col(c) for c in ("tx", "ty", "tz")])
    last = F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)))
    rows = images.select("image_id", "camera_id", F.col("name").alias("file_path"), F.array(*(F.array(*r) for r in c2w), last).alias("transform_matrix"))
    return rows.join(cams, "camera_id", "left").drop("camera_id")


def write_transforms(cameras: DataFrame, images: DataFrame, path: str) -> None:
    """One JSON document. Intrinsics stand once at the top if there is one camera, else in every frame and without distortion. The file is one
    document, so the driver writes it, frame by frame."""
    rows = frame_rows(cameras, images)
    shared = rows.select(*INTRINSICS).first() if cameras.count() == 1 and rows.head(1) else None
    top = {"camera_model": "OPENCV"} if shared is None else {**shared.asDict(), "camera_model": "OPENCV"}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    keep = ("file_path", "transform_matrix") + (() if shared is not None else INTRINSICS[:6])
    with open(path, "w") as out:
        out.write(json.dumps(top)[:-1] + ', "frames": [')
        for n, r in enumerate(rows.orderBy("image_id").select(*keep).toLocalIterator()):
            out.write((",\n" if n else "\n") + json.dumps({k: v for k, v in r.asDict().items() if v is not None}))
        out.write("\n]}\n")
