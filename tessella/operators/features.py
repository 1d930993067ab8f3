"""Keypoints of images: detectors as maps over image rows, one image at a time in memory."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import imaging, markers

KEYPOINTS = "image_id long, kp int, x double, y double, scale double, angle double, response double, desc_f array<double>, desc_b array<long>, desc_m struct<capture_id:long,marker_id:int,corner_index:int>"
DETECTORS = ("sift", "orb", "disk", "aruco")
# The grid of the search for marker parameters.
RADII, OFFSETS, CONTRASTS, GAMMAS = (3, 5, 7, 11, 15, 21), (4.0, 8.0, 12.0, 18.0, 25.0), (1.0, 1.4, 1.8), (1.0, 0.7, 1.4)
SAMPLE_IMAGES = 12
#: The learned detector sees images scaled down to this longer side, for memory; keypoints are scaled up again.
LEARNED_SIDE, LEARNED_MOST = 1600, 8000


def detector_of(name: str) -> str:
    """The detector of a name in any case; known names without an implementation are an error, as unknown ones are."""
    n = name.lower()
    if n in ("akaze", "superpoint"):
        raise NotImplementedError(f"detector {n} is not implemented")
    if n not in DETECTORS:
        raise ValueError(f"unknown detector {name}")
    return n


_sessions: dict = {}


def _learned(rgb: np.ndarray, model: str, most: int) -> dict:
    """Keypoints of an ONNX model (input NCHW 0 to 1; outputs keypoints, scores, descriptors); one session a worker and model."""
    import onnxruntime

    if model not in _sessions:
        _sessions[model] = onnxruntime.InferenceSession(model, providers=onnxruntime.get_available_providers())
    s, (h, w) = _sessions[model], rgb.shape[:2]
    f = max(1.0, max(h, w) / LEARNED_SIDE)
    if f > 1:
        rgb = np.stack([imaging.resized(rgb[:, :, c], int(round(h / f)), int(round(w / f))) for c in range(3)], 2)
    out = s.run(None, {s.get_inputs()[0].name: rgb.transpose(2, 0, 1)[None].astype(np.float32)})
    kp, score, desc = (np.asarray(o, float) for o in out[:3])
    kp, score, desc = kp.reshape(-1, 2), score.ravel(), desc.reshape(len(score.ravel()), -1)
    d = desc / np.maximum(np.linalg.norm(desc, axis=1, keepdims=True), 1e-12)
    return imaging._strongest({"x": (kp[:, 0] + 0.5) * f - 0.5, "y": (kp[:, 1] + 0.5) * f - 0.5, "scale": np.full(len(kp), f), "angle": np.zeros(len(kp)), "response": score, "desc": d}, most)


def detect(images: DataFrame, detector: str, most: int | None = None, params: markers.MarkerParams = markers.MarkerParams(), model: str | None = None) -> DataFrame:
    """images (image_id, capture_id, width, height, channels, data) -> keypoints. Markers give four corners each, their identity in desc_m.
    An image without keypoints gives no row. disk needs the path of its model."""
    detector = detector_of(detector)
    if detector == "disk" and not model:
        raise ValueError("disk needs the path of its model file")

    def one(r) -> pd.DataFrame | None:
        img = imaging.gray_of(bytes(r.data), r.height, r.width, r.channels)
        if detector == "aruco":
            found = markers.detect(img, params)
            if not found:
                return None
            c = np.concatenate([m[1] for m in found])
            k = {"x": c[:, 0], "y": c[:, 1], "scale": np.ones(len(c)), "angle": np.zeros(len(c)), "response": np.ones(len(c))}
            ids = [{"capture_id": int(r.capture_id), "marker_id": m[0], "corner_index": i} for m in found for i in range(4)]
            cols = {"desc_f": None, "desc_b": None, "desc_m": ids}
        else:
            if detector == "disk":
                a = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.channels).astype(float) / 255
                k = _learned(a[:, :, 2::-1] if r.channels >= 3 else np.repeat(a[:, :, :1], 3, 2), model, most or LEARNED_MOST)
            else:
                k = {"sift": imaging.sift, "orb": imaging.orb}[detector](img, *([most] if most else []))
            if not len(k["x"]):
                return None
            d = k.pop("desc")
            cols = {"desc_f": list(d) if detector != "orb" else None, "desc_b": list(d) if detector == "orb" else None, "desc_m": None}
        return pd.DataFrame({"image_id": r.image_id, "kp": np.arange(len(k["x"]), dtype=np.int32), **{n: k[n] for n in ("x", "y", "scale", "angle", "response")}, **cols})

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                out = one(r)
                if out is not None:
                    yield out

    if "capture_id" not in images.columns:
        images = images.withColumn("capture_id", F.lit(0).cast("long"))
    return images.select("image_id", "capture_id", "width", "height", "channels", "data").mapInPandas(run, KEYPOINTS)


def stamped(keypoints: DataFrame, capture) -> DataFrame:
    """Marker identities with the given capture."""
    return keypoints.withColumn("desc_m", F.when(F.col("desc_m").isNotNull(), F.col("desc_m").withField("capture_id", capture)))


def tuned_markers(images: DataFrame) -> tuple[markers.MarkerParams, int, int]:
    """The parameters of the grid under which most images (then most markers) are found, on up to SAMPLE_IMAGES images spread over the
    table; ties go to what is nearest to the defaults. Images times grid cells are the tasks. -> params, images, markers."""
    n = images.count()
    stride = max(1, -(-n // SAMPLE_IMAGES))
    chosen = images.select("image_id").withColumn("_n", F.row_number().over(Window.orderBy("image_id")) - 1).where(F.col("_n") % stride == 0).select("image_id")
    default = markers.MarkerParams()
    grid = [(i, *p) for i, p in enumerate(sorted(product(RADII, OFFSETS, CONTRASTS, GAMMAS), key=lambda p: (p[2:] != (1.0, 1.0), abs(p[0] - default.radius) + abs(p[1] - default.offset), p)))]
    cells = images.sparkSession.createDataFrame(grid, "cell int, radius int, offset double, contrast double, gamma double")
    sample = images.join(chosen, "image_id").select("image_id", "width", "height", "channels", "data")

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                img = imaging.gray_of(bytes(r.data), r.height, r.width, r.channels)
                found = len(markers.detect(img, replace(default, radius=r.radius, offset=r.offset, contrast=r.contrast, gamma=r.gamma)))
                yield pd.DataFrame({"cell": [r.cell], "found": [found]})

    # SAMPLE_IMAGES rows at most times the fixed grid, which alone is broadcast
    tasks = sample.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))).join(F.broadcast(cells), "cell").repartition(32, "cell")
    score = tasks.mapInPandas(run, "cell int, found int").groupBy("cell").agg(F.sum((F.col("found") > 0).cast("int")).alias("images"), F.sum("found").alias("markers"))
    best = score.orderBy(F.desc("images"), F.desc("markers"), "cell").first()
    if best is None or not best.markers:
        return default, 0, 0
    _, radius, offset, contrast, gamma = grid[best.cell]
    return replace(default, radius=radius, offset=offset, contrast=contrast, gamma=gamma), best.images, best.markers


def corner_rows(keypoints: DataFrame, images: DataFrame) -> DataFrame:
    """feature_id (capture, camera, image index, marker and corner), image_id, image_name, x, y of marker corners, as they are exported."""
    parts = ("desc_m.capture_id", "physical", "image_index", "desc_m.marker_id", "desc_m.corner_index")
    return keypoints.join(images, "image_id").select(
        F.concat_ws("_", *(F.col(c).cast("string") for c in parts)).alias("feature_id"), "image_id", F.col("name").alias("image_name"),
        F.format_string("%.3f", "x").alias("x"), F.format_string("%.3f", "y").alias("y"))
