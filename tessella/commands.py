"""The command line: project new, feature, match, map, refine, export, eval, debug-pair, run."""

from __future__ import annotations

import argparse
import glob
import json
import os
import shutil

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions.averaging import rotation_of
from tessella.functions.incremental import Growth
from tessella.operators import features, matching, reconstruct, retrieval, viewgraph
from tessella.sources import colmap, dataset, models, nerf
from tessella.sources.project import Project
from tessella.storage import staged

# The sweep of debug-pair.
RATIOS, THRESHOLDS = (0.6, 0.7, 0.8, 0.9, 1.0), (2.0, 4.0, 8.0, 16.0, 32.0)


def _with_cameras(spark: SparkSession, project: Project, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """images (image_id, name, width, height, physical) -> images with camera_id, and cameras.

    A declared camera whose glob fits goes first (the first declaration wins; with declarations, an image that none fits is an error);
    else the physical camera if there are several; else the size. Cameras of a size that is known already are used again."""
    declared = project.settings.cameras
    guess = lambda model: G.default_params(model, F.col("width"), F.col("height"))
    if declared:
        rows = [(n, c["images"], c.get("model") or "SIMPLE_RADIAL", [float(p) for p in c["params"]] if c.get("params") else None) for n, c in enumerate(declared)]
        d = spark.createDataFrame(rows, "pos int, pattern string, model string, params array<double>")
        hit = images.join(F.broadcast(d), F.rlike("name", G.glob_regex(F.col("pattern"))))  # the list of declarations
        first = hit.groupBy("image_id").agg(F.min("pos").alias("pos"))
        lost = images.join(first, "image_id", "left_anti").select("name").head(1)
        if lost:
            raise ValueError(f"no declared camera fits {lost[0].name}")
        keyed, key = images.join(first, "image_id").join(d, "pos"), ["pos"]
    else:
        several = images.select("physical").distinct().count() > 1
        keyed, key = images.withColumn("model", F.lit("SIMPLE_RADIAL")).withColumn("params", F.lit(None).cast("array<double>")), ["physical"] if several else ["width", "height"]
    old = project.read(spark, "cameras", "feature") if project.has("cameras") else None
    kinds = keyed.groupBy(*key).agg(F.min("image_id").alias("first"), *(F.min_by(c, "image_id").alias(c) for c in ("model", "params", *(c for c in ("width", "height") if c not in key))))
    by_model = F.coalesce(*(F.when(F.col("model") == m, guess(m)) for m in G.CAMERA_MODELS))
    kinds = kinds.withColumn("params", F.coalesce("params", by_model))
    known = spark.createDataFrame([], "width int, height int, id long")
    if old is not None and key == ["width", "height"]:
        known = old.groupBy("width", "height").agg(F.min("camera_id").alias("id"))
    top = (old.agg(F.coalesce(F.max("camera_id"), F.lit(0))).first()[0] if old is not None else 0)
    new = kinds.join(known, ["width", "height"], "left")
    fresh = new.where("id IS NULL").drop("id").withColumn("id", (F.lit(top) + F.row_number().over(Window.orderBy("first"))).cast("long"))
    both = staged(new.where("id IS NOT NULL").unionByName(fresh), "camera-kinds")
    cameras = fresh.select(F.col("id").alias("camera_id"), "model", "width", "height", "params")
    cameras = staged(cameras if old is None else viewgraph.upserted(old, cameras, ["camera_id"]), "cameras")
    return keyed.drop("model", "params").join(both.select(*key, F.col("id").alias("camera_id")), key), cameras


def feature(spark: SparkSession, project: Project, detector: str = "sift", max_features: int | None = None, find_params: bool = False, merge_multicaps: bool = False, model: str | None = None, model_sha256: str | None = None) -> dict:
    """Finds images and their keypoints; images that are there already keep their ids and get new keypoints. model: path or URL of a learned
    detector's file, kept in the project's cache and compared with model_sha256."""
    if model:
        model = models.cached(model, str(project.root / "cache" / "models"), model_sha256)
    where, layout = dataset.discover(dataset.list_files(spark, str(project.images_dir)))
    pixels = dataset.read_images(spark, str(project.images_dir)).join(where.withColumnRenamed("camera_id", "physical"), "name")
    old = project.read(spark, "images", "feature") if project.has("images") else None
    known = old.select("name", F.col("image_id").alias("id")) if old is not None else spark.createDataFrame([], "name string, id long")
    ids = staged(viewgraph.allocated(where.select("name"), known), "ids")
    pixels = pixels.join(ids.withColumnRenamed("id", "image_id"), "name")
    params = project.marker_params() or features.markers.MarkerParams()
    if find_params:
        params = features.tuned_markers(pixels)[0]
        project.save_marker_params(params)
    keypoints = staged(features.detect(pixels, detector, max_features, params, model), "keypoints")
    images = pixels.select("image_id", "name", "width", "height", "capture_id", "physical", "image_index")
    if merge_multicaps:
        images, keypoints = merged(spark, images, keypoints)
    images, cameras = _with_cameras(spark, project, staged(images, "images"))
    images = images.select("image_id", "camera_id", "name", "width", "height", F.col("capture_id").cast("long").alias("capture_id"), "physical", "image_index")
    if old is not None and not merge_multicaps:
        images = staged(viewgraph.upserted(old, images, ["image_id"]), "images")
        keypoints = viewgraph.upserted(project.read(spark, "keypoints", "feature").join(images.select("image_id"), "image_id", "left_semi"), keypoints, ["image_id"])
    # staged first: these may read the tables that they replace
    images, keypoints = staged(images, "images"), staged(keypoints, "keypoints")
    for name, df in (("images", images), ("keypoints", keypoints), ("cameras", cameras)):
        project.write(df, name)
    if detector == "aruco":
        features.corner_rows(keypoints, images).coalesce(1).write.mode("overwrite").csv(str(project.stage_dir("feature") / "corners.csv"), header=True)
    return _report(project, "feature", {"layout": layout, "detector": detector, "images": images.count(), "keypoints": keypoints.count(), "cameras": cameras.count()})


def merged(spark: SparkSession, images: DataFrame, keypoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All captures of a camera and slot under one image, keypoints numbered on in capture order; sizes must agree."""
    slot = images.groupBy("physical", "image_index").agg(F.min("image_id").alias("new_id"), F.count_distinct("width", "height").alias("sizes"), F.min("width").alias("width"), F.min("height").alias("height"))
    if slot.where("sizes > 1").head(1):
        raise ValueError("captures of one camera differ in size and can't be merged")
    k = keypoints.join(images.select("image_id", "physical", "image_index", "capture_id"), "image_id")
    m = viewgraph.merged_captures(k.select(F.col("physical").alias("camera"), F.col("image_index").alias("slot"), F.col("capture_id").alias("capture"), "kp"))
    k = k.join(m.select(F.col("camera").alias("physical"), F.col("slot").alias("image_index"), F.col("capture").alias("capture_id"), "kp", "new_kp"), ["physical", "image_index", "capture_id", "kp"])
    k = k.join(slot.select("physical", "image_index", "new_id"), ["physical", "image_index"])
    rest = [c for c in keypoints.columns if c not in ("image_id", "kp")]
    i = slot.select(F.col("new_id").alias("image_id"), F.format_string("cam%03d/slot%03d", "physical", "image_index").alias("name"), "width", "height", F.lit(-1).cast("long").alias("capture_id"), "physical", "image_index")
    return i, staged(k.select(F.col("new_id").alias("image_id"), F.col("new_kp").cast("int").alias("kp"), *rest), "merged")


def match(spark: SparkSession, project: Project, pairing: str = "sequential", matcher: str = "mnn-ratio", window: int = 10) -> dict:
    """Candidate pairs by the pairing, then matches that hold a relative pose. Earlier pairs are replaced."""
    if matcher != "mnn-ratio":
        raise NotImplementedError(f"matcher {matcher} is not implemented")
    if pairing in ("spatial", "aruco"):
        raise NotImplementedError(f"pairing {pairing} is not implemented")
    keypoints, images, cameras = (project.read(spark, n, "feature") for n in ("keypoints", "images", "cameras"))
    have = staged(images.join(keypoints.select("image_id").distinct(), "image_id", "left_semi"), "have")
    if have.count() < 2:
        raise RuntimeError("at least two images with keypoints are needed: run 'feature' first")
    if pairing == "vocab-tree":
        pairs = retrieval.vocabulary_pairs(keypoints.select(F.col("image_id").alias("image"), "kp", F.coalesce("desc_f", retrieval.unpacked(F.col("desc_b"))).alias("desc")), window)
        pairs = pairs if pairs is not None else matching.exhaustive_pairs(have, "image_id")
    elif pairing == "exhaustive":
        pairs = matching.exhaustive_pairs(have, "image_id")
    elif pairing == "sequential":
        pairs = matching.sequential_pairs(have, window, "image_id")
    else:
        raise ValueError(f"unknown pairing {pairing}")
    pairs = staged(pairs, "candidates")
    found = staged(reconstruct.verified(pairs, keypoints, images, cameras), "verified")
    project.write(found, "pairs")
    n = viewgraph.pair_counts(found).first()
    return _report(project, "match", {"pairing": pairing, "candidates": pairs.count(), "verified": n.verified, "matches": n.matches})


def known_poses(spark: SparkSession, project: Project, images: DataFrame) -> DataFrame | None:
    """Poses of the settings by exact image name; a name without an image is an error."""
    if not project.settings.poses:
        return None
    rows = [(p["image"], rotation_of(np.array(p["quaternion"], float)).ravel().tolist(), [float(x) for x in p["translation"]], bool(p.get("fixed", False))) for p in project.settings.poses]
    poses = spark.createDataFrame(rows, "name string, rotation array<double>, translation array<double>, fixed boolean")
    found, unknown = viewgraph.placed(poses, images)
    if lost := [r.name for r in unknown.collect()]:
        raise ValueError(f"poses for images that are not there: {lost}")
    return found


def map_(spark: SparkSession, project: Project, pipeline: str = "global") -> dict:
    """Poses and points by one of the two engines, written as the plain-text model."""
    images, cameras, keypoints = (project.read(spark, n, "feature") for n in ("images", "cameras", "keypoints"))
    pairs = project.read(spark, "pairs", "match")
    if images.count() < 2:
        raise RuntimeError("at least two images are needed: run 'feature' first")
    if not pairs.head(1):
        raise RuntimeError("no verified pairs: run 'match' first")
    held = [c["images"] for c in project.settings.cameras if not c.get("refine", True)]
    pinned = []
    if held:
        globs = spark.createDataFrame([(h,) for h in held], "pattern string")
        pinned = [r.camera_id for r in images.join(F.broadcast(globs), F.rlike("name", G.glob_regex(F.col("pattern"))), "left_semi").select("camera_id").distinct().collect()]
    if pipeline == "global":
        model = reconstruct.global_model(images, cameras, keypoints, pairs)
    elif pipeline == "incremental":
        model = reconstruct.incremental_model(images, cameras, keypoints, pairs, known_poses(spark, project, images), pinned, Growth())
    else:
        raise ValueError(f"unknown pipeline {pipeline}")
    model = tuple(staged(t, "model") for t in model)
    if not model[1].head(1):
        raise RuntimeError("no image could be registered: see the pairs of 'match'")
    colmap.write_model(*model, str(project.sparse_dir))
    return _report(project, "map", {"pipeline": pipeline, **_summary(*model)})


def read_model(spark: SparkSession, folder: str):
    return colmap.read_cameras(spark, f"{folder}/cameras.txt"), colmap.read_images(spark, f"{folder}/images.txt"), colmap.read_points(spark, f"{folder}/points3D.txt")


def _summary(cameras: DataFrame, images: DataFrame, points: DataFrame) -> dict:
    return {"cameras": cameras.count(), "images": images.count(), "points": points.count(), "mean_error": viewgraph.mean_error_weighted(points.select("error", F.size("track").alias("track"))).first()[0]}


def refine(spark: SparkSession, project: Project, robust_loss: str = "huber", refine_intrinsics: bool = False) -> dict:
    model = tuple(staged(t, "refined") for t in reconstruct.refined(*read_model(spark, str(project.sparse_dir)), robust_loss, refine_intrinsics))
    colmap.write_model(*model, str(project.sparse_dir))
    return _report(project, "refine", {"loss": robust_loss, **_summary(*model)})


def export(spark: SparkSession, project: Project, format: str = "colmap-text", out: str | None = None) -> dict:
    """Single files for other tools, part by part from what the model was written as."""
    out = out or str(project.root / "export")
    os.makedirs(out, exist_ok=True)
    if format == "colmap-text":
        for name in ("cameras.txt", "images.txt", "points3D.txt"):
            with open(f"{out}/{name}", "wb") as to:
                for part in sorted(glob.glob(f"{project.sparse_dir}/{name}/part-*")):
                    with open(part, "rb") as f:
                        shutil.copyfileobj(f, to)
    elif format == "nerf-transforms":
        cameras, images, _ = read_model(spark, str(project.sparse_dir))
        nerf.write_transforms(cameras, images, f"{out}/transforms.json")
    else:
        raise ValueError(f"unknown format {format}")
    return _report(project, "export", {"format": format, "out": out})


def eval_(spark: SparkSession, ours: str, baseline: str | None = None, gt: str | None = None) -> dict:
    if gt:
        raise NotImplementedError("comparison with true poses is not implemented")
    return {k: _summary(*read_model(spark, v)) for k, v in (("ours", ours), ("baseline", baseline)) if v}


def debug_pair(spark: SparkSession, project: Project, image1: int, image2: int) -> list[dict]:
    """Matches and inliers of one pair over the ratios and thresholds of the sweep."""
    keypoints, images, cameras = (project.read(spark, n, "feature") for n in ("keypoints", "images", "cameras"))
    k = staged(keypoints.where(F.col("image_id").isin(image1, image2)), "pair")
    pair = spark.createDataFrame([(min(image1, image2), max(image1, image2))], "i long, j long")
    out = []
    for ratio in RATIOS:
        n = reconstruct.putative(pair, k, ratio).count()
        for threshold in THRESHOLDS:
            v = reconstruct.verified(pair, k, images, cameras, ratio, threshold).select(F.size("inliers").alias("n")).first()
            out.append({"ratio": ratio, "threshold": threshold, "matches": n, "inliers": v.n if v else 0})
    return out


def run(spark: SparkSession, project: Project, detector: str = "sift", pairing: str = "sequential", matcher: str = "mnn-ratio", pipeline: str = "global") -> dict:
    return {"feature": feature(spark, project, detector), "match": match(spark, project, pairing, matcher), "map": map_(spark, project, pipeline), "export": export(spark, project)}


def _report(project: Project, stage: str, payload: dict) -> dict:
    os.makedirs(project.stage_dir(stage), exist_ok=True)
    (project.stage_dir(stage) / "report.json").write_text(json.dumps(payload, indent=1))
    project.record(stage, payload)
    return payload


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tessella")
    sub = top.add_subparsers(dest="command", required=True)
    new = sub.add_parser("project").add_subparsers(dest="action", required=True).add_parser("new")
    new.add_argument("dir")
    new.add_argument("--images", required=True)

    def stage(name, *options, aliases=()):
        p = sub.add_parser(name, aliases=aliases)
        p.add_argument("--project", default=".")
        for flag, kw in options:
            p.add_argument(flag, **kw)

    detector = ("--detector", {"default": "sift", "choices": ["sift", "akaze", "orb", "superpoint", "disk", "aruco"]})
    pairing = ("--pairing", {"default": "sequential", "choices": ["exhaustive", "sequential", "spatial", "vocab-tree", "aruco"]})
    matcher = ("--matcher", {"default": "mnn-ratio", "choices": ["mnn-ratio", "lightglue"]})
    pipeline = ("--pipeline", {"default": "global", "choices": ["global", "incremental"]})
    flag = {"action": "store_true"}
    stage("feature", detector, ("--aruco-dict", {}), ("--max-features", {"type": int}), ("--find-params", flag), ("--merge-multicaps", flag), ("--gpu", flag), ("--model", {}), ("--model-sha256", {}), aliases=["extract"])
    stage("match", pairing, matcher, ("--window", {"type": int, "default": 10}), ("--gpu", flag))
    stage("map", pipeline)
    stage("refine", ("--robust-loss", {"default": "huber", "choices": ["huber", "cauchy"]}), ("--refine-intrinsics", flag))
    stage("export", ("--format", {"default": "colmap-text", "choices": ["colmap-text", "nerf-transforms"]}), ("--out", {}))
    stage("eval", ("--ours", {"required": True}), ("--baseline", {}), ("--gt", {}))
    stage("debug-pair", ("--image1", {"type": int, "required": True}), ("--image2", {"type": int, "required": True}))
    stage("run", detector, pairing, matcher, pipeline)
    a = vars(top.parse_args(argv))
    command = {"extract": "feature"}.get(a["command"], a["command"])
    if command == "project":
        Project.create(a["dir"], a["images"])
        return
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    skip = {"command", "project", "aruco_dict", "gpu"}
    args = {k: v for k, v in a.items() if k not in skip}
    if command == "eval":
        print(json.dumps(eval_(spark, **args)))
        return
    f = {"feature": feature, "match": match, "map": map_, "refine": refine, "export": export, "debug-pair": debug_pair, "run": run}[command]
    print(json.dumps(f(spark, Project(a["project"]), **args), default=str))


if __name__ == "__main__":
    main()
