"""The view graph: degrees, triplets, co-visibility, next images, errors of models, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.geometry import upper_median


def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))


def degree(edges: DataFrame) -> DataFrame:
    return both_directions(edges).groupBy("i").agg(F.count("*").alias("degree"))


def covisible(observations: DataFrame, top: int = 6) -> DataFrame:
    """image, other, shared, rank: the images that share the most points, ties to the lower image."""
    o = observations.select("image", "point").distinct()
    pairs = o.join(o.withColumnRenamed("image", "other"), "point").where("image <> other").groupBy("image", "other").agg(F.count("*").alias("shared"))
    w = Window.partitionBy("image").orderBy(F.desc("shared"), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def next_best_view(observations: DataFrame, registered: DataFrame) -> DataFrame:
    """The unregistered image that sees the most points of registered ones, the lowest on ties."""
    o = observations.select("image", "point").distinct()
    seen = o.join(registered, "image", "left_semi").select("point").distinct()
    left = o.join(registered, "image", "left_anti").join(seen, "point", "left_semi").groupBy("image").agg(F.count("*").alias("points"))
    return left.orderBy(F.desc("points"), "image").limit(1)


def bridge_candidate(pairs: DataFrame, registered: DataFrame, excluded: DataFrame) -> DataFrame:
    """Of the pairs (i, j, inliers, pos) with exactly one registered end the one with the most inliers, the last on ties."""
    r = registered.select(F.col("image").alias("r"))
    p = pairs.join(r, F.col("i") == F.col("r"), "left").withColumn("ri", F.col("r").isNotNull()).drop("r")
    p = p.join(r, F.col("j") == F.col("r"), "left").withColumn("rj", F.col("r").isNotNull()).drop("r")
    return p.where("ri <> rj").join(excluded, ["i", "j"], "left_anti").orderBy(F.desc("inliers"), F.desc("pos")).limit(1).select("i", "j", "inliers", "pos")


def mean_error_weighted(points: DataFrame) -> DataFrame:
    """Mean of error weighted by track length; 0 without points."""
    return points.agg(F.coalesce(F.sum(F.col("error") * F.col("track")) / F.sum("track"), F.lit(0.0)).alias("mean_error"))


def max_view_angle(rays: DataFrame) -> DataFrame:
    """(point, dx, dy, dz: unit vector towards the camera of a view) -> point, n, widest: the largest angle in degrees between two rays of a track
    of two views and more. A track has a view an image, so its row is bounded."""
    tracks = rays.groupBy("point").agg(F.collect_list(F.array("dx", "dy", "dz")).alias("v")).where(F.size("v") >= 2)
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    least = F.array_min(F.transform("v", lambda a: F.array_min(F.transform("v", lambda b: dot(a, b)))))
    return tracks.select("point", F.size("v").cast("long").alias("n"), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), least)))).alias("widest"))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The upper median of a column by key."""
    return rows.groupBy(key).agg(upper_median(F.collect_list(value)).alias("median"))


def merged_captures(keypoints: DataFrame) -> DataFrame:
    """(camera, slot, capture, kp) -> camera, slot, name, kp, capture, source_kp: keypoints of all captures of a camera slot under one
    image, numbered on in capture and keypoint order."""
    w = Window.partitionBy("camera", "slot").orderBy("capture", "kp")
    return keypoints.select("camera", "slot", F.format_string("cam%03d/slot%03d", "camera", "slot").alias("name"), (F.row_number().over(w) - 1).cast("long").alias("new_kp"), "capture", "kp")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of old without a successor, and all of new."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def allocated(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name) and known (name, id) -> name, id: known ids stay, new names get max + 1 and on in name order."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()[0]
    new = names.join(known, "name", "left_anti").select("name", (F.lit(top) + F.row_number().over(Window.orderBy("name"))).cast("long").alias("id"))
    return names.join(known, "name").select("name", F.col("id").cast("long").alias("id")).unionByName(new)


def placed(poses: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """poses by image name -> poses with image_id, and the names that no image has."""
    return poses.join(images.select("name", "image_id"), "name").drop("name"), poses.join(images, "name", "left_anti").select("name")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs, and matches in all."""
    return pairs.agg(F.count("*").alias("verified"), F.coalesce(F.sum(F.size("inliers")), F.lit(0)).cast("long").alias("matches"))


def enough_matches(matches: DataFrame, min_inliers: int) -> DataFrame:
    """image1, image2 of the pairs that can hold a pose: max(min_inliers, 8) matches and more."""
    return matches.groupBy("image1", "image2").count().where(F.col("count") >= max(min_inliers, 8)).drop("count")
