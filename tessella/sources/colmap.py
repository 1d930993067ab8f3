"""The plain-text sparse model: cameras.txt, images.txt, points3D.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without blank and comment lines, their tokens, and their number in the file."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    t = F.trim("value")
    return text.where((t != "") & ~t.startswith("#")).select("line", F.split(t, r"\s+").alias("t"))


def _numbers(tokens, begin: int):
    return F.transform(F.slice(tokens, begin, F.greatest(F.size(tokens) - begin + 1, F.lit(0))), lambda x: x.cast("double"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, model, width, height, params; lines of fewer than four tokens are an error."""
    rows = _lines(spark, path)
    ok = F.when(F.size("t") < 4, F.raise_error(F.concat(F.lit("cameras.txt: too few tokens in line "), F.col("line").cast("string")))).otherwise(F.col("t"))
    rows = rows.select(ok.alias("t"))
    return rows.select(F.get("t", F.lit(0)).cast("long").alias("camera_id"), F.get("t", F.lit(1)).alias("model"), F.get("t", F.lit(2)).cast("int").alias("width"),
                       F.get("t", F.lit(3)).cast("int").alias("height"), _numbers(F.col("t"), 5).alias("params"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """image_id, qw, qx, qy, qz, tx, ty, tz, camera_id, name, points (array of x, y, point_id; null for none).

    An image is two lines, the second possibly empty, so blank lines count here."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    kept = text.where(~F.trim("value").startswith("#"))
    w = Window.orderBy("line")
    two = kept.withColumn("n", F.row_number().over(w) - 1).withColumn("next", F.lead("value").over(w)).where("n % 2 = 0 AND trim(value) <> ''")
    t, p = F.split(F.trim("value"), r"\s+"), F.filter(F.split(F.trim(F.coalesce("next", F.lit(""))), r"\s+"), lambda x: x != "")
    at = lambda i: F.get("t", F.lit(i))
    triple = F.transform(F.when(F.size("p") >= 3, F.sequence(F.lit(0), F.floor(F.size("p") / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        F.get("p", i * 3).cast("double").alias("x"), F.get("p", i * 3 + 1).cast("double").alias("y"),
        F.when(F.get("p", i * 3 + 2) != "-1", F.get("p", i * 3 + 2).cast("long")).alias("point_id")))
    return two.select(t.alias("t"), p.alias("p")).select(
        at(0).cast("long").alias("image_id"), *(at(i + 1).cast("double").alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))),
        at(8).cast("long").alias("camera_id"), at(9).alias("name"), triple.alias("points"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """point_id, x, y, z, r, g, b, error, track (array of image_id, kp)."""
    at = lambda i: F.get("t", F.lit(i))
    track = F.transform(F.when(F.size("t") >= 10, F.sequence(F.lit(4), F.floor((F.size("t") - 8) / 2).cast("int") + 3)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(
        F.get("t", i * 2).cast("long").alias("image_id"), F.get("t", i * 2 + 1).cast("int").alias("kp")))
    return _lines(spark, path).select(
        at(0).cast("long").alias("point_id"), *(at(i + 1).cast("double").alias(n) for i, n in enumerate("xyz")),
        *(at(i + 4).cast("short").alias(n) for i, n in enumerate("rgb")), at(7).cast("double").alias("error"), track.alias("track"))


def camera_lines(cameras: DataFrame) -> DataFrame:
    """id, line: one line of cameras.txt per camera."""
    return cameras.select(F.col("camera_id").alias("id"), F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"),
                          F.array_join(F.transform("params", lambda x: F.format_string("%.10f", x)), " ")).alias("line"))


def point_lines(points: DataFrame) -> DataFrame:
    xyz = [F.format_string("%.10f", c) for c in "xyz"]
    track = F.array_join(F.transform("track", lambda e: F.concat_ws(" ", e["image_id"].cast("string"), e["kp"].cast("string"))), " ")
    return points.select(F.col("point_id").alias("id"), F.concat_ws(" ", F.col("point_id").cast("string"), *xyz, *(F.col(c).cast("string") for c in "rgb"), F.format_string("%.6f", "error"), track).alias("line"))


def image_lines(images: DataFrame) -> DataFrame:
    """id, line: both lines of images.txt per image, joined by a line feed."""
    pose = [F.format_string("%.10f", c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")]
    head = F.concat_ws(" ", F.col("image_id").cast("string"), *pose, F.col("camera_id").cast("string"), "name")
    pts = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", F.format_string("%.3f", p["x"]), F.format_string("%.3f", p["y"]), F.coalesce(p["point_id"], F.lit(-1)).cast("string"))), " ")
    return images.select(F.col("image_id").alias("id"), F.concat_ws("\n", head, pts).alias("line"))


def write_model(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> None:
    """The three files as folders of one text part each, in id order, under the usual names."""
    counts = images.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size(F.filter("points", lambda p: p["point_id"].isNotNull()))), F.lit(0.0)).alias("m")).first()
    heads = {
        "cameras.txt": ["# Camera list with one line of data per camera:", "#   CAMERA_ID, MODEL, WIDTH, HEIGHT, PARAMS[]", f"# Number of cameras: {cameras.count()}"],
        "images.txt": ["# Image list with two lines of data per image:", "#   IMAGE_ID, QW, QX, QY, QZ, TX, TY, TZ, CAMERA_ID, NAME / POINTS2D[] as (X, Y, POINT3D_ID)", f"# Number of images: {counts.n}, mean observations per image: {counts.m:.1f}"],
        "points3D.txt": ["# 3D point list with one line of data per point:", "#   POINT3D_ID, X, Y, Z, R, G, B, ERROR, TRACK[] as (IMAGE_ID, POINT2D_IDX)", f"# Number of points: {points.count()}"],
    }
    spark = cameras.sparkSession
    for (name, head), lines in zip(heads.items(), (camera_lines(cameras), image_lines(images), point_lines(points))):
        top = spark.createDataFrame([(i - 3, h) for i, h in enumerate(head)], "id long, line string")
        top.unionByName(lines).orderBy("id").select("line").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
