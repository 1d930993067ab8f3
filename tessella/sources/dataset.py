"""Image folders: layout, capture, camera and index of every image, as expressions over paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G

LAYOUTS = ("captures_and_cameras", "cameras_only", "flat")


def numbered(folders: DataFrame, parent: list[str], name: str, out: str) -> DataFrame:
    """Adds out to distinct folders: the number at the end of the name if all siblings have one and no two the same, else the place
    in name order."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    n = G.trailing_number(F.col(name))
    f = folders.withColumn("_n", n).withColumn("_all", F.count("*").over(w)).withColumn("_with", F.size(F.collect_set("_n").over(w)))
    return f.withColumn(out, F.when(F.col("_all") == F.col("_with"), F.col("_n")).otherwise(F.row_number().over(w.orderBy(name)) - 1).cast("long")).drop("_n", "_all", "_with")


def discover(paths: DataFrame) -> tuple[DataFrame, str]:
    """paths (name: relative, with either slash) -> (name, capture_id, camera_id, image_index), layout.

    Image files two folders down make captures x cameras; else those one folder down make cameras; else the files are flat and a
    leading cam<N> or camera<N> names the camera. Other files, and images at other depths than the layout's, are left out. No image
    at all is an error."""
    rows = paths.select(F.replace("name", F.lit("\\"), F.lit("/")).alias("name")).where(G.is_image_file(F.col("name")))
    rows = rows.withColumn("p", F.split("name", "/")).withColumn("depth", F.size("p") - 1)
    depths = {r.depth for r in rows.select("depth").where("depth < 3").distinct().collect()}
    if not depths:
        raise ValueError("no images found")
    depth = max(depths)
    rows = rows.where(F.col("depth") == depth)
    first, second = F.element_at("p", 1), F.element_at("p", 2)
    if depth == 2:
        cap = numbered(rows.select(first.alias("d1")).distinct(), [], "d1", "capture_id")
        cam = numbered(rows.select(first.alias("d1"), second.alias("d2")).distinct(), ["d1"], "d2", "camera_id")
        rows = rows.withColumn("d1", first).withColumn("d2", second).join(cap, "d1").join(cam, ["d1", "d2"])
    elif depth == 1:
        cam = numbered(rows.select(first.alias("d1")).distinct(), [], "d1", "camera_id")
        rows = rows.withColumn("d1", first).join(cam, "d1").withColumn("capture_id", F.lit(0).cast("long"))
    else:
        rows = rows.withColumn("capture_id", F.lit(0).cast("long")).withColumn("camera_id", F.coalesce(G.leading_camera_number(F.element_at("p", -1)), F.lit(0)).cast("long"))
    w = Window.partitionBy("capture_id", "camera_id").orderBy("name")
    return rows.select("name", "capture_id", "camera_id", (F.row_number().over(w) - 1).cast("long").alias("image_index")), LAYOUTS[2 - depth]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """name: paths under root relative to it; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    base = root.rstrip("/").removeprefix("file:").removeprefix("//") + "/"
    return f.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path")).select(F.substring_index("path", base, -1).alias("name"))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """name, width, height, channels, data of decoded images (Spark's image source; files it can't decode are left out)."""
    i = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root).select("image.*")
    base = root.rstrip("/").removeprefix("file:").removeprefix("//") + "/"
    return i.select(F.substring_index(F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))), base, -1).alias("name"), "width", "height", F.col("nChannels").alias("channels"), "data")
