"""Queries whose SQL is the closed-form truth of a scene: points from part, cameras with stated poses, everything recovered from the views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import bundle, kernels, markers
from tessella.operators import adjustment, estimation, reconstruct
from tessella.plans.catalog import query, r6, table
from tessella.sources import dataset

SCENE = "scene AS (SELECT p_partkey AS id, 1.5 * sin(p_partkey * 0.7) AS x, 1.2 * cos(p_partkey * 1.3) AS y, 5 + p_partkey % 100 * 0.03::DOUBLE AS z FROM part)"
# Pose of the second view.
TURN, SHIFT = 0.15, (1.0, 0.2, -0.1)


def _scene(s, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select(k.alias("id"), (1.5 * F.sin(k * 0.7)).alias("x"), (1.2 * F.cos(k * 1.3)).alias("y"), (5 + k % 100 * 0.03).alias("z"))


def _pose():
    c, n = np.cos(TURN), np.sin(TURN)
    return np.array([[c, 0, n], [0, 1, 0], [-n, 0, c]]), np.array(SHIFT)


def _seen(x, y, z):
    """Normalised coordinates in the second view."""
    r, t = _pose()
    c = [float(r[i][0]) * x + float(r[i][1]) * y + float(r[i][2]) * z + float(t[i]) for i in range(3)]
    return c[0] / c[2], c[1] / c[2]


def _constants(r, t):
    return ", ".join([f"{round(float(v), 4) + 0.0}::DOUBLE AS r{i}" for i, v in enumerate(np.ravel(r))] + [f"{round(float(v), 4) + 0.0}::DOUBLE AS t{i}" for i, v in enumerate(t)])


def _flat(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(F.get("rotation", F.lit(i)), 4).alias(f"r{i}") for i in range(9)), *(F.round(F.get("translation", F.lit(i)), 4).alias(f"t{i}") for i in range(3)))


@query(f"SELECT count(*) AS n, {_constants(_pose()[0], _pose()[1] / np.linalg.norm(SHIFT))} FROM part")
def two_view_pose(s, d):
    x, y, z = (F.col(c) for c in "xyz")
    u, v = _seen(x, y, z)
    m = _scene(s, d).select(F.lit(0).cast("long").alias("image1"), F.lit(1).cast("long").alias("image2"), F.col("id").alias("k1"), F.col("id").alias("k2"), (x / z).alias("x1"), (y / z).alias("y1"), u.alias("x2"), v.alias("y2"))
    return _flat(estimation.verified_pairs(m, 0.004).withColumn("n", F.size("inliers").cast("long")), "n")


@query(f"SELECT count(*) AS n, {_constants(*_pose())} FROM part")
def pnp_pose(s, d):
    u, v = _seen(*(F.col(c) for c in "xyz"))
    m = _scene(s, d).select(F.lit(1).cast("long").alias("image"), F.col("id").alias("kp"), u.alias("px"), v.alias("py"), "x", "y", "z")
    return _flat(estimation.resected(m, 0.01).withColumn("n", F.col("n_inliers")), "n")


def _views(s, d) -> DataFrame:
    """point, image, x, y normalised, rotation, translation of both views."""
    x, y, z = (F.col(c) for c in "xyz")
    u, v = _seen(x, y, z)
    r, t = _pose()
    lit = lambda a: F.array(*(F.lit(float(e)) for e in np.ravel(a)))
    view = lambda i, a, b, rot, tr: F.struct(F.lit(i).cast("long").alias("image"), a.alias("x"), b.alias("y"), lit(rot).alias("rotation"), lit(tr).alias("translation"))
    return _scene(s, d).select(F.col("id").alias("point"), F.explode(F.array(view(0, x / z, y / z, np.eye(3), np.zeros(3)), view(1, u, v, r, t))).alias("v")).select("point", "v.*")


@query(f"WITH {SCENE} SELECT id AS point, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, CAST(2 AS BIGINT) AS n_views FROM scene")
def triangulate_nview(s, d):
    return estimation.triangulated(_views(s, d)).select("point", r6(F.col("x"), "x"), r6(F.col("y"), "y"), r6(F.col("z"), "z"), "n_views")


@query(f"WITH {SCENE} SELECT id AS point, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM scene")
def bundle_adjust(s, d):
    """Points moved off by up to some centimetres come back to where both held views see them."""
    v = _views(s, d)
    r, t = _pose()
    cams = s.createDataFrame([(1, "SIMPLE_PINHOLE", [700.0, 320.0, 240.0])], "camera_id long, model string, params array<double>")
    images = s.createDataFrame([(0, 1, np.eye(3).ravel().tolist(), [0.0] * 3), (1, 1, r.ravel().tolist(), t.tolist())], "image_id long, camera_id long, rotation array<double>, translation array<double>")
    moved = _scene(s, d).select(F.col("id").alias("point_id"), (F.col("x") + 0.02 * F.sin(F.col("id") * 2.1)).alias("x"), (F.col("y") - 0.02 * F.cos(F.col("id") * 1.7)).alias("y"), (F.col("z") + 0.05 * F.sin(F.col("id") * 0.9)).alias("z"))
    obs = v.select(F.col("point").alias("point_id"), F.col("image").alias("image_id"), F.lit(0).alias("kp"), (700 * F.col("x") + 320).alias("x"), (700 * F.col("y") + 240).alias("y"))
    points, _, _ = adjustment.adjusted(adjustment.with_views(moved, obs), adjustment.Problem(cams, images), fixed_images=[0, 1], options=bundle.Options(iterations=6, loss="none"))
    return points.select(F.col("point_id").alias("point"), *(F.round(c, 3).alias(c) for c in "xyz"))


@query("WITH c AS (SELECT l_suppkey % 20 AS image, avg(l_quantity) AS cx, avg(l_extendedprice) AS cy FROM lineitem GROUP BY 1), m AS (SELECT l_suppkey % 20 AS image, avg(sqrt((l_quantity - cx) * (l_quantity - cx) + (l_extendedprice - cy) * (l_extendedprice - cy))) AS m FROM lineitem JOIN c ON l_suppkey % 20 = image GROUP BY 1) SELECT image, round(cx, 4) AS cx, round(cy, 4) AS cy, round(1e6 * sqrt(2) / m, 4) AS scale FROM c JOIN m USING (image)")
def hartley_normalise(s, d):
    k = table(s, d, "lineitem").select((F.col("l_suppkey") % 20).alias("image"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))

    def run(g):
        _, t = kernels.hartley(g[["x", "y"]].to_numpy())
        return pd.DataFrame({"image": [g.image.iloc[0]], "cx": [-t[0, 2] / t[0, 0]], "cy": [-t[1, 2] / t[1, 1]], "scale": [1e6 * t[0, 0]]})

    return k.groupBy("image").applyInPandas(run, "image long, cx double, cy double, scale double").select("image", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "scale")))


@query("WITH q AS (SELECT p_partkey AS id, i, CASE WHEN i IN (1, 2) THEN p_size ELSE 0 END AS x, CASE WHEN i IN (0, 1) THEN p_size % 7 + 1 ELSE 0 END AS y, p_size AS w, p_size % 7 + 1 AS h FROM part, (SELECT unnest([0, 1, 2, 3]) AS i)) SELECT id, list(i ORDER BY atan2(y - h / 2.0, x - w / 2.0), i) AS corners FROM q GROUP BY 1")
def corner_angle_order(s, d):
    w, h, o = F.col("p_size").cast("double"), (F.col("p_size") % 7 + 1).cast("double"), F.lit(0.0)
    xs, ys = (o, w, w, o), (h, h, o, o)

    def run(frames):
        for f in frames:
            corners = [np.array([a, b]).T for a, b in zip(f["xs"], f["ys"])]
            yield pd.DataFrame({"id": f.id, "corners": [[c.tolist().index(p) for p in markers.by_angle(c).tolist()] for c in corners]})

    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.array(*xs).alias("xs"), F.array(*ys).alias("ys")).mapInPandas(run, "id long, corners array<int>")


@query("WITH n AS (SELECT DISTINCT s_name AS name FROM supplier), p AS (SELECT name, CAST(nullif(regexp_extract(name, '([0-9]+)$', 1), '') AS BIGINT) AS v, row_number() OVER (ORDER BY name) - 1 AS o FROM n) SELECT name, CASE WHEN (SELECT count(*) = count(DISTINCT v) FROM p) THEN v ELSE o END AS id FROM p")
def ids_from_names(s, d):
    return dataset.numbered(table(s, d, "supplier").select(F.col("s_name").alias("name")).distinct(), [], "name", "id")


@query(f"WITH {SCENE} SELECT row_number() OVER (ORDER BY id) AS point_id, round(x, 6) AS x, round((5 * (id % 5))::DOUBLE, 6) AS error, CAST(2 AS BIGINT) AS views FROM scene")
def assembled_points(s, d):
    """Views that are off by 3 and 4 times a small number: the mean error of a point is 5 times it."""
    r, t = _pose()
    cams = s.createDataFrame([(1, "SIMPLE_PINHOLE", 640, 480, [700.0, 320.0, 240.0])], "camera_id long, model string, width int, height int, params array<double>")
    images = s.createDataFrame([(0, 1, "a", np.eye(3).ravel().tolist(), [0.0] * 3), (1, 1, "b", r.ravel().tolist(), t.tolist())], "image_id long, camera_id long, name string, rotation array<double>, translation array<double>")
    off = F.col("point") % 5
    kp = _views(s, d).select(F.col("point").alias("point_id"), F.col("image").alias("image_id"), F.col("point").cast("int").alias("kp"), (700 * F.col("x") + 320 + 3 * off).alias("x"), (700 * F.col("y") + 240 - 4 * off).alias("y"))
    points = adjustment.with_views(_scene(s, d).withColumnRenamed("id", "point_id"), kp)
    found = reconstruct.assembled(images.drop("rotation", "translation"), cams, kp.drop("point_id"), points, adjustment.Problem(cams, images))[2]
    return found.select("point_id", r6(F.col("x"), "x"), r6(F.col("error"), "error"), F.size("track").cast("long").alias("views"))
