"""From keypoints to a sparse model: verified pairs, then poses and points by a global or an incremental engine."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import averaging, bundle, incremental
from tessella.functions import geometry as G
from tessella.operators import adjustment, estimation, graph, matching, viewgraph
from tessella.operators.tracks import tracks
from tessella.storage import staged

IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
PAIRS = "image1 long, image2 long, rotation array<double>, translation array<double>, inliers array<struct<k1:long,k2:long>>"


def normalised(keypoints: DataFrame, images: DataFrame, cameras: DataFrame) -> DataFrame:
    """image_id, kp, x, y (pixels), nx, ny, f (mean focal length); distortion is not undone."""
    m, p = F.col("model"), F.col("params")
    (fx, fy), (cx, cy) = G.focal_lengths(m, p), G.principal_point(m, p)
    i = images.select("image_id", "camera_id").join(cameras.select("camera_id", fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy")), "camera_id")
    return keypoints.join(i, "image_id").select("image_id", "kp", "x", "y", ((F.col("x") - F.col("cx")) / F.col("fx")).alias("nx"), ((F.col("y") - F.col("cy")) / F.col("fy")).alias("ny"),
                                                ((F.col("fx") + F.col("fy")) / 2).alias("f"))


def putative(pairs: DataFrame, keypoints: DataFrame, ratio: float = 0.8) -> DataFrame:
    """image1, image2, k1, k2 by the kind of descriptor that both images have: float and binary by mutual nearest neighbours with the ratio test,
    markers by identity. Images of different kinds have no matches."""
    k = keypoints.withColumnRenamed("image_id", "image")
    out = matching.match_float_products(pairs, k.where("desc_f IS NOT NULL").select("image", "kp", F.col("desc_f").alias("desc")), ratio)
    bits = k.where("desc_b IS NOT NULL").select("image", "kp", F.col("desc_b").alias("desc"))
    return out.unionByName(matching.match_float_products(pairs, bits, ratio, linear=True, bits=True)).unionByName(_markers(pairs, k))


def _markers(pairs: DataFrame, k: DataFrame) -> DataFrame:
    m = k.where("desc_m IS NOT NULL").select("image", "kp", "desc_m")
    first = m.groupBy(F.col("image").alias("image2"), "desc_m").agg(F.min("kp").alias("k2"))
    left = pairs.select(F.col("i").alias("image1"), F.col("j").alias("image2")).join(m.select(F.col("image").alias("image1"), F.col("kp").alias("k1"), "desc_m"), "image1")
    return left.join(first, ["image2", "desc_m"]).select("image1", "image2", F.col("k1").cast("long").alias("k1"), F.col("k2").cast("long").alias("k2"))


def verified(pairs: DataFrame, keypoints: DataFrame, images: DataFrame, cameras: DataFrame, ratio: float = 0.8, threshold_px: float = 4.0, min_inliers: int = 15) -> DataFrame:
    """Pairs whose matches hold one relative pose. Marker pairs are taken as they are, with the identity as pose."""
    spark = keypoints.sparkSession
    m = staged(putative(pairs, keypoints, ratio), "matches")
    n = normalised(keypoints, images, cameras)
    marker = keypoints.where("desc_m IS NOT NULL").select(F.col("image_id").alias("image1")).distinct()
    m = m.join(viewgraph.enough_matches(m, min_inliers), ["image1", "image2"])
    a = n.select(F.col("image_id").alias("image1"), F.col("kp").alias("k1"), F.col("nx").alias("x1"), F.col("ny").alias("y1"), F.col("f").alias("f1"))
    b = n.select(F.col("image_id").alias("image2"), F.col("kp").alias("k2"), F.col("nx").alias("x2"), F.col("ny").alias("y2"), F.col("f").alias("f2"))
    full = m.join(marker, "image1", "left_anti").join(a, ["image1", "k1"]).join(b, ["image2", "k2"]).withColumn("threshold", F.lit(threshold_px) * 2 / (F.col("f1") + F.col("f2")))
    out = estimation.verified_pairs(full.select("image1", "image2", "k1", "k2", "x1", "y1", "x2", "y2", "threshold"), None, min_inliers)
    same = m.join(marker, "image1", "left_semi").groupBy("image1", "image2").agg(F.array_sort(F.collect_list(F.struct("k1", "k2"))).alias("inliers"))
    same = same.select("image1", "image2", F.array(*map(F.lit, IDENTITY)).alias("rotation"), F.array(*(F.lit(0.0) for _ in range(3))).alias("translation"), "inliers")
    return spark.createDataFrame([], PAIRS).unionByName(out).unionByName(same)


def triplet_ranks(pairs: DataFrame, tolerance_deg: float = 5.0) -> DataFrame:
    """Adds rank: 0 if a triangle of pairs closes within the tolerance, 1 without any triangle, null if all its triangles fail. Triangles
    are two equality joins, on the common image and on the closing pair."""
    e = pairs.select(F.col("image1").alias("a"), F.col("image2").alias("b"), F.col("rotation").alias("r"))
    ab, bc, ac = e, e.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("r").alias("r2")), e.select("a", F.col("b").alias("c"), F.col("r").alias("r3"))
    g = lambda c, i, j: F.get(F.col(c), F.lit(3 * i + j))
    trace = sum((g("r2", i, k) * g("r", k, j) * g("r3", i, j) for i in range(3) for j in range(3) for k in range(3)), F.lit(0.0))
    loops = ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c", (F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2)))) <= tolerance_deg).alias("good"))
    votes = loops.select(F.explode(F.array(F.struct(F.col("a").alias("image1"), F.col("b").alias("image2")), F.struct(F.col("b").alias("image1"), F.col("c").alias("image2")),
                                           F.struct(F.col("a").alias("image1"), F.col("c").alias("image2")))).alias("e"), "good")
    votes = votes.groupBy("e.image1", "e.image2").agg(F.max("good").alias("good"))
    return pairs.join(votes, ["image1", "image2"], "left").withColumn("rank", F.when(F.col("good"), F.lit(0)).when(F.col("good").isNull(), F.lit(1))).drop("good")


def largest_component(pairs: DataFrame) -> DataFrame:
    """image_id of the images in the component of most images, the one of the highest id on ties."""
    c = graph.connected_components(pairs, "image1", "image2")
    best = c.groupBy("component").count().orderBy(F.desc("count"), F.desc("component")).limit(1)
    return c.join(best, "component", "left_semi").select(F.col("id").alias("image_id"))


def global_model(images: DataFrame, cameras: DataFrame, keypoints: DataFrame, pairs: DataFrame, min_inliers: int = 15, min_angle: float = 1.0, track_error: float = 20.0,
                 final_error: float = 4.0, refine_intrinsics: bool = False, loss: str = "huber"):
    """All poses at once, then tracks, points and adjustment -> cameras, images, points as in the sparse model.

    Pose averaging gets one row per pair without its matches, of one component; matches, tracks and points stay distributed."""
    ranked = staged(triplet_ranks(pairs.where(F.size("inliers") >= min_inliers)), "ranked")
    valid = ranked.where("rank IS NOT NULL")
    members = staged(largest_component(valid), "members")

    def average(g: pd.DataFrame) -> pd.DataFrame:
        edges = [(int(i), int(j), np.array(r).reshape(3, 3), np.array(t), int(k)) for i, j, r, t, k in g[["image1", "image2", "rotation", "translation", "rank"]].sort_values(["image1", "image2"]).itertuples(index=False)]
        root, poses = averaging.global_poses(edges)
        return pd.DataFrame([(i, r.ravel().tolist(), t.tolist(), i == root) for i, (r, t) in poses.items()], columns=["image_id", "rotation", "translation", "root"])

    inside = valid.join(members.withColumnRenamed("image_id", "image1"), "image1", "left_semi").withColumn("one", F.lit(0))
    posed = staged(inside.groupBy("one").applyInPandas(average, "image_id long, rotation array<double>, translation array<double>, root boolean"), "poses")
    root = [r.image_id for r in posed.where("root").collect()]
    seen = images.select("image_id", "camera_id").join(posed.drop("root"), "image_id")
    both = pairs.join(members.withColumnRenamed("image_id", "image1"), "image1", "left_semi").join(members.withColumnRenamed("image_id", "image2"), "image2", "left_semi")
    track = staged(tracks(both.select("image1", "image2", F.explode("inliers").alias("m")).select("image1", F.col("m.k1").alias("k1"), "image2", F.col("m.k2").alias("k2"))), "tracks")
    n = normalised(keypoints, images, cameras).join(track.withColumnRenamed("track", "point"), ["image_id", "kp"])
    views = staged(n.join(seen.drop("camera_id"), "image_id").select("point", F.col("image_id").alias("image"), "kp", F.col("nx"), F.col("ny"), "x", "y", "rotation", "translation"), "views")
    xyz = estimation.triangulated(views.select("point", "image", F.col("nx").alias("x"), F.col("ny").alias("y"), "rotation", "translation"))
    problem = adjustment.Problem(cameras, seen)
    obs = views.select(F.col("point").alias("point_id"), F.col("image").alias("image_id"), "kp", "x", "y")
    start = staged(adjustment.with_views(xyz.select(F.col("point").alias("point_id"), "x", "y", "z"), obs), "start")
    bad = adjustment.point_errors(start, problem).where(F.col("error").isNull() | (F.col("error") > track_error)).select("point_id").distinct()
    start = wide_enough(start.join(bad, "point_id", "left_anti"), problem, min_angle)
    free = _refinable(images.join(posed, "image_id", "left_semi")) if refine_intrinsics else []
    points, problem, _ = adjustment.without_outliers(start, problem, final_error, fixed_images=root, refine_cameras=free, options=bundle.Options(loss=loss))
    return assembled(images, cameras, keypoints, points, problem)


def _refinable(images: DataFrame, least: int = 5) -> list:
    return [r.camera_id for r in images.groupBy("camera_id").count().where(F.col("count") >= least).collect()]


def wide_enough(points: DataFrame, problem: adjustment.Problem, degrees: float) -> DataFrame:
    """Points that two of their views see under at least the angle."""
    c = -np.einsum("nji,nj->ni", problem.rot, problem.trans)
    centres = points.sparkSession.createDataFrame([(int(k), *map(float, x)) for k, x in zip(problem.image_ids, c)], "image_id long, cx double, cy double, cz double")
    rays = points.select("point_id", "x", "y", "z", F.explode("views.image_id").alias("image_id")).join(F.broadcast(centres), "image_id")  # MOST_IMAGES rows at most
    seen = rays_of(rays.withColumnRenamed("point_id", "point"))
    wide = viewgraph.max_view_angle(seen).where(F.col("widest") >= degrees).select(F.col("point").alias("point_id"))
    return points.join(wide, "point_id", "left_semi")


def rays_of(views: DataFrame) -> DataFrame:
    """(point, x, y, z, cx, cy, cz) -> point, dx, dy, dz: the unit vector from each point to the camera's centre."""
    d = [F.col(f"c{a}") - F.col(a) for a in "xyz"]
    norm = F.greatest(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(1e-12))
    return views.select("point", *((e / norm).alias(f"d{a}") for a, e in zip("xyz", d)))


def incremental_model(images: DataFrame, cameras: DataFrame, keypoints: DataFrame, pairs: DataFrame, known: DataFrame | None = None, pinned=(), options: incremental.Growth = incremental.Growth()):
    """Growth from a seed in each component of the view graph; the model of most images -> cameras, images, points.

    A component is a group: growth is sequential by nature. known: image_id, rotation, translation, fixed."""
    options = replace(options, pinned=frozenset(pinned))
    part = graph.connected_components(pairs, "image1", "image2").select(F.col("id").alias("image_id"), "component")
    k = keypoints.select("image_id", "kp", "x", "y")
    m = pairs.select("image1", "image2", "rotation", "translation", F.explode("inliers").alias("m")).select("image1", "image2", "rotation", "translation", F.col("m.k1").alias("k1"), F.col("m.k2").alias("k2"))
    m = m.join(k.toDF("image1", "k1", "x1", "y1"), ["image1", "k1"]).join(k.toDF("image2", "k2", "x2", "y2"), ["image2", "k2"])
    one = m.groupBy("image1", "image2", "rotation", "translation").agg(F.array_sort(F.collect_list(F.struct("k1", "k2", "x1", "y1", "x2", "y2"))).alias("m"))
    edges = one.join(part.withColumnRenamed("image_id", "image1"), "image1")
    info = images.select("image_id", "camera_id").join(cameras.select("camera_id", "model", "params"), "camera_id").join(part, "image_id")
    info = info.join(known.select("image_id", F.col("rotation").alias("known_r"), F.col("translation").alias("known_t"), "fixed"), "image_id", "left") if known is not None else info.selectExpr(
        "*", "cast(null as array<double>) known_r", "cast(null as array<double>) known_t", "cast(null as boolean) fixed")
    out_schema = "component long, kind string, id long, model string, a array<double>, b array<double>, views array<struct<image_id:long,kp:int,x:double,y:double>>"

    def run(key, e: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        cams = {int(r.camera_id): (r.model, np.array(r.params, float)) for r in i.itertuples()}
        camera_of = {int(r.image_id): int(r.camera_id) for r in i.sort_values("image_id").itertuples()}
        known = {int(r.image_id): (np.array(r.known_r).reshape(3, 3), np.array(r.known_t), bool(r.fixed)) for r in i.itertuples() if r.known_r is not None}
        pixels, ps = {n: {} for n in camera_of}, []
        for r in e.sort_values(["image1", "image2"]).itertuples():
            for v in r.m:
                pixels[r.image1][int(v["k1"])], pixels[r.image2][int(v["k2"])] = (v["x1"], v["y1"]), (v["x2"], v["y2"])
            ps.append(incremental.Pair(int(r.image1), int(r.image2), np.array(r.rotation).reshape(3, 3), np.array(r.translation), np.array([v["k1"] for v in r.m], int), np.array([v["k2"] for v in r.m], int)))
        model = incremental.grown(cams, camera_of, pixels, ps, known, options)
        rows = []
        if model is not None:
            rows += [(key[0], "camera", c, n, [float(x) for x in p], None, None) for c, (n, p) in model.cameras.items()]
            rows += [(key[0], "image", n, None, r.ravel().tolist(), t.tolist(), None) for n, (r, t) in model.poses.items()]
            for n, (x, t) in enumerate(zip(model.xyz, model.track)):
                if len(t) >= 2:
                    rows.append((key[0], "point", n + 1, None, [float(c) for c in x], None, [{"image_id": int(a), "kp": int(b), "x": float(pixels[a][b][0]), "y": float(pixels[a][b][1])} for a, b in sorted(t.items())]))
        return pd.DataFrame(rows, columns=["component", "kind", "id", "model", "a", "b", "views"])

    info = staged(info, "image-info")
    found = staged(edges.groupBy("component").cogroup(info.groupBy("component")).applyInPandas(run, out_schema), "grown")
    best = found.where("kind = 'image'").groupBy("component").count().orderBy(F.desc("count"), "component").first()
    if best is None:
        raise RuntimeError("no image could be registered: too few or too weak pairs")
    found = found.where(F.col("component") == best.component)
    cams = cameras.join(found.where("kind = 'camera'").select(F.col("id").alias("camera_id"), F.col("a").alias("new")), "camera_id", "left").withColumn("params", F.coalesce("new", "params")).drop("new")
    posed = images.select("image_id", "camera_id").join(found.where("kind = 'image'").select(F.col("id").alias("image_id"), F.col("a").alias("rotation"), F.col("b").alias("translation")), "image_id")
    points = found.where("kind = 'point'").select(F.col("id").alias("point_id"), *(F.get("a", F.lit(n)).alias(c) for n, c in enumerate("xyz")), "views")
    return assembled(images, cams, keypoints, points, adjustment.Problem(cams, posed))


def with_quaternions(images: DataFrame) -> DataFrame:
    """rotation and translation -> qw, qx, qy, qz, tx, ty, tz."""

    def run(batches):
        for b in batches:
            q = np.array([averaging.quaternion(np.array(r).reshape(3, 3)) for r in b.rotation]).reshape(-1, 4)
            t = np.array(b.translation.tolist(), float).reshape(-1, 3)
            yield pd.DataFrame({"image_id": b.image_id, **dict(zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), np.hstack([q, t]).T))})

    q = images.select("image_id", "rotation", "translation").mapInPandas(run, "image_id long, " + ", ".join(f"{c} double" for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")))
    return images.drop("rotation", "translation").join(q, "image_id")


def with_rotations(images: DataFrame) -> DataFrame:
    q = [F.col(c) for c in ("qw", "qx", "qy", "qz")]
    return images.withColumn("rotation", F.array(*(c for row in G.rotation(q) for c in row))).withColumn("translation", F.array("tx", "ty", "tz"))


def assembled(images: DataFrame, cameras: DataFrame, keypoints: DataFrame, points: DataFrame, problem: adjustment.Problem):
    """The sparse model: all cameras; posed images with their keypoints and the points these belong to; points numbered from 1 in the order of
    their ids, with the mean error of their views."""
    e = staged(adjustment.point_errors(points, problem), "errors")
    pts = e.groupBy("point_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("error"),
                                    F.array_sort(F.collect_list(F.struct("image_id", "kp"))).alias("track")).where(F.size("track") >= 2)
    ids = pts.select("point_id").withColumn("new_id", F.row_number().over(Window.orderBy("point_id")).cast("long"))
    gray = F.lit(180).cast("short")
    pts = staged(pts.join(ids, "point_id").select(F.col("new_id").alias("point_id"), "x", "y", "z", gray.alias("r"), gray.alias("g"), gray.alias("b"), "error", "track"), "model-points")
    link = pts.select("point_id", F.explode("track").alias("v")).select("v.image_id", "v.kp", "point_id")
    posed = adjustment.poses(problem, images).where("rotation IS NOT NULL")
    kp = keypoints.select("image_id", "kp", "x", "y").join(link, ["image_id", "kp"], "left")
    kp = kp.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("kp", "x", "y", "point_id"))).alias("k"))
    kp = kp.select("image_id", F.transform("k", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["point_id"].alias("point_id"))).alias("points"))
    out = with_quaternions(posed).join(kp, "image_id", "left")
    return adjustment.cameras(problem, cameras).select("camera_id", "model", "width", "height", "params"), out, pts


def refined(cameras: DataFrame, images: DataFrame, points: DataFrame, loss: str = "huber", refine_intrinsics: bool = False, iterations: int = 200):
    """Adjusts a sparse model that was read: the first image stays, error of points is taken anew."""
    posed = staged(with_rotations(images), "posed")
    kp = posed.select("image_id", F.posexplode("points").alias("kp", "p")).where("p.point_id IS NOT NULL").select(F.col("p.point_id").alias("point_id"), "image_id", "kp", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    first = posed.agg(F.min("image_id")).first()[0]
    table = adjustment.with_views(points, kp)
    problem = adjustment.Problem(cameras, posed)
    free = _refinable(posed) if refine_intrinsics else []
    table, problem, _ = adjustment.adjusted(table, problem, fixed_images=[first], refine_cameras=free, options=bundle.Options(iterations=iterations, loss=loss))
    keypoints = posed.select("image_id", F.posexplode("points").alias("kp", "p")).select("image_id", "kp", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return assembled(images.drop("points", "qw", "qx", "qy", "qz", "tx", "ty", "tz"), cameras, keypoints, table, problem)
