"""Bundle adjustment over tables: points and their views stay partitioned, the driver holds poses and cameras only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import bundle
from tessella.storage import staged

#: The reduced system is dense in the poses; more images than this are refused rather than tried.
MOST_IMAGES = 3000
BLOCKS = "k1 string, i long, k2 string, j long, pos int, v double"
POINTS = "point_id long, x double, y double, z double, views array<struct<image_id:long,kp:int,x:double,y:double>>"


def with_views(points: DataFrame, observations: DataFrame) -> DataFrame:
    """Points with their views in one row: a track sees an image once, so a row is bounded by MOST_IMAGES. Points without a view go."""
    views = observations.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("image_id").cast("long").alias("image_id"), F.col("kp").cast("int").alias("kp"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("views"))
    return points.select("point_id", "x", "y", "z").join(views, "point_id")


class Problem:
    """Cameras and poses as arrays; what tasks get of them is bounded by MOST_IMAGES."""

    def __init__(self, cameras: DataFrame, images: DataFrame):
        c = cameras.select("camera_id", "model", "params").orderBy("camera_id").limit(MOST_IMAGES + 1).collect()
        i = images.select("image_id", "camera_id", "rotation", "translation").where("rotation IS NOT NULL").orderBy("image_id").limit(MOST_IMAGES + 1).collect()
        if max(len(c), len(i)) > MOST_IMAGES:
            raise ValueError(f"more than {MOST_IMAGES} images or cameras: adjust parts of the model one by one")
        self.camera_ids, self.image_ids = [r.camera_id for r in c], [r.image_id for r in i]
        self.models, self.params = [r.model for r in c], [np.array(r.params, float) for r in c]
        at = {k: n for n, k in enumerate(self.camera_ids)}
        self.camera_of = np.array([at[r.camera_id] for r in i], int)
        self.rot = np.array([r.rotation for r in i], float).reshape(-1, 3, 3)
        self.trans = np.array([r.translation for r in i], float).reshape(-1, 3)

    def arrays(self, frame: pd.DataFrame):
        """Points, and image, point and pixel of the views of a frame; views of unknown images are left out."""
        at = {k: n for n, k in enumerate(self.image_ids)}
        rows = [(at[v["image_id"]], n, v["x"], v["y"]) for n, views in enumerate(frame.views) for v in views if v["image_id"] in at]
        a = np.array(rows, float).reshape(-1, 4)
        return frame[["x", "y", "z"]].to_numpy(float), a[:, 0].astype(int), a[:, 1].astype(int), a[:, 2:]


def point_errors(points: DataFrame, problem: Problem) -> DataFrame:
    """Adds error to each view (pixels; null behind the camera): point_id, x, y, z, image_id, kp, px, py, error."""

    def run(frames):
        for f in frames:
            x, image, point, seen = problem.arrays(f)
            e, ok = bundle.residuals(problem.models, problem.params, problem.camera_of, problem.rot, problem.trans, x, image, point, seen)
            kp = [v["kp"] for views in f.views for v in views if v["image_id"] in set(problem.image_ids)]
            yield pd.DataFrame({"point_id": f.point_id.to_numpy()[point], "x": x[point, 0], "y": x[point, 1], "z": x[point, 2], "image_id": np.array(problem.image_ids, np.int64)[image],
                                "kp": kp, "px": seen[:, 0], "py": seen[:, 1], "error": np.where(ok, np.linalg.norm(e, axis=1), np.nan)})

    return points.mapInPandas(run, "point_id long, x double, y double, z double, image_id long, kp int, px double, py double, error double").withColumn("error", F.nanvl("error", F.lit(None).cast("double")))


def adjusted(points: DataFrame, problem: Problem, fixed_images=(), refine_cameras=(), fixed_points: bool = False, options: bundle.Options = bundle.Options()) -> tuple[DataFrame, Problem, float]:
    """Damped least squares: every round sums blocks of the reduced system over the partitions of points (partial sums in each task,
    then by block), solves it on the driver, and scores the step in a second pass; a step that is kept writes the points anew, so lost
    executors cost one pass. -> points, problem, cost."""
    free = bundle.free_masks(problem.models, problem.camera_of, [k in set(fixed_images) for k in problem.image_ids], [problem.camera_ids.index(c) for c in refine_cameras])
    o = options

    def prepared(f, damping):
        x, image, point, seen = problem.arrays(f)
        e, ok, jp, jx, jc = bundle.residuals(problem.models, problem.params, problem.camera_of, problem.rot, problem.trans, x, image, point, seen, True)
        w, camera = bundle.weights(e, o.loss, o.scale) * ok, problem.camera_of[image]
        mask = np.full(len(x), not fixed_points)
        return (x, image, camera, point, seen, mask), bundle.total_cost(e, ok, o.loss, o.scale), bundle.reduced(jp, jx, jc, e, w, image, camera, point, len(x), mask, damping)

    def blocks(damping):
        def run(frames):
            total, sums = 0.0, {}
            for f in frames:
                if not len(f):
                    continue
                _, cost, (lhs, rhs, diag, _) = prepared(f, damping)
                total += cost
                for group in ({(*k,): v for k, v in lhs.items()}, {(*k, "r", 0): v for k, v in rhs.items()}, {(*k, "d", 0): v for k, v in diag.items()}):
                    for k, v in group.items():
                        sums[k] = sums.get(k, 0) + np.ravel(v)
            yield pd.DataFrame({"k1": ["cost"], "i": [0], "k2": [""], "j": [0], "pos": [0], "v": [total]})
            for k, v in sums.items():
                yield pd.DataFrame({"k1": k[0], "i": int(k[1]), "k2": k[2], "j": int(k[3]), "pos": np.arange(len(v), dtype=np.int32), "v": v})

        if not free:  # all poses and cameras are held: points move by themselves, there is no system to sum
            return {}, {}, {}, cost if cost is not None else cost_of(points)
        rows = points.mapInPandas(run, BLOCKS).groupBy("k1", "i", "k2", "j", "pos").agg(F.sum("v").alias("v")).toPandas()
        lhs, rhs, diag, total = {}, {}, {}, 0.0
        for (k1, i, k2, j), g in rows.sort_values("pos").groupby(["k1", "i", "k2", "j"], sort=False):
            v = g.v.to_numpy()
            if k1 == "cost":
                total = float(v[0])
            elif k2 in "rd":
                (rhs if k2 == "r" else diag)[k1, i] = v
            else:
                lhs[k1, i, k2, j] = v.reshape(6 if k1 == "p" else 8, -1)
        return lhs, rhs, diag, total

    def cost_of(table):
        def run(frames):
            for f in frames:
                x, image, point, seen = problem.arrays(f)
                yield pd.DataFrame({"cost": [bundle.total_cost(*bundle.residuals(problem.models, problem.params, problem.camera_of, problem.rot, problem.trans, x, image, point, seen), o.loss, o.scale)]})

        return table.mapInPandas(run, "cost double").agg(F.sum("cost")).first()[0] or 0.0

    def stepped(step, damping):
        new = bundle.moved(problem.params, problem.rot, problem.trans, step)

        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                (x, image, camera, point, seen, mask), _, (_, _, _, back) = prepared(f, damping)
                x = x + bundle.point_steps(back, image, camera, point, step) * mask[:, None]
                e, ok = bundle.residuals(problem.models, new[0], problem.camera_of, new[1], new[2], x, image, point, seen)
                f = f.copy()
                f["x"], f["y"], f["z"] = x.T
                f["cost"] = np.bincount(point, bundle.weights(e, o.loss, o.scale) * (e * e).sum(1) * ok, minlength=len(x))
                yield f

        return points.select(*(c.split()[0] for c in ("point_id", "x", "y", "z", "views"))).mapInPandas(run, POINTS + ", cost double"), new

    points = staged(points.select("point_id", "x", "y", "z", "views"), "points")
    damping, cost = o.damping, None
    for _ in range(o.iterations):
        grow, kept = 2.0, False
        for _ in range(o.inner):
            lhs, rhs, diag, cost = blocks(damping)
            step = bundle.solve(lhs, rhs, diag, free, damping)
            if step is not None:
                table, new = stepped(step, damping)
                table = staged(table, "points")
                after = table.agg(F.sum("cost")).first()[0] or 0.0
                if np.isfinite(after) and after < cost:
                    kept = True
                    break
            damping, grow = damping * grow, grow * 2
        if not kept:
            break
        points = table.drop("cost")
        problem.params, problem.rot, problem.trans = new
        gain, cost, damping = (cost - after) / max(cost, 1e-300), after, max(damping / 3, 1e-12)
        if gain < o.tolerance:
            break
    return points, problem, cost or 0.0


def without_outliers(points: DataFrame, problem: Problem, threshold: float = 4.0, least: int = 12, rounds: int = 2, min_views: int = 2, **kw) -> tuple[DataFrame, Problem, float]:
    """Adjust, drop views off by more than threshold pixels or behind their camera, and points of fewer than min_views, and adjust again; at most
    rounds times, ending when nothing is dropped or fewer than least views would stay."""
    points, problem, cost = adjusted(points, problem, **kw)
    for _ in range(rounds):
        e = staged(point_errors(points, problem), "errors")
        good = e.where((F.col("error") <= threshold))
        total, kept = e.count(), good.count()
        if kept == total or kept < least:
            break
        views = good.groupBy("point_id", "x", "y", "z").agg(F.array_sort(F.collect_list(F.struct("image_id", "kp", F.col("px").alias("x"), F.col("py").alias("y")))).alias("views"))
        points, problem, cost = adjusted(views.where(F.size("views") >= min_views), problem, **kw)
    return points, problem, cost


def poses(problem: Problem, images: DataFrame) -> DataFrame:
    """The images table with the problem's rotation and translation."""
    rows = [(int(k), r.ravel().tolist(), t.tolist()) for k, r, t in zip(problem.image_ids, problem.rot, problem.trans)]
    new = images.sparkSession.createDataFrame(rows, "image_id long, rotation array<double>, translation array<double>")
    return images.drop("rotation", "translation").join(new, "image_id", "left")


def cameras(problem: Problem, table: DataFrame) -> DataFrame:
    rows = [(int(k), p.tolist()) for k, p in zip(problem.camera_ids, problem.params)]
    return table.drop("params").join(table.sparkSession.createDataFrame(rows, "camera_id long, params array<double>"), "camera_id")
