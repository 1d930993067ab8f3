import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import averaging as V
from tessella.functions import bundle as B
from tessella.functions.kernels import rotation_vector
from tessella.operators import matching
from tessella.operators import reconstruct as R


def rig(n_images=4, n=40):
    t = np.arange(n)
    x = np.c_[0.5 * np.sin(0.37 * t), 0.4 * np.cos(0.53 * t), 4 + 0.08 * t]
    poses = [(rotation_vector(np.array([0.02 * i, -0.08 * i, 0.01 * i])), np.array([0.6 * i, 0.25 * (i % 3), 0.2 * (i % 2)])) for i in range(n_images)]
    return x, [(r, -r @ c) for r, c in poses]


@pytest.fixture(scope="module")
def tables(spark):
    x, poses = rig()
    cams = spark.createDataFrame([(1, "SIMPLE_PINHOLE", 640, 480, [750.0, 320.0, 240.0])], "camera_id long, model string, width int, height int, params array<double>")
    images = spark.createDataFrame([(i, 1, f"{i}.png") for i in range(5)], "image_id long, camera_id long, name string")
    kps = []
    for i, (r, t) in enumerate(poses):
        for k, p in enumerate(B.project("SIMPLE_PINHOLE", np.array([750.0, 320, 240]), x @ r.T + t, False)):
            kps.append((i, k, float(p[0]), float(p[1]), np.eye(40)[k].tolist(), None, None))
    kps += [(4, k, 10.0 * k, 5.0, (-np.eye(40)[k]).tolist(), None, None) for k in range(5)]
    keypoints = spark.createDataFrame(kps, "image_id long, kp int, x double, y double, desc_f array<double>, desc_b array<long>, desc_m struct<capture_id:long,marker_id:int,corner_index:int>")
    pairs = R.verified(matching.exhaustive_pairs(images, "image_id"), keypoints, images, cams)
    return cams, images, keypoints, R.staged(pairs, "pairs"), poses


def check(model, poses):
    cams, images, points = model
    rows = {r.image_id: r for r in images.collect()}
    assert set(rows) == {0, 1, 2, 3} and points.count() >= 30
    assert points.agg(F.max("error")).first()[0] < 0.5
    root = min(rows, key=lambda i: np.linalg.norm([rows[i].tx, rows[i].ty, rows[i].tz]))
    for i, r in rows.items():
        got = V.rotation_of(np.array([r.qw, r.qx, r.qy, r.qz]))
        assert np.allclose(got, poses[i][0] @ poses[root][0].T, atol=0.01)
    tr = points.first()
    kp = {r.image_id: r.points for r in rows.values()}
    assert all(kp[v.image_id][v.kp].point_id == tr.point_id for v in tr.track)


def test_pairs_are_verified(tables):
    cams, images, keypoints, pairs, poses = tables
    got = {(r.image1, r.image2): r for r in pairs.collect()}
    assert set(got) == {(i, j) for i in range(4) for j in range(i + 1, 4)} and all(len(r.inliers) >= 35 for r in got.values())
    assert {r.rank for r in R.triplet_ranks(pairs).collect()} == {0}


def test_global(tables):
    check(R.global_model(*tables[1:2], tables[0], tables[2], tables[3]), tables[4])


def test_incremental_and_refine(tables, spark, tmp_path):
    from tessella.sources import colmap

    cams, images, keypoints, pairs, poses = tables
    model = R.incremental_model(images, cams, keypoints, pairs)
    check(model, poses)
    colmap.write_model(*model, str(tmp_path))
    back = colmap.read_cameras(spark, f"{tmp_path}/cameras.txt"), colmap.read_images(spark, f"{tmp_path}/images.txt"), colmap.read_points(spark, f"{tmp_path}/points3D.txt")
    check(R.refined(*back, loss="cauchy", iterations=3), poses)


def test_markers_and_bits(spark):
    schema = "image_id long, kp int, x double, y double, desc_f array<double>, desc_b array<long>, desc_m struct<capture_id:long,marker_id:int,corner_index:int>"
    m = [(i, k, 1.0, 1.0, None, None, (c, k // 4, k % 4)) for i, c in ((0, 0), (1, 0), (2, 1)) for k in range(16)]
    b = [(i, k, 1.0, 1.0, None, [1 << (k * 3 + j) for j in range(3)] + [i - 3], None) for i in (3, 4) for k in range(16)]
    df = spark.createDataFrame(m + b, schema)
    images = spark.createDataFrame([(i, 1) for i in range(5)], "image_id long, camera_id long")
    cams = spark.createDataFrame([(1, "SIMPLE_PINHOLE", [750.0, 320.0, 240.0])], "camera_id long, model string, params array<double>")
    pairs = matching.exhaustive_pairs(images, "image_id")
    got = R.putative(pairs, df).groupBy("image1", "image2").count().collect()
    assert {(r.image1, r.image2): r["count"] for r in got} == {(0, 1): 16, (3, 4): 16}
    v = R.verified(pairs, df.where("image_id < 3"), images, cams).collect()
    assert [(r.image1, r.image2, r.rotation) for r in v] == [(0, 1, R.IDENTITY)]
