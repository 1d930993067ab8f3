import numpy as np

from tessella.functions import bundle as B
from tessella.functions.kernels import rotation_vector
from tessella.operators import adjustment as A
from tessella.operators.tracks import tracks
from tests.test_bundle import two_views


def test_tables_give_what_the_local_kernel_gives(spark):
    x, rot, trans, image, point, seen = two_views()
    start = x + np.random.default_rng(0).normal(0, 0.03, x.shape)
    r1, t1 = rotation_vector(np.array([0.01, -0.02, 0.01])) @ rot[1], trans[1] + [0.03, -0.02, 0.02]
    o = B.Options(iterations=4)
    _, r, t, p, cost = B.adjust(["SIMPLE_PINHOLE"], [np.array([700.0, 320, 240])], np.zeros(2, int), np.stack([rot[0], r1]), np.stack([trans[0], t1]), start, image, point, seen, np.array([True, False]), options=o)
    cams = spark.createDataFrame([(5, "SIMPLE_PINHOLE", [700.0, 320.0, 240.0])], "camera_id long, model string, params array<double>")
    images = spark.createDataFrame([(10, 5, np.eye(3).ravel().tolist(), [0.0] * 3), (11, 5, r1.ravel().tolist(), t1.tolist()), (12, 5, None, None)], "image_id long, camera_id long, rotation array<double>, translation array<double>")
    pts = spark.createDataFrame([(i, *map(float, start[i])) for i in range(25)], "point_id long, x double, y double, z double")
    obs = spark.createDataFrame([(int(k), int(i) + 10, int(k), *map(float, s)) for i, k, s in zip(image, point, seen)] + [(3, 12, 0, 1.0, 1.0)], "point_id long, image_id long, kp int, x double, y double")
    got, problem, c = A.adjusted(A.with_views(pts, obs).repartition(3), A.Problem(cams, images), fixed_images=[10], options=o)
    assert abs(c - cost) < 1e-6 * max(1, cost) and np.allclose(problem.rot, r, atol=1e-7) and np.allclose(problem.trans, t, atol=1e-7)
    assert np.allclose([[q.x, q.y, q.z] for q in got.orderBy("point_id").collect()], p, atol=1e-6)
    e = A.point_errors(got, problem).toPandas()
    assert len(e) == 50 and e.error.max() < 2


def test_tracks(spark):
    rows = [(0, 1, 1, 1), (1, 1, 2, 1), (0, 2, 2, 1), (3, 0, 4, 0), (3, 0, 4, 0), (5, 0, None, 1)]
    df = spark.createDataFrame(rows, "image1 long, k1 int, image2 long, k2 int")
    group = lambda d: sorted(sorted((r.image_id, r.kp) for r in d.collect() if r.track == t) for t in {r.track for r in d.collect()})
    assert group(tracks(df)) == [[(0, 1), (1, 1), (2, 1)], [(3, 0), (4, 0)]] or group(tracks(df)) == [[(0, 1), (1, 1)], [(0, 2), (2, 1)], [(3, 0), (4, 0)]]
    assert group(tracks(df, exclusive=False)) == [[(0, 1), (0, 2), (1, 1), (2, 1)], [(3, 0), (4, 0)]]
    assert tracks(df.limit(0)).count() == 0
