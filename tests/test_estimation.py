import numpy as np

from tessella.functions import kernels as K
from tessella.operators.estimation import resected, triangulated, verified_pairs


def scene(seed, n=80, outliers=16):
    g = np.random.default_rng(seed)
    x = np.c_[g.uniform(-2, 2, (n, 2)), g.uniform(4, 8, n)]
    r, t = K.rotation_vector(np.array([0.05, -0.2, 0.1])), np.array([1.0, 0.2, -0.1])
    c = x @ r.T + t
    p1, p2 = x[:, :2] / x[:, 2:], c[:, :2] / c[:, 2:]
    p2 = p2.copy()
    p2[:outliers] += g.uniform(0.2, 0.6, (outliers, 2))
    return x, r, t, p1, p2


def test_two_view_and_triangulation(spark):
    x, r, t, p1, p2 = scene(1)
    rows = [(0, 1, i, i, *map(float, (*p1[i], *p2[i]))) for i in range(len(x))] + [(0, 2, i, i, 0.1, 0.1, 0.2, 0.2) for i in range(9)]
    got = verified_pairs(spark.createDataFrame(rows, "image1 long, image2 long, k1 long, k2 long, x1 double, y1 double, x2 double, y2 double"), 1e-3).collect()
    assert [(g.image1, g.image2) for g in got] == [(0, 1)]
    assert np.allclose(np.array(got[0].rotation).reshape(3, 3), r, atol=1e-6) and np.allclose(got[0].translation, t / np.linalg.norm(t), atol=1e-6)
    assert {e.k1 for e in got[0].inliers} == set(range(16, 80))
    eye = np.eye(3).ravel().tolist()
    obs = [row for i in range(16, 80) for row in ((i, 0, *map(float, p1[i]), eye, [0.0] * 3), (i, 1, *map(float, p2[i]), r.ravel().tolist(), t.tolist()))] + [(5, 0, 0.0, 0.0, eye, [0.0] * 3)]
    pts = {p.point: (p.x, p.y, p.z) for p in triangulated(spark.createDataFrame(obs, "point long, image long, x double, y double, rotation array<double>, translation array<double>")).collect()}
    assert set(pts) == set(range(16, 80)) and all(np.allclose(pts[i], x[i], atol=1e-6) for i in pts)


def test_pnp(spark):
    x, r, t, _, p2 = scene(2)
    rows = [(7, i, *map(float, (*p2[i], *x[i]))) for i in range(len(x))] + [(8, i, 0.0, 0.0, 1.0, 1.0, 1.0) for i in range(5)]
    got = resected(spark.createDataFrame(rows, "image long, kp long, px double, py double, x double, y double, z double"), 0.01).collect()
    assert [(g.image, g.n_inliers) for g in got] == [(7, 64)]
    assert np.allclose(np.array(got[0].rotation).reshape(3, 3), r, atol=1e-8) and np.allclose(got[0].translation, t, atol=1e-8)


def test_ransac_is_deterministic():
    a = [K.Xorshift(5).below(100) for _ in range(2)]
    assert a[0] == a[1] and K.ransac(3, 8, 1.0, 1, None, None) is None
