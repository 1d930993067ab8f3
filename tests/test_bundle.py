import numpy as np
import pytest

from tessella.functions import bundle as B
from tessella.functions.kernels import rotation_vector

PARAMS = {
    "SIMPLE_PINHOLE": [700.0, 320.0, 240.0], "PINHOLE": [700.0, 710.0, 320.0, 240.0], "SIMPLE_RADIAL": [700.0, 320.0, 240.0, -0.05],
    "RADIAL": [700.0, 320.0, 240.0, -0.05, 0.02], "OPENCV": [700.0, 710.0, 320.0, 240.0, -0.05, 0.02, 0.001, -0.002],
    "OPENCV_FISHEYE": [700.0, 710.0, 320.0, 240.0, 0.05, -0.01, 0.004, 0.001],
}


def euler(r, p, y):
    return rotation_vector(np.array([0, 0, y])) @ rotation_vector(np.array([0, p, 0])) @ rotation_vector(np.array([r, 0, 0]))


@pytest.mark.parametrize("model", sorted(PARAMS))
def test_derivatives_agree_with_differences(model):
    params = np.array(PARAMS[model])
    point, rot, trans = np.array([[0.35, -0.18, 2.7]]), euler(-0.15 * 2, 0.08, -0.15)[None], np.array([[0.6, -0.2, 1.3]])
    at = lambda p, r, t, x: B.residuals([model], [p], np.array([0]), r, t, x, np.array([0]), np.array([0]), np.array([[410.0, 260.0]]), True)
    _, ok, jp, jx, jc = at(params, rot, trans, point)
    assert ok[0]
    h = 1e-6
    for i in range(6):
        d = np.eye(6)[i] * h
        f = [at(params, (rotation_vector(s * d[:3]) @ rot[0])[None], trans + s * d[3:], point)[0][0] for s in (1, -1)]
        assert np.allclose(jp[0, :, i], (f[0] - f[1]) / (2 * h), rtol=1e-5, atol=1e-3)
    for i in range(3):
        d = np.eye(3)[i] * h
        f = [at(params, rot, trans, point + s * d)[0][0] for s in (1, -1)]
        assert np.allclose(jx[0, :, i], (f[0] - f[1]) / (2 * h), rtol=1e-5, atol=1e-3)
    for i in range(len(params)):
        d = np.eye(len(params))[i] * h
        f = [at(params + s * d, rot, trans, point)[0][0] for s in (1, -1)]
        assert np.allclose(jc[0, :, i], (f[0] - f[1]) / (2 * h), rtol=1e-4, atol=1e-3)


def two_views():
    t = np.arange(25)
    x = np.c_[0.5 * np.sin(0.6 * t), 0.4 * np.cos(0.4 * t), 3 + 0.1 * t]
    rot, trans = np.stack([np.eye(3), euler(0.02, 0.2, -0.01)]), np.array([[0, 0, 0], [0.8, 0.05, 0.1]])
    image, point = np.repeat([0, 1], 25), np.tile(t, 2)
    pixel = B.residuals(["SIMPLE_PINHOLE"], [np.array([700.0, 320, 240])], np.zeros(2, int), rot, trans, x, image, point, np.zeros((50, 2)))[0]
    return x, rot, trans, image, point, pixel


def test_adjustment_brings_points_and_pose_back():
    x, rot, trans, image, point, seen = two_views()
    g = np.random.default_rng(0)
    args = (["SIMPLE_PINHOLE"], [np.array([700.0, 320, 240])], np.zeros(2, int))
    start_t = trans + np.array([[0, 0, 0], [0.03, -0.02, 0.02]])
    start = (np.stack([rot[0], rotation_vector(np.array([0.01, -0.02, 0.01])) @ rot[1]]), start_t, x + g.normal(0, 0.03, x.shape))
    before = B.total_cost(*B.residuals(*args, *start, image, point, seen), "huber", 2.0)
    _, r, t, p, cost = B.adjust(*args, *start, image, point, seen, np.array([True, False]))
    assert cost < 0.01 * before and np.sqrt((B.residuals(*args, r, t, p, image, point, seen)[0] ** 2).sum(1).mean()) < 0.5
    assert np.array_equal(r[0], np.eye(3)) and (t[0] == 0).all()


def test_focal_length_is_recovered_and_principal_point_stays():
    t = np.arange(60)
    x = np.c_[0.8 * np.sin(0.31 * t), 0.7 * np.cos(0.47 * t), 2.5 + 0.15 * t]
    rot = np.stack([np.eye(3), euler(0.02, 0.25, -0.01), euler(-0.2, 0.1, 0.05), euler(0.1, -0.3, 0.02)])
    trans = np.array([[0, 0, 0], [-0.9, 0.05, 0.1], [0.2, 0.8, 0.2], [1.0, -0.2, 0.3]])
    image, point = np.repeat(np.arange(4), 60), np.tile(t, 4)
    args = (["SIMPLE_PINHOLE"], [np.array([1500.0, 320, 240])], np.zeros(4, int))
    seen = B.residuals(*args, rot, trans, x, image, point, np.zeros((240, 2)))[0]
    params, *_ = B.adjust(args[0], [np.array([1000.0, 320, 240])], args[2], rot, trans, x * [1, 1, 0.8], image, point, seen, np.array([True, False, False, False]),
                          refine=[0], options=B.Options(iterations=200))
    assert abs(params[0][0] - 1500) < 30 and tuple(params[0][1:]) == (320, 240)


def test_intrinsics_only():
    t = np.arange(40)
    p = np.c_[0.4 * np.sin(0.6 * t), 0.3 * np.cos(0.4 * t), 3 + 0.05 * t]
    seen = B.project("SIMPLE_PINHOLE", np.array([1500.0, 960, 540]), p, False)
    assert abs(B.intrinsics_only("SIMPLE_PINHOLE", [960.0, 960, 540], p, seen)[0] - 1500) < 1
    assert B.intrinsics_only("SIMPLE_PINHOLE", [960.0, 960, 540], p[:7], seen[:7])[0] == 960
    with pytest.raises(ValueError):
        B.project("PINHOLE", np.array([1.0]), p)


def test_blocks_add_up_over_points():
    x, rot, trans, image, point, seen = two_views()
    args = (["SIMPLE_PINHOLE"], [np.array([650.0, 320, 240])], np.zeros(2, int))

    def part(keep):
        e, ok, jp, jx, jc = B.residuals(*args, rot, trans, x, image[keep], point[keep], seen[keep], True)
        return B.reduced(jp, jx, jc, e, B.weights(e, "huber", 2.0) * ok, image[keep], args[2][image[keep]], point[keep], 25, np.ones(25, bool), 1e-3)[:2]

    whole, a, b = part(point >= 0), part(point < 10), part(point >= 10)
    for i in (0, 1):
        for k, v in whole[i].items():
            assert np.allclose(v, a[i].get(k, 0) + b[i].get(k, 0), rtol=1e-7, atol=1e-6)
