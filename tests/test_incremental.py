import numpy as np

from tessella.functions import averaging as V
from tessella.functions import bundle as B
from tessella.functions import incremental as I
from tessella.functions.kernels import rotation_vector


def scene(edges, n_images, n=40):
    """Points seen by cameras on an arc; edges with true relative poses of unit baseline."""
    t = np.arange(n)
    x = np.c_[0.5 * np.sin(0.37 * t), 0.4 * np.cos(0.53 * t), 4 + 0.08 * t]
    poses = {}
    for i in range(n_images):
        c = np.array([0.6 * i, 0.15 * (i % 3), 0.1 * (i % 2)])
        r = rotation_vector(np.array([0.02 * i, -0.08 * i, 0.01 * i]))
        poses[i] = (r, -r @ c)
    pixels = {i: {int(k): tuple(p) for k, p in enumerate(B.project("SIMPLE_PINHOLE", np.array([750.0, 320, 240]), x @ r.T + t_, False))} for i, (r, t_) in poses.items()}
    pairs = []
    for a, b in edges:
        r = poses[b][0] @ poses[a][0].T
        d = poses[b][1] - r @ poses[a][1]
        m = np.arange(n if (a, b) == (0, 1) else n - 1)
        pairs.append(I.Pair(a, b, r, d / np.linalg.norm(d), m, m))
    return x, poses, pixels, pairs


def centre_gap(got, want, root, other):
    """Largest distance of centres after the gauge (root at the identity, distance of the other camera)."""
    base = {i: (r @ want[root][0].T, t - r @ want[root][0].T @ want[root][1]) for i, (r, t) in want.items()}
    c = lambda p: -p[0].T @ p[1]
    s = np.linalg.norm(c(base[other]))
    g = np.linalg.norm(c(got[other]))
    return max(np.linalg.norm(c(got[i]) / g - c(base[i]) / s) for i in got)


def test_growth_registers_all_images():
    x, poses, pixels, pairs = scene([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], 4)
    m = I.grown({0: ("SIMPLE_PINHOLE", np.array([750.0, 320, 240]))}, {i: 0 for i in range(4)}, pixels, pairs, options=I.Growth(refine_intrinsics=False))
    assert len(m.poses) == 4 and sum(len(t) >= 2 for t in m.track) >= 30
    root = next(i for i, (r, t) in m.poses.items() if np.allclose(r, np.eye(3)) and np.allclose(t, 0))
    assert centre_gap(m.poses, poses, root, (root + 1) % 4) < 0.05


def test_known_poses_replace_the_seed():
    x, poses, pixels, pairs = scene([(0, 1), (0, 2), (1, 2)], 3)
    known = {i: (*poses[i], True) for i in (0, 1)}
    m = I.grown({0: ("SIMPLE_PINHOLE", np.array([750.0, 320, 240]))}, {i: 0 for i in range(3)}, pixels, pairs, known)
    assert np.array_equal(m.poses[0][0], poses[0][0]) and np.allclose(m.poses[2][1], poses[2][1], atol=1e-3)


def test_bridge_over_one_pair():
    x, poses, pixels, pairs = scene([(0, 1), (1, 2)], 3)
    pairs[1].k1, pairs[1].k2 = pairs[1].k1[:11], pairs[1].k2[:11]
    m = I.grown({0: ("SIMPLE_PINHOLE", np.array([750.0, 320, 240]))}, {i: 0 for i in range(3)}, pixels, pairs, options=I.Growth(refine_intrinsics=False))
    assert len(m.poses) == 3


def test_nothing_to_start_from():
    assert I.grown({0: ("SIMPLE_PINHOLE", np.array([750.0, 320, 240]))}, {0: 0, 1: 0}, {0: {}, 1: {}}, []) is None


def test_global_poses():
    _, poses, _, pairs = scene([(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3), (3, 4)], 5)
    root, got = V.global_poses([(p.i, p.j, p.r, p.t, 0) for p in pairs])
    assert root == 0 and len(got) == 5
    for i, (r, _) in got.items():
        assert np.allclose(r, poses[i][0] @ poses[root][0].T, atol=1e-6)
    assert centre_gap(got, poses, root, 1) < 0.05
    for r, _ in poses.values():
        assert np.allclose(V.rotation_of(V.quaternion(r)), r)


def test_rotation_averaging_outvotes_a_wrong_edge():
    _, poses, _, pairs = scene([(i, j) for i in range(6) for j in range(i + 1, 6)], 6)
    bad = [(p.i, p.j, rotation_vector(np.array([0, 0, 0.5])) @ p.r if n == 0 else p.r, 0) for n, p in enumerate(pairs)]
    got = V.refined_rotations(V.tree_rotations(bad, 5), bad, 5)
    assert max(V.angle(got[i].T @ poses[i][0] @ poses[5][0].T) for i in got) < 6
