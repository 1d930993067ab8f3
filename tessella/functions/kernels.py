"""Numeric kernels on NumPy arrays; operators run them as grouped maps, one group a pair, image or point."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
SEED_TWO_VIEW, SEED_PNP = 0xC0FFEE, 0xFACADE


class Xorshift:
    """Deterministic 64-bit generator (shifts 13, 7, 17), so that robust estimates repeat."""

    def __init__(self, seed: int):
        self.state = (seed | 1) & _MASK

    def below(self, bound: int) -> int:
        x = self.state
        x ^= (x << 13) & _MASK
        x ^= x >> 7
        x ^= (x << 17) & _MASK
        self.state = x
        return x % bound


def ransac(n: int, size: int, threshold: float, seed: int, estimate, residuals, iterations: int = 2000, confidence: float = 0.999):
    """(model, inlier mask) with the most residuals strictly below the threshold, the first on ties; None without a model.
    The number of rounds shrinks with the share of inliers. Residuals come as one array over all n."""
    if n < size:
        return None
    rng, best, most, limit, done = Xorshift(seed), None, 0, iterations, 0
    order = list(range(n))
    while done < limit:
        done += 1
        for i in range(size):
            j = i + rng.below(n - i)
            order[i], order[j] = order[j], order[i]
        model = estimate(np.array(order[:size]))
        if model is None:
            continue
        mask = residuals(model) < threshold
        count = int(mask.sum())
        if count > most:
            best, most = (model, mask), count
            share = (count / n) ** size
            if share >= 1:
                break
            if share > 0:
                limit = min(limit, max(1, int(np.ceil(np.log(1 - confidence) / np.log(1 - share)))))
    return best


def null_vector(a: np.ndarray) -> np.ndarray:
    # the left vectors, rows x rows, are needed by nobody
    return np.linalg.svd(a, full_matrices=a.shape[0] < a.shape[1])[2][-1]


def hartley(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their centroid and scaled to a mean distance of sqrt 2, and the transform."""
    c = p.mean(axis=0)
    d = np.linalg.norm(p - c, axis=1).mean()
    s = np.sqrt(2) / d if d > 1e-12 else 1.0
    return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def fundamental(p1: np.ndarray, p2: np.ndarray) -> np.ndarray | None:
    """Normalised eight-point estimate of rank 2 with x2' F x1 = 0."""
    if len(p1) < 8:
        return None
    a, t1 = hartley(p1)
    b, t2 = hartley(p2)
    rows = np.stack([b[:, 0] * a[:, 0], b[:, 0] * a[:, 1], b[:, 0], b[:, 1] * a[:, 0], b[:, 1] * a[:, 1], b[:, 1], a[:, 0], a[:, 1], np.ones(len(a))], axis=1)
    u, s, v = np.linalg.svd(null_vector(rows).reshape(3, 3))
    return t2.T @ (u @ np.diag([s[0], s[1], 0.0]) @ v) @ t1


def essential(p1: np.ndarray, p2: np.ndarray) -> np.ndarray | None:
    f = fundamental(p1, p2)
    if f is None:
        return None
    u, s, v = np.linalg.svd(f)
    m = (s[0] + s[1]) / 2
    return u @ np.diag([m, m, 0.0]) @ v


def sampson(f: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    h1, h2 = np.hstack([p1, np.ones((len(p1), 1))]), np.hstack([p2, np.ones((len(p2), 1))])
    l2, l1 = h1 @ f.T, h2 @ f
    d = l2[:, 0] ** 2 + l2[:, 1] ** 2 + l1[:, 0] ** 2 + l1[:, 1] ** 2
    e = (h2 * l2).sum(axis=1)
    return np.where(d < 1e-12, np.finfo(float).max, e * e / np.maximum(d, 1e-12))


def triangulate(poses: list[tuple[np.ndarray, np.ndarray]], views: np.ndarray) -> np.ndarray | None:
    """Linear point from two views and more: (R, t) of each and normalised image points."""
    if len(poses) < 2:
        return None
    rows = []
    for (r, t), (x, y) in zip(poses, views):
        p = np.hstack([r, t[:, None]])
        rows += [x * p[2] - p[0], y * p[2] - p[1]]
    h = null_vector(np.array(rows))
    return None if abs(h[3]) < 1e-12 else h[:3] / h[3]


def relative_pose(e: np.ndarray, p1: np.ndarray, p2: np.ndarray, inliers: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of the four poses of an essential matrix the one with the most of up to 50 inliers in front of both cameras."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    best, most, eye = None, 0, (np.eye(3), np.zeros(3))
    for r in (u @ w @ v, u @ w.T @ v):
        for t in (u[:, 2], -u[:, 2]):
            votes = 0
            for i in inliers[:50]:
                x = triangulate([eye, (r, t)], np.array([p1[i], p2[i]]))
                votes += x is not None and x[2] > 1e-6 and (r @ x + t)[2] > 1e-6
            if votes > most:
                best, most = (r, t / np.linalg.norm(t)), votes
    return best


def two_view(p1: np.ndarray, p2: np.ndarray, threshold: float, iterations: int = 2000):
    """(R, unit t, inlier mask) from normalised matches; threshold in the same units. The refit on inliers is kept if it has no
    fewer of them. None where nothing holds."""
    found = ransac(len(p1), 8, threshold**2, SEED_TWO_VIEW, lambda s: essential(p1[s], p2[s]), lambda e: sampson(e, p1, p2), iterations)
    if found is None or found[1].sum() < 8:
        return None
    e, mask = found
    again = essential(p1[mask], p2[mask])
    if again is not None:
        other = sampson(again, p1, p2) < threshold**2
        if other.sum() >= mask.sum():
            e, mask = again, other
    pose = relative_pose(e, p1, p2, np.flatnonzero(mask))
    return None if pose is None else (*pose, mask)


def rotation_vector(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if a < 1e-12:
        return np.eye(3) + k
    k = k / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def pnp_linear(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """World to camera pose from six 3-D points and more with normalised image points."""
    if len(x) < 6:
        return None
    c = np.cov(x.T)
    values = np.linalg.eigvalsh(c)
    if values[2] < 1e-12 or values[0] / values[2] <= 1e-3:
        return None
    h = np.hstack([x, np.ones((len(x), 1))])
    z = np.zeros_like(h)
    rows = np.vstack([np.hstack([h, z, -p[:, :1] * h]), np.hstack([z, h, -p[:, 1:] * h])])
    m = null_vector(rows).reshape(3, 4)
    if (h @ m[2]).mean() < 0:
        m = -m
    u, s, v = np.linalg.svd(m[:, :3])
    r = u @ v
    if np.linalg.det(r) < 0:
        return None
    return r, m[:, 3] / s.mean()


def pnp_residual(pose, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    c = x @ pose[0].T + pose[1]
    ok = c[:, 2] > 1e-9
    z = np.where(ok, c[:, 2], 1.0)
    return np.where(ok, np.hypot(c[:, 0] / z - p[:, 0], c[:, 1] / z - p[:, 1]), np.inf)


def refine_pose(pose, x: np.ndarray, p: np.ndarray, iterations: int = 10):
    """Gauss-Newton steps on the reprojection error in normalised units."""
    r, t = pose
    for _ in range(iterations):
        c = x @ r.T + t
        ok = c[:, 2] > 1e-9
        c, q = c[ok], p[ok]
        if len(c) < 3:
            break
        z = c[:, 2]
        e = np.stack([c[:, 0] / z - q[:, 0], c[:, 1] / z - q[:, 1]], axis=1)
        d = np.zeros((len(c), 2, 3))
        d[:, 0, 0] = d[:, 1, 1] = 1 / z
        d[:, 0, 2], d[:, 1, 2] = -c[:, 0] / z**2, -c[:, 1] / z**2
        rotated = c - t
        k = np.zeros((len(c), 3, 3))
        k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = rotated[:, 2], -rotated[:, 1], rotated[:, 0]
        k[:, 1, 0], k[:, 2, 0], k[:, 2, 1] = -rotated[:, 2], rotated[:, 1], -rotated[:, 0]
        j = np.concatenate([d @ k, d], axis=2).reshape(-1, 6)
        step = np.linalg.solve(j.T @ j + 1e-9 * np.eye(6), -j.T @ e.ravel())
        r, t = rotation_vector(step[:3]) @ r, t + step[3:]
        if np.abs(step).max() < 1e-12:
            break
    return r, t


def pnp(x: np.ndarray, p: np.ndarray, threshold: float, iterations: int = 2000):
    """(R, t, inlier mask): robust linear pose, refined on its inliers as long as these do not get fewer."""
    found = ransac(len(x), 6, threshold, SEED_PNP, lambda s: pnp_linear(x[s], p[s]), lambda m: pnp_residual(m, x, p), iterations)
    if found is None or found[1].sum() < 6:
        return None
    pose, mask = found
    for _ in range(2):
        start = pnp_linear(x[mask], p[mask]) or pose
        new = refine_pose(start, x[mask], p[mask])
        other = pnp_residual(new, x, p) < threshold
        if other.sum() < mask.sum():
            break
        pose, mask = new, other
    return (*pose, mask)
