"""Absolute poses of a view graph from its relative ones."""

from __future__ import annotations

import numpy as np

PULL = 1e-8


def quaternion(r: np.ndarray) -> np.ndarray:
    """Unit (w, x, y, z) of a rotation with w >= 0: the main eigenvector of the symmetric form of Bar-Itzhack."""
    k = np.array([
        [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
        [r[2, 1] - r[1, 2], r[0, 0] - r[1, 1] - r[2, 2], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
        [r[0, 2] - r[2, 0], r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], r[1, 2] + r[2, 1]],
        [r[1, 0] - r[0, 1], r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1]],
    ])
    q = np.linalg.eigh(k)[1][:, -1]
    return -q if q[0] < 0 else q


def rotation_of(q: np.ndarray) -> np.ndarray:
    w, x, y, z = q / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
                     [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


def angle(r: np.ndarray) -> float:
    """Degrees of a rotation."""
    return float(np.degrees(np.arccos(np.clip((np.trace(r) - 1) / 2, -1, 1))))


def tree_rotations(edges, root: int) -> dict[int, np.ndarray]:
    """Rotations passed on from the root; edges (i, j, R with R_j = R R_i, rank): edges of a lower rank are used up first."""
    near: dict[int, list] = {}
    for i, j, r, rank in edges:
        near.setdefault(i, []).append((j, r, rank))
        near.setdefault(j, []).append((i, r.T, rank))
    out = {root: np.eye(3)}
    for most in sorted({e[3] for e in edges}):
        front = sorted(out)
        while front:
            new = []
            for i in front:
                for j, r, rank in sorted(near.get(i, ()), key=lambda e: e[0]):
                    if rank <= most and j not in out:
                        out[j] = r @ out[i]
                        new.append(j)
            front = sorted(new)
    return out


def refined_rotations(rotations: dict, edges, root: int, iterations: int = 25, huber_deg: float = 5.0) -> dict[int, np.ndarray]:
    """Reweighted means of what the neighbours say, all nodes at once, the root held; weight 1 up to huber_deg, then falling."""
    for _ in range(iterations):
        sums: dict[int, np.ndarray] = {}
        for i, j, r, _ in edges:
            if i not in rotations or j not in rotations:
                continue
            a = angle(rotations[j].T @ r @ rotations[i])
            w = 1.0 if a <= huber_deg else huber_deg / a
            for node, say in ((j, r @ rotations[i]), (i, r.T @ rotations[j])):
                q, own = quaternion(say), quaternion(rotations[node])
                sums[node] = sums.get(node, 0) + w * (q if q @ own >= 0 else -q)
        rotations = {k: rotation_of(sums[k]) if k != root and k in sums and np.linalg.norm(sums[k]) > 1e-9 else r for k, r in rotations.items()}
    return rotations


def positions(edges, rotations: dict, root: int, iterations: int = 5) -> dict[int, np.ndarray]:
    """Camera centres from the directions of the edges (i, j, R, t): least squares of what lies across each direction, lengths of
    one on average, reweighted by the residuals; a weak pull to length one settles what directions leave open."""
    nodes = sorted(rotations)
    at = {k: n for n, k in enumerate(nodes)}
    use = [(at[i], at[j], -(rotations[j].T @ t) / max(np.linalg.norm(t), 1e-12)) for i, j, _, t in edges if i in at and j in at]
    n, w = len(nodes), np.ones(len(use))
    x = np.zeros((n, 3))
    for _ in range(iterations):
        a, b, along = np.zeros((3 * n, 3 * n)), np.zeros(3 * n), np.zeros(3 * n)
        for (i, j, d), weight in zip(use, w):
            across = weight * (np.eye(3) - np.outer(d, d)) + PULL * np.eye(3)
            si, sj = slice(3 * i, 3 * i + 3), slice(3 * j, 3 * j + 3)
            a[si, si] += across
            a[sj, sj] += across
            a[si, sj] -= across
            a[sj, si] -= across
            b[sj] += PULL * d
            b[si] -= PULL * d
            along[sj] += d
            along[si] -= d
        keep = np.setdiff1d(np.arange(3 * n), np.arange(3) + 3 * at[root])
        m = len(keep)
        system = np.zeros((m + 1, m + 1))
        system[:m, :m], system[:m, m], system[m, :m] = a[np.ix_(keep, keep)], along[keep], along[keep]
        x = np.zeros(3 * n)
        x[keep] = np.linalg.lstsq(system, np.append(b[keep], float(len(use))), rcond=None)[0][:m]
        x = x.reshape(n, 3)
        v = np.array([x[j] - x[i] for i, j, _ in use])
        off = np.array([np.linalg.norm(u - (u @ d) * d) + max(-(u @ d), 0) for u, (_, _, d) in zip(v, use)])
        s = max(float(np.sort(off)[len(off) // 2]), 1e-6)
        w = 1 / (1 + (off / (3 * s)) ** 2)
    return {k: x[at[k]] for k in nodes}


def global_poses(edges, iterations: int = 25) -> tuple[int, dict]:
    """edges (i, j, R, t, rank) of one component -> its root (the node of most edges, the last on ties) and node -> (R, t)."""
    nodes, count = np.unique([e[k] for e in edges for k in (0, 1)], return_counts=True)
    root = int(nodes[len(count) - 1 - count[::-1].argmax()])
    turns = [(i, j, r, rank) for i, j, r, _, rank in edges]
    rot = refined_rotations(tree_rotations(turns, root), turns, root, iterations)
    centre = positions([(i, j, r, t) for i, j, r, t, _ in edges], rot, root)
    return root, {k: (rot[k], -rot[k] @ centre[k]) for k in rot}
