"""Bundle adjustment kernels: projections and derivatives of all camera models over arrays of observations, normal equations in
blocks with points eliminated, and damped steps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessella.functions.geometry import CAMERA_MODELS, DEPTH_EPS
from tessella.functions.kernels import rotation_vector


@dataclass(frozen=True)
class Options:
    iterations: int = 50
    damping: float = 1e-3
    tolerance: float = 1e-6
    inner: int = 8
    loss: str = "huber"
    scale: float = 2.0


def principal_points(model: str) -> list[int]:
    """Positions of the principal point among a model's parameters: held fixed by default."""
    return [i for i, n in enumerate(CAMERA_MODELS[model][1]) if n in ("cx", "cy")]


def project(model: str, params: np.ndarray, p: np.ndarray, derivatives: bool = True):
    """Pixels (n, 2) of camera-space points (n, 3); with derivatives also those to the point (n, 2, 3) and to the parameters (n, 2, k)."""
    names = CAMERA_MODELS[model][1]
    if len(params) != len(names):
        raise ValueError(f"{model} takes {len(names)} parameters, not {len(params)}")
    v = dict(zip(names, params))
    fx, fy = v.get("fx", v.get("f")), v.get("fy", v.get("f"))
    k1, k2, k3, k4 = v.get("k1", v.get("k", 0.0)), v.get("k2", 0.0), v.get("k3", 0.0), v.get("k4", 0.0)
    p1, p2 = v.get("p1", 0.0), v.get("p2", 0.0)
    z = np.where(p[:, 2] > DEPTH_EPS, p[:, 2], 1.0)
    a, b = p[:, 0] / z, p[:, 1] / z
    r2 = a * a + b * b
    one, zero = np.ones_like(a), np.zeros_like(a)
    if model == "OPENCV_FISHEYE":
        r = np.maximum(np.sqrt(r2), 1e-12)
        t = np.arctan(r)
        t2 = t * t
        g = t * (1 + t2 * (k1 + t2 * (k2 + t2 * (k3 + t2 * k4))))
        s = g / r
        dg = (1 + t2 * (3 * k1 + t2 * (5 * k2 + t2 * (7 * k3 + t2 * 9 * k4)))) / (1 + r * r)
        ds = np.where(r2 > 1e-16, (dg * r - g) / np.maximum(r, 1e-8) ** 3, 0.0)  # ds/d(r^2) times 2
        u, w = a * s, b * s
        da, db = np.stack([s + a * a * ds, a * b * ds], 1), np.stack([a * b * ds, s + b * b * ds], 1)
        shape = {n: (a * t**e / r, b * t**e / r) for n, e in (("k1", 3), ("k2", 5), ("k3", 7), ("k4", 9))}
    else:
        s, ds = 1 + k1 * r2 + k2 * r2 * r2, 2 * (k1 + 2 * k2 * r2)
        u = a * s + 2 * p1 * a * b + p2 * (r2 + 2 * a * a)
        w = b * s + p1 * (r2 + 2 * b * b) + 2 * p2 * a * b
        da = np.stack([s + a * a * ds + 2 * p1 * b + 6 * p2 * a, a * b * ds + 2 * p1 * a + 2 * p2 * b], 1)
        db = np.stack([a * b * ds + 2 * p1 * a + 2 * p2 * b, s + b * b * ds + 6 * p1 * b + 2 * p2 * a], 1)
        shape = {"k": (a * r2, b * r2), "k1": (a * r2, b * r2), "k2": (a * r2 * r2, b * r2 * r2), "p1": (2 * a * b, r2 + 2 * b * b), "p2": (r2 + 2 * a * a, 2 * a * b)}
    pixel = np.stack([fx * u + v["cx"], fy * w + v["cy"]], 1)
    if not derivatives:
        return pixel
    f = np.array([fx, fy])
    da, db = da * f, db * f
    point = np.stack([da / z[:, None], db / z[:, None], -(da * a[:, None] + db * b[:, None]) / z[:, None]], 2)
    cam = np.zeros((len(p), 2, len(names)))
    for i, n in enumerate(names):
        cam[:, :, i] = np.stack({"f": (u, w), "fx": (u, zero), "fy": (zero, w), "cx": (one, zero), "cy": (zero, one)}.get(n) or (fx * shape[n][0], fy * shape[n][1]), 1)
    return pixel, point, cam


def residuals(models, params, camera_of, rot, trans, points, image, point, seen, derivatives=False):
    """Residuals (n, 2), validity (n), and with derivatives those to pose (turn, shift), point and camera parameters (padded to 8).

    models, params: per camera; camera_of: camera of an image; image, point: indices of an observation; seen: its pixel."""
    x = points[point]
    turned = np.einsum("nij,nj->ni", rot[image], x)
    c = turned + trans[image]
    ok = c[:, 2] > DEPTH_EPS
    n = len(x)
    e, jp, jx, jc = np.zeros((n, 2)), np.zeros((n, 2, 6)), np.zeros((n, 2, 3)), np.zeros((n, 2, 8))
    cam = camera_of[image]
    for k in np.unique(cam):
        i = np.flatnonzero((cam == k) & ok)
        out = project(models[k], params[k], c[i], derivatives)
        if not derivatives:
            e[i] = out - seen[i]
            continue
        pixel, d, dc = out
        e[i] = pixel - seen[i]
        t = turned[i]
        z = np.zeros(len(i))
        minus_cross = np.stack([np.stack([z, t[:, 2], -t[:, 1]], 1), np.stack([-t[:, 2], z, t[:, 0]], 1), np.stack([t[:, 1], -t[:, 0], z], 1)], 1)
        jp[i] = np.concatenate([d @ minus_cross, d], 2)
        jx[i] = d @ rot[image[i]]
        jc[i, :, : dc.shape[2]] = dc
    return (e, ok, jp, jx, jc) if derivatives else (e, ok)


def weights(e: np.ndarray, loss: str, scale: float) -> np.ndarray:
    r, scale = np.linalg.norm(e, axis=1), max(scale, 1e-9)
    if loss == "huber":
        return np.where(r <= scale, 1.0, scale / np.maximum(r, 1e-300))
    return 1 / (1 + (r / scale) ** 2) if loss == "cauchy" else np.ones(len(r))


def total_cost(e, ok, loss, scale) -> float:
    """Sum of w r^2; an observation behind its camera adds nothing."""
    return float((weights(e, loss, scale) * (e * e).sum(1))[ok].sum())


def reduced(jp, jx, jc, e, w, image, camera, point, n_points, free_points, damping):
    """Normal equations with the points eliminated, as sparse blocks: unknown groups are poses (6) and cameras (8).

    -> {(kind, i, kind, j): block}, {(kind, i): right side}, and what gives the points back. Blocks add up over disjoint sets of points,
    so partitions of points can be reduced apart from each other."""
    c = np.zeros((n_points, 3, 3))
    r = np.zeros((n_points, 3))
    np.add.at(c, point, np.einsum("nki,n,nkj->nij", jx, w, jx))
    np.add.at(r, point, -np.einsum("nki,n,nk->ni", jx, w, e))
    d = np.arange(3)
    c[:, d, d] += damping * np.maximum(c[:, d, d], 1e-9)
    inv = np.zeros_like(c)
    solid = free_points & (np.linalg.det(c) > 1e-30)
    inv[solid] = np.linalg.inv(c[solid])
    lhs, rhs, diag = {}, {}, {}
    sides = (("p", image, jp), ("c", camera, jc))

    def add(into, key, value):
        into[key] = into[key] + value if key in into else value

    for kind, index, j in sides:
        own = np.einsum("nki,n,nkj->nij", j, w, j)
        right = -np.einsum("nki,n,nk->ni", j, w, e)
        for k in np.unique(index):
            m = index == k
            add(lhs, (kind, k, kind, k), own[m].sum(0))
            add(diag, (kind, k), np.diag(own[m].sum(0)).copy())
            add(rhs, (kind, k), right[m].sum(0))
    mixed = np.einsum("nki,n,nkj->nij", jp, w, jc)
    for key in {(int(a), int(b)) for a, b in zip(image, camera)}:
        m = (image == key[0]) & (camera == key[1])
        add(lhs, ("p", key[0], "c", key[1]), mixed[m].sum(0))
        add(lhs, ("c", key[1], "p", key[0]), mixed[m].sum(0).T)
    # coupling of an observation's pose and of its camera with its point; products of couplings within a point
    link = {kind: np.einsum("nki,n,nkj->nij", j, w, jx) for kind, _, j in sides}
    order = np.argsort(point, kind="stable")
    begin = np.searchsorted(point[order], np.arange(n_points + 1))
    size = np.diff(begin)
    first, second = [], []
    for length in np.unique(size[(size > 0) & solid]):
        at = order[begin[:-1][(size == length) & solid][:, None] + np.arange(length)]
        first.append(np.repeat(at, length, axis=1).ravel())
        second.append(np.tile(at, (1, length)).ravel())
    if first:
        a, b = np.concatenate(first), np.concatenate(second)
        for kind, index, _ in sides:
            g = np.einsum("nij,nj->ni", link[kind], np.einsum("nij,nj->ni", inv, r)[point])
            for k in np.unique(index):
                rhs[kind, k] = rhs[kind, k] - g[index == k].sum(0)
            left = np.einsum("nij,njk->nik", link[kind], inv[point])
            for other, index2, _ in sides:
                key = index[a].astype(np.int64) << 32 | index2[b].astype(np.int64)
                names, where = np.unique(key, return_inverse=True)
                block = np.zeros((len(names), left.shape[1], link[other].shape[1]))
                for s in range(0, len(a), 200_000):
                    t = slice(s, s + 200_000)
                    np.add.at(block, where[t], np.einsum("nij,nkj->nik", left[a[t]], link[other][b[t]]))
                for name, value in zip(names, block):
                    add(lhs, (kind, int(name >> 32), other, int(name & 0xFFFFFFFF)), -value)
    return lhs, rhs, diag, (inv, r, link)


def solve(lhs, rhs, diag, free: dict, damping: float) -> dict | None:
    """Damped solution per group; free: group -> mask of its unknowns. None where the system is not positive definite."""
    at, n = {}, 0
    for g, mask in free.items():
        at[g] = (n, np.flatnonzero(mask))
        n += int(mask.sum())
    a, b = np.zeros((n, n)), np.zeros(n)
    for (k1, i, k2, j), block in lhs.items():
        if (k1, i) in at and (k2, j) in at:
            (o1, m1), (o2, m2) = at[k1, i], at[k2, j]
            a[o1 : o1 + len(m1), o2 : o2 + len(m2)] += block[np.ix_(m1, m2)]
    for g, value in rhs.items():
        if g in at:
            o, m = at[g]
            b[o : o + len(m)] += value[m]
            i = o + np.arange(len(m))
            a[i, i] += damping * np.maximum(diag[g][m], 1e-9)
    idle = np.flatnonzero(np.diag(a) == 0)
    a[idle, idle] = 1.0
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return None
    x = np.linalg.solve(low.T, np.linalg.solve(low, b))
    out = {}
    for g, (o, m) in at.items():
        out[g] = np.zeros(len(free[g]))
        out[g][m] = x[o : o + len(m)]
    return out


def moved(params, rot, trans, step):
    """Cameras and poses after a step."""
    params, rot, trans = [p.copy() for p in params], rot.copy(), trans.copy()
    for (kind, i), d in step.items():
        if kind == "p":
            rot[i], trans[i] = rotation_vector(d[:3]) @ rot[i], trans[i] + d[3:]
        else:
            params[i] = params[i] + d[: len(params[i])]
    return params, rot, trans


def point_steps(back, image, camera, point, step):
    """Steps of the eliminated points that belong to steps of poses and cameras."""
    inv, r, link = back
    r = r.copy()
    for kind, index in (("p", image), ("c", camera)):
        width = link[kind].shape[1]
        d = np.zeros((int(index.max(initial=-1)) + 1, width))
        for (k, i), value in step.items():
            if k == kind and i < len(d):
                d[i] = value
        np.subtract.at(r, point, np.einsum("nij,ni->nj", link[kind], d[index]))
    return np.einsum("nij,nj->ni", inv, r)


def free_masks(models, camera_of, fixed_pose, refine) -> dict:
    """Unknowns by group. refine: cameras whose intrinsics (but for principal points) may move."""
    free = {("p", i): np.ones(6, bool) for i in range(len(camera_of)) if not fixed_pose[i]}
    for c in refine:
        mask = np.zeros(8, bool)
        mask[: len(CAMERA_MODELS[models[c]][1])] = True
        mask[principal_points(models[c])] = False
        free["c", c] = mask
    return free


def adjust(models, params, camera_of, rot, trans, points, image, point, seen, fixed_pose, fixed_point=None, refine=(), options=Options()):
    """Damped least squares over poses, free points and the intrinsics of the cameras in refine -> params, rot, trans, points, cost.

    A step is kept if it lowers the cost; damping falls by 3 then, and else grows by 2, 4, 8, ... up to the number of inner tries."""
    params, rot, trans, points = [np.asarray(p, float) for p in params], rot.copy(), trans.copy(), points.copy()
    free_points = np.ones(len(points), bool) if fixed_point is None else ~fixed_point
    free = free_masks(models, camera_of, fixed_pose, refine)
    look = lambda p, r, t, x: total_cost(*residuals(models, p, camera_of, r, t, x, image, point, seen), options.loss, options.scale)
    cost, damping, camera = look(params, rot, trans, points), options.damping, camera_of[image]
    for _ in range(options.iterations):
        e, ok, jp, jx, jc = residuals(models, params, camera_of, rot, trans, points, image, point, seen, True)
        w = weights(e, options.loss, options.scale) * ok
        grow, better = 2.0, None
        for _ in range(options.inner):
            lhs, rhs, diag, back = reduced(jp, jx, jc, e, w, image, camera, point, len(points), free_points, damping)
            step = solve(lhs, rhs, diag, free, damping)
            if step is not None:
                p, r, t = moved(params, rot, trans, step)
                x = points + point_steps(back, image, camera, point, step) * free_points[:, None]
                new = look(p, r, t, x)
                if np.isfinite(new) and new < cost:
                    better = p, r, t, x, new
                    break
            damping, grow = damping * grow, grow * 2
        if better is None:
            break
        gain = (cost - better[4]) / max(cost, 1e-300)
        params, rot, trans, points, cost = better
        damping = max(damping / 3, 1e-12)
        if gain < options.tolerance:
            break
    return params, rot, trans, points, cost


def intrinsics_only(model, params, camera_points, seen, options=Options(iterations=30)):
    """One camera's parameters (principal point fixed) from camera-space points; unchanged with fewer than eight observations."""
    params = np.asarray(params, float)
    ok = camera_points[:, 2] > DEPTH_EPS
    p, s = camera_points[ok], seen[ok]
    if len(p) < 8:
        return params
    free = np.setdiff1d(np.arange(len(params)), principal_points(model))
    every = np.ones(len(p), bool)
    cost, damping = total_cost(project(model, params, p, False) - s, every, options.loss, options.scale), options.damping
    for _ in range(options.iterations):
        pixel, _, j = project(model, params, p)
        e, j = pixel - s, j[:, :, free]
        w = weights(e, options.loss, options.scale)
        h, g = np.einsum("nki,n,nkj->ij", j, w, j), -np.einsum("nki,n,nk->i", j, w, e)
        new = params.copy()
        new[free] += np.linalg.solve(h + damping * np.diag(np.maximum(np.diag(h), 1e-9)), g)
        c = total_cost(project(model, new, p, False) - s, every, options.loss, options.scale)
        if not c < cost:
            damping *= 3
            continue
        gain, params, cost, damping = (cost - c) / cost, new, c, damping / 3
        if gain < options.tolerance:
            break
    return params
