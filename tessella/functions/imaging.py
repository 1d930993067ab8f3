"""Image kernels on NumPy arrays (rows first, gray values 0 to 1): filters, scale space, gradient and binary keypoints."""

from __future__ import annotations

from functools import cache

import numpy as np

# Default parameters of the detectors.
SIFT = {"scales": 3, "sigma": 1.6, "contrast": 0.02, "edge": 10.0, "most": 12000, "upsample_below": 1600}
ORB = {"levels": 8, "factor": 1.2, "fast": 20, "patch": 15, "most": 8000}
# The circle of 16 pixels (dx, dy) of the segment test, clockwise from the top.
CIRCLE = [(0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3)]
LUMA = np.array([0.2126, 0.7152, 0.0722])
BINARY_SEED = 0x9E3779B97F4A7C15


def gray_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Gray image of the bytes that Spark's image source gives (one channel, or blue, green, red and perhaps alpha)."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return (a[:, :, 0] if channels < 3 else np.floor(a[:, :, 2::-1] @ LUMA + 1e-9)) / 255.0


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian, border pixels repeated."""
    r = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    h, w = img.shape
    p = np.pad(img, ((r, r), (0, 0)), mode="edge")
    img = sum(k[i] * p[i : i + h] for i in range(2 * r + 1))
    p = np.pad(img, ((0, 0), (r, r)), mode="edge")
    return sum(k[i] * p[:, i : i + w] for i in range(2 * r + 1))


def bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h, w = img.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1, a, b = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), x - x0, y - y0
    return (img[y0, x0] * (1 - a) + img[y0, x1] * a) * (1 - b) + (img[y1, x0] * (1 - a) + img[y1, x1] * a) * b


def resized(img: np.ndarray, height: int, width: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    return bilinear(img, (x + 0.5) * img.shape[1] / width - 0.5, (y + 0.5) * img.shape[0] / height - 0.5)


def halved(img: np.ndarray) -> np.ndarray:
    h, w = img.shape[0] // 2, img.shape[1] // 2
    return img[: 2 * h, : 2 * w].reshape(h, 2, w, 2).mean(axis=(1, 3))


def _neighbourhood(stack: np.ndarray, pick) -> np.ndarray:
    """pick (np.maximum or np.minimum) over 3 positions of every axis, without the border."""
    for axis in range(stack.ndim):
        n = stack.shape[axis]
        a, b, c = (np.take(stack, range(i, n - 2 + i), axis) for i in range(3))
        stack = pick(pick(a, b), c)
    return stack


def _extrema(dog: np.ndarray, contrast: float, edge: float) -> np.ndarray:
    """(s, y, x, value) of refined extrema of a difference stack: quadratic fit, at most five moves, edges left out."""
    inner = dog[1:-1, 1:-1, 1:-1]
    high = (inner > 0) & (inner >= _neighbourhood(dog, np.maximum))
    low = (inner < 0) & (inner <= _neighbourhood(dog, np.minimum))
    at = np.argwhere((high | low) & (np.abs(inner) > 0.5 * contrast)) + 1
    done = []
    top = np.array(dog.shape) - 2
    for _ in range(5):
        if not len(at):
            break
        s, y, x = at.T
        v = lambda a, b, c: dog[s + a, y + b, x + c]  # noqa: B023, E731
        g = np.stack([v(1, 0, 0) - v(-1, 0, 0), v(0, 1, 0) - v(0, -1, 0), v(0, 0, 1) - v(0, 0, -1)], 1) / 2
        c = v(0, 0, 0)
        h = np.empty((len(at), 3, 3))
        for i in range(3):
            e = np.eye(3, dtype=int)[i]
            h[:, i, i] = v(*e) + v(*-e) - 2 * c
            for j in range(i):
                f = np.eye(3, dtype=int)[j]
                h[:, i, j] = h[:, j, i] = (v(*(e + f)) - v(*(e - f)) - v(*(f - e)) + v(*(-e - f))) / 4
        solvable = np.abs(np.linalg.det(h)) > 1e-18
        at, g, c, h = at[solvable], g[solvable], c[solvable], h[solvable]
        if not len(at):
            break
        o = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        still = np.abs(o).max(1) <= 0.6
        value = c + 0.5 * (g * o).sum(1)
        trace, det = h[:, 1, 1] + h[:, 2, 2], h[:, 1, 1] * h[:, 2, 2] - h[:, 1, 2] ** 2
        good = still & (np.abs(value) >= contrast) & (det > 0) & (trace**2 * edge < (edge + 1) ** 2 * det)
        done.append(np.hstack([at[good] + o[good], value[good, None]]))
        moved = at[~still] + np.rint(np.clip(o[~still], -10, 10)).astype(int)
        at = moved[((moved >= 1) & (moved <= top)).all(1)]
    return np.unique(np.vstack(done), axis=0) if done else np.zeros((0, 4))


def _gradient_descriptors(gx, gy, x, y, sigma):
    """Angle and 128 values of keypoints in one smoothed image: 36 orientation bins, then 4 x 4 cells of 8 directions."""
    n, (h, w) = len(x), gx.shape

    def at(px, py):
        ix, iy = np.rint(px).astype(int), np.rint(py).astype(int)
        inside = (ix >= 0) & (iy >= 0) & (ix < w) & (iy < h)
        ix, iy = np.clip(ix, 0, w - 1), np.clip(iy, 0, h - 1)
        a, b = gx[iy, ix], gy[iy, ix]
        return np.hypot(a, b) * inside, np.arctan2(b, a)

    v, u = (m.ravel() for m in np.mgrid[-8:9, -8:9] / 8.0)
    m, t = at(x[:, None] + u * 4.5 * sigma[:, None], y[:, None] + v * 4.5 * sigma[:, None])
    m = m * np.exp(-0.5 * (u * u + v * v) * 9)
    hist = np.zeros((n, 36))
    np.add.at(hist, (np.repeat(np.arange(n), len(u)), (np.floor((t + np.pi) / (2 * np.pi) * 36).astype(int) % 36).ravel()), m.ravel())
    for _ in range(2):
        hist = (np.roll(hist, 1, 1) + hist + np.roll(hist, -1, 1)) / 3
    angle = (hist.argmax(1) + 0.5) / 36 * 2 * np.pi - np.pi
    r, c = (g.ravel() for g in np.mgrid[0:16, 0:16] / 4.0 + 0.125 - 2)
    cos, sin, cell = np.cos(angle)[:, None], np.sin(angle)[:, None], 3 * sigma[:, None]
    m, t = at(x[:, None] + (c * cos - r * sin) * cell, y[:, None] + (c * sin + r * cos) * cell)
    m = m * np.exp(-(r * r + c * c) / 8)
    rb, cb = np.broadcast_to(r + 1.5, m.shape), np.broadcast_to(c + 1.5, m.shape)
    ob = ((t - angle[:, None]) / (2 * np.pi) * 8) % 8
    base = [np.floor(b).astype(int) for b in (rb, cb, ob)]
    part = [b - f for b, f in zip((rb, cb, ob), base)]
    out = np.zeros((n, 6, 6, 8))
    k = np.broadcast_to(np.arange(n)[:, None], m.shape)
    for d in np.ndindex(2, 2, 2):
        share = m
        for p, i in zip(part, d):
            share = share * (p if i else 1 - p)
        np.add.at(out, (k, base[0] + d[0] + 1, base[1] + d[1] + 1, (base[2] + d[2]) % 8), share)
    d = out[:, 1:5, 1:5].reshape(n, 128)
    for _ in range(2):
        d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
        d = np.minimum(d, 0.2)
    return angle, d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)


def _strongest(kp: dict, most: int) -> dict:
    """The most keypoints of the highest response in their original order, ties to the earlier one."""
    keep = np.sort(np.argsort(-kp["response"], kind="stable")[:most])
    return {k: v[keep] for k, v in kp.items()}


def sift(img: np.ndarray, most: int = SIFT["most"]) -> dict[str, np.ndarray]:
    """Scale-space extrema with one orientation and a unit 128-vector each: x, y, scale, angle, response, desc."""
    scales, sigma0 = SIFT["scales"], SIFT["sigma"]
    up = min(img.shape) <= SIFT["upsample_below"]
    zoom = 2.0 if up else 1.0
    base = resized(img, 2 * img.shape[0], 2 * img.shape[1]) if up else img
    base = blur(base, np.sqrt(sigma0**2 - (0.5 * zoom) ** 2))
    step, found = 2 ** (1 / scales), []
    while min(base.shape) >= 16:
        stack, s = [base], sigma0
        for _ in range(scales + 2):
            stack.append(blur(stack[-1], s * np.sqrt(step**2 - 1)))
            s *= step
        kp = _extrema(np.diff(np.array(stack), axis=0), SIFT["contrast"] / scales, SIFT["edge"])
        level = np.clip(np.rint(kp[:, 0]).astype(int), 0, scales + 1)
        for i in np.unique(level):
            q = kp[level == i]
            gy, gx = np.gradient(stack[i])
            sigma = sigma0 * step ** q[:, 0]
            angle, desc = _gradient_descriptors(gx, gy, q[:, 2], q[:, 1], sigma)
            ratio = 1 / zoom
            found.append((q[:, 2], q[:, 1], sigma, angle, np.abs(q[:, 3]), desc, np.full(len(q), ratio)))
        base, zoom = halved(stack[scales]), zoom / 2
    if not found:
        z = np.zeros(0)
        return {"x": z, "y": z, "scale": z, "angle": z, "response": z, "desc": np.zeros((0, 128))}
    x, y, s, a, r, d, ratio = (np.concatenate(c) for c in zip(*found))
    return _strongest({"x": (x + 0.5) * ratio - 0.5, "y": (y + 0.5) * ratio - 0.5, "scale": s * ratio, "angle": a, "response": r, "desc": d}, most)


@cache
def binary_pattern() -> np.ndarray:
    """256 pairs of offsets (x1, y1, x2, y2), uniform in a disk of the patch's radius, from a fixed seed."""
    mask, state, points = (1 << 64) - 1, BINARY_SEED, []
    while len(points) < 512:
        for shift in (13, -7, 17):
            state ^= (state << shift) & mask if shift > 0 else state >> -shift
        p = np.array([state & 0xFFFF, state >> 16 & 0xFFFF]) / 65535 * 2 - 1
        if p @ p <= 1:
            points.append(p * ORB["patch"])
    return np.array(points).reshape(256, 4)


def _segment_scores(img: np.ndarray, t: float, border: int) -> np.ndarray:
    """Score of pixels with nine neighbours in a row of CIRCLE that all are brighter or all darker by t; else 0."""
    h, w = img.shape
    out = np.zeros((h, w))
    if min(h, w) <= 2 * border:
        return out
    c = img[border:-border, border:-border]
    ring = np.stack([img[border + dy : h - border + dy, border + dx : w - border + dx] - c for dx, dy in CIRCLE])
    best = np.zeros_like(c)
    for sign in (1, -1):
        over = sign * ring - t
        run = over > 0
        arc = np.zeros(c.shape, bool)
        for i in range(16):
            arc |= np.take(run, range(i, i + 9), 0, mode="wrap").all(0)
        best = np.maximum(best, np.where(arc, np.where(run, over, 0).sum(0), 0))
    out[border:-border, border:-border] = best
    return out


def orb(img: np.ndarray, most: int = ORB["most"]) -> dict[str, np.ndarray]:
    """Segment-test corners on a pyramid with intensity-centroid angles; desc: four signed 64-bit words, lowest bit first."""
    patch, border, found = ORB["patch"], ORB["patch"] + 4, []
    v, u = (g.ravel() for g in np.mgrid[-patch : patch + 1, -patch : patch + 1])
    u, v = u[u * u + v * v <= patch * patch], v[u * u + v * v <= patch * patch]
    for level in range(ORB["levels"]):
        f = ORB["factor"] ** level
        h, w = int(round(img.shape[0] / f)), int(round(img.shape[1] / f))
        if min(h, w) <= 2 * border:
            break
        im = img if level == 0 else resized(img, h, w)
        score = _segment_scores(im, ORB["fast"] / 255, border)
        peak = np.zeros_like(score, bool)
        peak[1:-1, 1:-1] = (score[1:-1, 1:-1] > 0) & (score[1:-1, 1:-1] >= _neighbourhood(score, np.maximum))
        y, x = np.nonzero(peak)
        if not len(x):
            continue
        around = im[y[:, None] + v, x[:, None] + u]
        angle = np.arctan2(around @ v, around @ u)
        cos, sin, smooth, p = np.cos(angle)[:, None], np.sin(angle)[:, None], blur(im, 2.0), binary_pattern()
        a, b = (bilinear(smooth, x[:, None] + cos * p[:, i] - sin * p[:, i + 1], y[:, None] + sin * p[:, i] + cos * p[:, i + 1]) for i in (0, 2))
        words = np.packbits(a < b, axis=1, bitorder="little").view("<i8")
        found.append(((x + 0.5) * f - 0.5, (y + 0.5) * f - 0.5, np.full(len(x), 2 * patch * f), angle, score[y, x], words))
    if not found:
        z = np.zeros(0)
        return {"x": z, "y": z, "scale": z, "angle": z, "response": z, "desc": np.zeros((0, 4), np.int64)}
    return _strongest(dict(zip(("x", "y", "scale", "angle", "response", "desc"), (np.concatenate(c) for c in zip(*found)))), most)
