"""Square fiducial markers: planar geometry, the code dictionary, detection in a gray image."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

CELLS = 6  # 4 x 4 bits inside a dark border of one cell


@dataclass(frozen=True)
class MarkerParams:
    """Radius and offset (of 255) of the local threshold, gates, dictionary size and exposure correction."""

    radius: int = 7
    offset: float = 12.0
    min_pixels: int = 80
    min_perimeter: float = 60.0
    max_hamming: int = 3
    num_markers: int = 50
    contrast: float = 1.0
    gamma: float = 1.0
    min_fill: float = 0.75
    min_border: float = 0.8


def turned(code: int) -> int:
    """The 4 x 4 code after a quarter turn: bit (row, column) goes to (column, 3 - row)."""
    return sum((code >> (r * 4 + c) & 1) << (c * 4 + 3 - r) for r in range(4) for c in range(4))


def turns(code: int) -> list[int]:
    out = [code]
    for _ in range(3):
        out.append(turned(out[-1]))
    return out


@cache
def dictionary(size: int, distance: int = 4) -> tuple[int, ...]:
    """The first codes in numeric order with 3 to 13 ones, no symmetry under turns, and at least distance bits from all turns of
    those before."""
    ones = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
    kept: list[int] = []
    near = np.zeros(0, np.int64)
    for code in range(1 << 16):
        if len(kept) == size:
            break
        if 3 <= ones[code] <= 13 and code not in turns(code)[1:] and not (len(near) and ones[near ^ code].min() < distance):
            kept.append(code)
            near = np.concatenate([near, turns(code)])
    return tuple(kept)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """3 x 3 map of four points onto four; None where they do not determine it."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    try:
        return np.append(np.linalg.solve(np.array(rows, float), np.array(rhs, float)), 1.0).reshape(3, 3)
    except np.linalg.LinAlgError:
        return None


def mapped(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


def area(p: np.ndarray) -> float:
    """Signed shoelace area."""
    x, y = np.asarray(p, float).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise in x right, y up; collinear points left out."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def side(seq):
        out = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(side(p) + side(p[::-1]))


def min_area_rectangle(hull: np.ndarray) -> np.ndarray | None:
    """Corners of the smallest rectangle round a hull; one of its sides lies on a side of the hull."""
    if len(hull) < 3:
        return None
    best = None
    for e in np.roll(hull, -1, axis=0) - hull:
        u = e / np.linalg.norm(e)
        axes = np.array([u, [-u[1], u[0]]])
        q = hull @ axes.T
        lo, hi = q.min(0), q.max(0)
        size = np.prod(hi - lo)
        if best is None or size < best[0]:
            best = size, np.array([lo, [hi[0], lo[1]], hi, [lo[0], hi[1]]]) @ axes
    return best[1]


def by_angle(corners: np.ndarray) -> np.ndarray:
    """Corners sorted by their angle about the centroid."""
    d = corners - corners.mean(0)
    return corners[np.argsort(np.arctan2(d[:, 1], d[:, 0]), kind="stable")]


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels (-1 outside, else 0, 1, ...) of 4-connected regions: runs of a row are united with those they touch in the row above."""
    h, w = mask.shape
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    parent = np.arange(len(row))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if begin[a] < end[b] and begin[b] < end[a]:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
            a, b = (a + 1, b) if end[a] < end[b] else (a, b + 1)
    names, label = np.unique([root(i) for i in range(len(row))], return_inverse=True) if len(row) else (np.zeros(0), np.zeros(0, int))
    out = np.full(h * w + 1, -1)
    pixels = np.flatnonzero(mask.ravel())
    out[pixels] = np.repeat(label, end - begin)
    return out[:-1].reshape(h, w), len(names)


def local_mean(img: np.ndarray, radius: int) -> np.ndarray:
    """Mean of the window of the given radius, cut off at the border, by an integral image."""
    h, w = img.shape
    s = np.pad(img, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    y0, y1 = np.maximum(np.arange(h) - radius, 0), np.minimum(np.arange(h) + radius + 1, h)
    x0, x1 = np.maximum(np.arange(w) - radius, 0), np.minimum(np.arange(w) + radius + 1, w)
    total = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    return total / ((y1 - y0)[:, None] * (x1 - x0)[None])


def exposed(img: np.ndarray, gamma: float, contrast: float) -> np.ndarray:
    return np.clip((np.power(img, gamma) - 0.5) * contrast + 0.5, 0, 1)


def _quad(points: np.ndarray) -> np.ndarray | None:
    """Four corners of a hull: the two ends of its longest diagonal and the furthest points on either side of it."""
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    i, j = np.unravel_index(d.argmax(), d.shape)
    a, e = points[i], points[j] - points[i]
    side = e[0] * (points[:, 1] - a[1]) - e[1] * (points[:, 0] - a[0])
    k, m = side.argmax(), side.argmin()
    return points[[i, m, j, k]] if side[k] > 0 > side[m] else None


def detect(img: np.ndarray, params: MarkerParams = MarkerParams()) -> list[tuple[int, np.ndarray, int]]:
    """(marker, its four corners from the top left of the upright marker clockwise, Hamming distance) of a gray image in 0 to 1."""
    img = exposed(img, params.gamma, params.contrast) if (params.gamma, params.contrast) != (1.0, 1.0) else img
    label, n = components(img < local_mean(img, params.radius) - params.offset / 255)
    codes = dictionary(params.num_markers)
    table = np.array([turns(c) for c in codes])
    found = {}
    count = np.bincount(label[label >= 0], minlength=n)
    order = np.argsort(label, axis=None, kind="stable")[(label < 0).sum() :]
    starts = np.concatenate([[0], np.cumsum(count)])
    for k in np.flatnonzero(count >= params.min_pixels):
        at = order[starts[k] : starts[k + 1]]
        y, x = np.divmod(at, img.shape[1])
        edges = np.c_[np.r_[x, x + 1, x, x + 1], np.r_[y, y, y + 1, y + 1]] - 0.5
        hull = convex_hull(edges)
        rect = min_area_rectangle(hull)
        if rect is None or abs(area(rect)) < 1 or abs(area(hull)) / abs(area(rect)) < params.min_fill:
            continue
        quad = _quad(hull)
        if quad is None or abs(area(quad)) < 0.5 * abs(area(hull)):
            continue
        quad = by_angle(quad)
        if np.linalg.norm(quad - np.roll(quad, -1, axis=0), axis=1).sum() < params.min_perimeter:
            continue
        h = homography([(0, 0), (CELLS, 0), (CELLS, CELLS), (0, CELLS)], quad)
        if h is None:
            continue
        r, c = (g.ravel() for g in np.mgrid[0:CELLS, 0:CELLS])
        v = np.zeros(CELLS * CELLS)
        for dy in (0.3, 0.5, 0.7):
            for dx in (0.3, 0.5, 0.7):
                p = np.rint(mapped(h, np.c_[c + dx, r + dy])).astype(int)
                v += img[np.clip(p[:, 1], 0, img.shape[0] - 1), np.clip(p[:, 0], 0, img.shape[1] - 1)]
        light = v > (v.min() + v.max()) / 2
        if not light.any():
            continue  # a plain dark square, like a single cell of a marker, holds no code
        border = (r == 0) | (c == 0) | (r == CELLS - 1) | (c == CELLS - 1)
        if (~light[border]).mean() < params.min_border:
            continue
        bits = light.reshape(CELLS, CELLS)[1:-1, 1:-1].ravel()
        code = int((bits.astype(int) << np.arange(16)).sum())
        distance = np.array([[bin(t ^ code).count("1") for t in row] for row in table])
        i, turn = np.unravel_index(distance.argmin(), distance.shape)
        if distance[i, turn] > params.max_hamming:
            continue
        # seen turned by `turn` quarters, the upright top left corner is that many places further on
        marker = int(i), np.roll(quad, -int(turn), axis=0), int(distance[i, turn])
        if marker[0] not in found or marker[2] < found[marker[0]][2]:
            found[marker[0]] = marker
    return [found[k] for k in sorted(found)]


def drawn(code: int, cell: int) -> np.ndarray:
    """Upright picture of a code, cell pixels a cell: bits set are light, the border is dark."""
    grid = np.zeros((CELLS, CELLS))
    for r in range(4):
        for c in range(4):
            grid[r + 1, c + 1] = code >> (r * 4 + c) & 1
    return np.kron(grid, np.ones((cell, cell)))
