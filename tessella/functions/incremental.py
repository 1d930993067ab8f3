"""Growth of one connected part of a view graph from a seed pair, on arrays; a group is one component."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tessella.functions import bundle, kernels

# Baselines tried when a single relative pose has to carry on, in units of the median camera distance.
SCALES = (1, 0.3, 3, 0.1, 10, 0.03, 30, 0.01, 100)


@dataclass(frozen=True)
class Growth:
    min_angle: float = 2.0
    seed_angle: float = 6.0
    seed_matches: int = 100
    max_error: float = 4.0
    min_correspondences: int = 12
    pnp_error: float = 8.0
    seeds: int = 8
    local_window: int = 6
    growth: float = 1.1
    completion_error: float = 0.5
    intrinsics_images: int = 5
    max_distortion: float = 0.5
    refine_intrinsics: bool = True
    pinned: frozenset = frozenset()
    loss: str = "huber"


@dataclass
class Pair:
    """Relative pose (x_j = R x_i + t) and matched keypoints of two images."""

    i: int
    j: int
    r: np.ndarray
    t: np.ndarray
    k1: np.ndarray
    k2: np.ndarray


@dataclass
class Model:
    """cameras: id -> (model, params); camera_of: image -> id; pixels: image -> {kp: (x, y)}; state of the growth below."""

    cameras: dict
    camera_of: dict
    pixels: dict
    pairs: list
    poses: dict = field(default_factory=dict)
    xyz: list = field(default_factory=list)
    track: list = field(default_factory=list)
    owner: dict = field(default_factory=dict)
    fixed: set = field(default_factory=set)

    def normal(self, image, kp):
        """Pixel to normalised coordinates; distortion is not undone."""
        name, p = self.cameras[self.camera_of[image]]
        v = dict(zip(bundle.CAMERA_MODELS[name][1], p))
        x, y = self.pixels[image][kp]
        return np.array([(x - v["cx"]) / v.get("fx", v.get("f")), (y - v["cy"]) / v.get("fy", v.get("f"))])

    def focal(self, image):
        name, p = self.cameras[self.camera_of[image]]
        v = dict(zip(bundle.CAMERA_MODELS[name][1], p))
        return v["f"] if "f" in v else (v["fx"] + v["fy"]) / 2

    def errors(self, point, views):
        """Pixel error per (image, kp) with distortion; infinite behind the camera."""
        out = []
        for image, kp in views:
            r, t = self.poses[image]
            c = r @ point + t
            if c[2] <= bundle.DEPTH_EPS:
                out.append(np.inf)
                continue
            name, p = self.cameras[self.camera_of[image]]
            out.append(float(np.linalg.norm(bundle.project(name, np.asarray(p), c[None], False)[0] - self.pixels[image][kp])))
        return np.array(out)

    def widest(self, point, images):
        d = np.array([-self.poses[i][0].T @ self.poses[i][1] - point for i in images])
        d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
        return float(np.degrees(np.arccos(np.clip(d @ d.T, -1, 1)).max()))

    def triangulated(self, views, min_angle, max_error):
        """Point of two views and more that passes the gates of depth, error and angle, else None."""
        x = kernels.triangulate([self.poses[i] for i, _ in views], np.array([self.normal(i, k) for i, k in views]))
        if x is None or (self.errors(x, views) > max_error).any() or self.widest(x, [i for i, _ in views]) < min_angle:
            return None
        return x

    def oriented(self, p: Pair, first: int):
        return zip(p.k1, p.k2) if p.i == first else zip(p.k2, p.k1)

    def extend(self, image, options: Growth):
        """Matches of a newly posed image with posed neighbours: join tracks that it fits, and make new points."""
        for p in self.pairs:
            if image not in (p.i, p.j):
                continue
            other = p.j if p.i == image else p.i
            if other not in self.poses:
                continue
            for a, b in self.oriented(p, image):
                mine, theirs = self.owner.get((image, a)), self.owner.get((other, b))
                if mine is not None and theirs is not None:
                    continue
                if mine is None and theirs is None:
                    x = self.triangulated([(image, a), (other, b)], options.min_angle, options.max_error)
                    if x is not None:
                        self.owner[image, a] = self.owner[other, b] = len(self.xyz)
                        self.track.append({image: a, other: b})
                        self.xyz.append(x)
                    continue
                n, view = (theirs, (image, a)) if mine is None else (mine, (other, b))
                if view[0] not in self.track[n] and self.errors(self.xyz[n], [view])[0] <= options.max_error:
                    self.track[n][view[0]] = view[1]
                    self.owner[view] = n

    def retriangulate(self, options: Growth):
        """Points of three views and more from all of them, where that passes a strict gate."""
        for n, t in enumerate(self.track):
            if len(t) > 2:
                x = self.triangulated(sorted(t.items()), options.min_angle, options.completion_error)
                if x is not None:
                    self.xyz[n] = x

    def correspondences(self, image):
        """(kp, point) of an image without a pose; the first posed neighbour to name a point for a keypoint counts."""
        out = {}
        for p in self.pairs:
            if image in (p.i, p.j) and (p.j if p.i == image else p.i) in self.poses:
                other = p.j if p.i == image else p.i
                for a, b in self.oriented(p, image):
                    n = self.owner.get((other, b))
                    if n is not None and a not in out:
                        out[a] = n
        return sorted(out.items())

    def register(self, image, options: Growth) -> bool:
        c = self.correspondences(image)
        if len(c) < options.min_correspondences:
            return False
        found = kernels.pnp(np.array([self.xyz[n] for _, n in c]), np.array([self.normal(image, k) for k, _ in c]), options.pnp_error / self.focal(image))
        if found is None or found[2].sum() < options.min_correspondences:
            return False
        self.poses[image] = found[:2]
        for ok, (k, n) in zip(found[2], c):
            if ok and image not in self.track[n]:
                self.track[n][image] = k
                self.owner[image, k] = n
        self.extend(image, options)
        return True

    def bridge(self, skip: set, options: Growth):
        """Carries on over the pair of most matches with one posed end: the baseline of most new points is kept, if they are enough.
        -> the new image, -1 if the pair failed (it goes into skip), None if there is no pair."""
        todo = [(len(p.k1), n, p) for n, p in enumerate(self.pairs) if ((p.i in self.poses) != (p.j in self.poses)) and (p.i, p.j) not in skip]
        if not todo:
            return None
        p = max(todo, key=lambda e: e[:2])[2]
        known, new = (p.i, p.j) if p.i in self.poses else (p.j, p.i)
        r, t = (p.r, p.t) if known == p.i else (p.r.T, -p.r.T @ p.t)
        rk, tk = self.poses[known]
        centres = np.array([-a.T @ b for a, b in self.poses.values()])
        gaps = np.sort(np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(len(centres), 1)])
        unit = gaps[len(gaps) // 2] if len(gaps) else 1.0
        best = (0, None)
        for s in SCALES:
            self.poses[new] = r @ rk, r @ tk + s * unit * t
            gain = 0
            for a, b in self.oriented(p, new):
                n = self.owner.get((known, b))
                if n is not None:
                    gain += self.errors(self.xyz[n], [(new, a)])[0] <= options.max_error
                else:
                    gain += self.triangulated([(new, a), (known, b)], options.min_angle, options.max_error) is not None
            if gain > best[0]:
                best = gain, self.poses[new]
        del self.poses[new]
        if best[0] < min(len(p.k1), max(3, int(np.ceil(0.1 * len(p.k1))))):
            skip.add((p.i, p.j))
            return -1
        self.poses[new] = best[1]
        self.extend(new, options)
        return new

    def optimise(self, options: Growth, held: set, images=None, refine=False, iterations=50):
        """Adjusts the given posed images (all by default) and their points, the held ones fixed; then drops views that are off, twice at most."""
        for _ in range(3):
            within = set(self.poses) if images is None else {i for i in images if i in self.poses}
            use = [n for n, t in enumerate(self.track) if len(t) >= 2 and within & t.keys()]
            views = [(i, k, m) for m, n in enumerate(use) for i, k in self.track[n].items() if i in self.poses]
            if len(views) < 12:
                return
            ids = sorted({v[0] for v in views})
            at = {i: n for n, i in enumerate(ids)}
            cams = sorted({self.camera_of[i] for i in ids})
            cam_at = {c: n for n, c in enumerate(cams)}
            count = {c: sum(self.camera_of[i] == c for i in self.poses) for c in cams}
            free = [cam_at[c] for c in cams if refine and count[c] >= options.intrinsics_images and c not in options.pinned]
            args = ([self.cameras[c][0] for c in cams], [np.array(self.cameras[c][1], float) for c in cams], np.array([cam_at[self.camera_of[i]] for i in ids]),
                    np.array([self.poses[i][0] for i in ids]), np.array([self.poses[i][1] for i in ids]), np.array([self.xyz[n] for n in use]),
                    np.array([at[v[0]] for v in views]), np.array([v[2] for v in views]), np.array([self.pixels[v[0]][v[1]] for v in views], float))
            fixed = np.array([i in held or i in self.fixed or i not in within for i in ids])
            run = lambda c: bundle.adjust(*args, fixed, refine=c, options=bundle.Options(iterations=iterations, loss=options.loss))  # noqa: B023, E731
            out = run(free)
            if free:
                sound = all(np.isfinite(p).all() and all(abs(x) <= options.max_distortion for n, x in zip(bundle.CAMERA_MODELS[args[0][c]][1], p) if n[0] in "kp" and n != "p")
                            and p[0] > 0 for c in free for p in [out[0][c]])
                if not sound:
                    out = run([])
            for c in cams:
                self.cameras[c] = (self.cameras[c][0], out[0][cam_at[c]])
            for i in ids:
                self.poses[i] = (out[1][at[i]], out[2][at[i]])
            for n, x in zip(use, out[3]):
                self.xyz[n] = x
            dropped = 0
            for n in use:
                t = self.track[n]
                seen = [(i, k) for i, k in t.items() if i in self.poses]
                for (i, k), e in zip(seen, self.errors(self.xyz[n], seen)):
                    if e > options.max_error:
                        del t[i]
                        self.owner.pop((i, k), None)
                        dropped += 1
                if len(t) < 2:
                    for view in t.items():
                        self.owner.pop(view, None)
                    t.clear()
            if not dropped:
                break


def seed_score(model: Model, p: Pair, options: Growth) -> int:
    """Matches of a pair that would give points of a wide angle and a small error."""
    model.poses = {p.i: (np.eye(3), np.zeros(3)), p.j: (p.r, p.t)}
    return sum(model.triangulated([(p.i, a), (p.j, b)], options.seed_angle, options.max_error) is not None for a, b in zip(p.k1, p.k2))


def grown(cameras, camera_of, pixels, pairs, known=None, options: Growth = Growth()) -> Model | None:
    """The model with the most images (then points) of up to options.seeds seeds; the first that registers all images ends the search.

    known: image -> (R, t, fixed); two of them and more replace the seed pair. None where nothing starts."""
    fresh = lambda: Model(dict(cameras), camera_of, pixels, pairs)
    known = {i: v for i, v in (known or {}).items() if i in camera_of}
    fixed = {i for i, v in known.items() if v[2]}
    if len(known) >= 2:
        starts = [None]
    else:
        ranked = sorted(((seed_score(fresh(), p, options), n) for n, p in enumerate(pairs)), key=lambda e: (-e[0], e[1]))
        ranked = [e for e in ranked if e[0] > 0]
        dense = [e for e in ranked if len(pairs[e[1]].k1) >= options.seed_matches] or ranked
        starts = [pairs[n] for _, n in dense[: options.seeds]]
    best, best_key = None, (0, 0)
    for p in starts:
        m = fresh()
        m.fixed = fixed
        if p is None:
            m.poses = {i: (v[0], v[1]) for i, v in known.items()}
            held = set(known)
            for i in sorted(known):
                m.extend(i, options)
        else:
            m.poses = {p.i: (np.eye(3), np.zeros(3)), p.j: (p.r, p.t)}
            held = {p.i}
            m.extend(p.j, options)
        m.optimise(options, held)
        failed, skip, last = set(), set(), (len(m.poses), max(len(m.xyz), 1))
        while len(m.poses) < len(camera_of):
            open_images = [(-len(m.correspondences(i)), i) for i in sorted(camera_of) if i not in m.poses and i not in failed]
            if open_images and -min(open_images)[0] >= options.min_correspondences:
                image = min(open_images)[1]
                if not m.register(image, options):
                    failed.add(image)
                    continue
            else:
                image = m.bridge(skip, options)
                if image is None:
                    break
                if image == -1:
                    continue
            failed.clear()
            shared = {}
            for t in m.track:
                if image in t:
                    for i in t:
                        shared[i] = shared.get(i, 0) + 1
            near = sorted((i for i in shared if i != image), key=lambda i: (-shared[i], i))[: options.local_window]
            m.optimise(options, held, [image, *near], iterations=25)
            if len(m.poses) >= options.growth * last[0] or len(m.xyz) >= options.growth * last[1]:
                m.optimise(options, held, refine=options.refine_intrinsics)
                last = len(m.poses), len(m.xyz)
        m.retriangulate(options)
        m.optimise(options, held, refine=options.refine_intrinsics, iterations=200)
        key = (len(m.poses), sum(len(t) >= 2 for t in m.track))
        if key[1] and key > best_key:
            best, best_key = m, key
        if best is not None and len(best.poses) == len(camera_of):
            break
    return best
