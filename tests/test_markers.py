import numpy as np
import pytest

from tessella.functions import markers as M
from tessella.sources import synthetic


def test_planar_geometry():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [5, 5], [2, 7]], float)
    hull = M.convex_hull(square)
    assert len(hull) == 4 and abs(M.area(hull)) == 100
    c, s = np.cos(0.3), np.sin(0.3)
    rect = M.min_area_rectangle(M.convex_hull(square @ np.array([[c, s], [-s, c]])))
    assert abs(abs(M.area(rect)) - 100) < 1e-9
    dst = np.array([[10, 20], [110, 15], [105, 115], [8, 120]], float)
    h = M.homography([(0, 0), (1, 0), (1, 1), (0, 1)], dst)
    assert np.allclose(M.mapped(h, np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)), dst, atol=1e-6)
    assert M.homography([(0, 0)] * 4, dst) is None


def test_components_match_flood_fill():
    mask = np.random.default_rng(0).random((40, 50)) < 0.55
    label, n = M.components(mask)
    seen, count = np.full(mask.shape, -1), 0
    for y, x in np.argwhere(mask):
        if seen[y, x] < 0:
            todo, seen[y, x] = [(y, x)], count
            while todo:
                a, b = todo.pop()
                for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if 0 <= p[0] < 40 and 0 <= p[1] < 50 and mask[p] and seen[p] < 0:
                        seen[p] = count
                        todo.append(p)
            count += 1
    assert n == count and len({(a, b) for a, b in zip(label[mask], seen[mask])}) == n and (label[~mask] == -1).all()
    assert M.components(np.zeros((3, 3), bool))[1] == 0


def test_dictionary():
    d = M.dictionary(50)
    assert len(d) == 50 and len(set(d)) == 50
    for i, a in enumerate(d):
        assert len(set(M.turns(a))) == 4
        for b in d[:i]:
            assert min(bin(a ^ t).count("1") for t in M.turns(b)) >= 4


@pytest.mark.parametrize("quarter", range(4))
def test_marker_is_found_in_any_turn(quarter):
    img = np.ones((300, 300))
    img[40:160, 40:160] = M.drawn(M.dictionary(50)[3], 20)
    (marker, corners, distance), = M.detect(np.rot90(img, quarter))
    assert marker == 3 and distance == 0
    want = np.array([[40, 40], [160, 40], [160, 160], [40, 160]], float) - 0.5
    for _ in range(quarter):
        want = np.c_[want[:, 1], 299 - want[:, 0]]
    assert np.abs(corners - want).max() <= 1


def test_weak_contrast_needs_exposure():
    img = synthetic.scene([0, 1], size=400, contrast=0.04)
    assert M.detect(img) == []
    assert [m[0] for m in M.detect(img, M.MarkerParams(contrast=10.0))] == [0, 1]
    assert M.detect(np.full((64, 64), 0.5)) == []
