import numpy as np

from tessella.functions import imaging as I


def noise(seed, h=160, w=200):
    img = I.blur(np.random.default_rng(seed).random((h, w)), 2)
    return (img - img.min()) / (img.max() - img.min())


def matched(a, b):
    d = ((a["desc"][:, None] - b["desc"][None]) ** 2).sum(2)
    best = np.sort(d, axis=1)
    ok = best[:, 0] < 0.64 * best[:, 1]
    return np.flatnonzero(ok), d.argmin(1)[ok]


def test_sift_follows_shift_and_rotation():
    img = noise(0)
    a = I.sift(img)
    assert np.allclose(np.linalg.norm(a["desc"], axis=1), 1)
    b = I.sift(np.roll(img, 10, axis=1))
    i, j = matched(a, b)
    assert len(i) > 0.5 * len(a["x"]) and np.median(b["x"][j] - a["x"][i]) == 10 and abs(np.median(b["y"][j] - a["y"][i])) < 1e-9
    r = I.sift(np.rot90(img).copy())
    i, j = matched(a, r)
    assert len(i) > 0.9 * len(a["x"]) and np.median(np.abs(r["x"][j] - a["y"][i])) < 1e-6


def test_caps_keep_the_strongest_in_order():
    a, b = I.sift(noise(1)), I.sift(noise(1), most=20)
    keep = np.sort(np.argsort(-a["response"], kind="stable")[:20])
    assert np.array_equal(a["x"][keep], b["x"])


def test_orb_matches_a_shifted_image_and_blank_images_are_empty():
    img = noise(2)
    a, b = I.orb(img), I.orb(np.roll(img, 7, axis=1))
    bits = lambda d: np.unpackbits(d.view(np.uint8), axis=1).astype(int)
    d = (bits(a["desc"])[:, None, :] != bits(b["desc"])[None]).sum(2)
    j = d.argmin(1)
    assert np.median(b["x"][j] - a["x"]) == 7
    for f in (I.sift, I.orb):
        assert len(f(np.full((90, 90), 0.5))["x"]) == 0 and len(f(np.zeros((3, 3)))["x"]) == 0


def test_segment_score_finds_a_corner():
    img = np.zeros((60, 60))
    img[30:, 30:] = 1
    s = I._segment_scores(img, 20 / 255, 4)
    y, x = np.unravel_index(s.argmax(), s.shape)
    assert abs(y - 30) <= 1 and abs(x - 30) <= 1
