import itertools
import tracemalloc

import numpy as np

from tessella.operators import matching, reconstruct
from tessella.plans import catalog


def test_matches_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    pairs, kp = catalog.all_pairs(spark, d), catalog.keypoints(spark, d)
    by = {}
    for r in kp.collect():
        by.setdefault(r.image, {})[r.kp] = np.array(r.desc)
    for ratio in (0.8, 0.95, 2.0):
        want = set()
        for i, j in map(tuple, pairs.collect()):
            k1, k2 = sorted(by[i]), sorted(by[j])
            dist = np.array([[((by[i][a] - by[j][b]) ** 2).sum() for b in k2] for a in k1])
            for x, row in enumerate(dist):
                y, second = int(row.argmin()), np.sort(row)[1] if len(row) > 1 else np.inf
                if row[y] < ratio * ratio * second and int(dist[:, y].argmin()) == x:
                    want.add((i, j, k1[x], k2[y]))
        assert set(map(tuple, matching.match_float_products(pairs, kp, ratio).collect())) == want


def matches(one, two, factor):
    """Brute force with sums of squared differences in order; ties go to the lower keypoint, which is the lower place here."""
    d = np.array([[np.cumsum((a - b) ** 2)[-1] for b in two] for a in one])
    to, back = d.argmin(axis=1), d.argmin(axis=0)
    second = np.sort(d, axis=1)[:, 1] if len(two) > 1 else np.full(len(one), np.inf)
    return {(x, int(y)) for x, y in enumerate(to) if d[x, y] < factor * second[x] and back[y] == x}


def test_blocks_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(4)
    for kind in ("far", "bits", "copies"):
        near = r.normal(size=(40, 6))
        sets = []
        for n in (37, 52, 1):
            v = near[r.integers(0, 40, n)] + r.normal(size=(n, 6)) * 0.05
            sets.append(v + 1e6 if kind == "far" else (v > 0).astype(float) if kind == "bits" else np.round(v) + 0.1)
        rows = [(i, k, v.tolist()) for i, vs in enumerate(sets) for k, v in enumerate(vs)] + [(0, 900, None)]
        kp = spark.createDataFrame(rows, "image long, kp long, desc array<double>")
        pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2), (0, 1), (2, 7)], "i long, j long")
        want = {(i, j, a, b) for i, j in ((0, 1), (0, 2), (1, 0), (1, 2)) for a, b in matches(sets[i], sets[j], 0.95)}
        for block in (matching.BLOCK, 60):  # one block, and several of each image
            monkeypatch.setattr(matching, "BLOCK", block)
            got = list(map(tuple, matching.match_float_products(pairs, kp, 0.95, linear=True).collect()))
            assert len(got) == len(want) and set(got) == want, (kind, block)


def test_many_descriptors_in_bounded_memory(monkeypatch):
    r = np.random.default_rng(5)
    one, two = r.normal(size=(6000, 8)), r.normal(size=(9000, 8))
    tracemalloc.start()
    near = matching._Nearest(np.arange(6000), one)
    for i in range(0, 9000, 2500):
        near.add(np.arange(i, min(9000, i + 2500)), two[i : i + 2500], np.zeros(min(2500, 9000 - i), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6000 * 9000 * 8 / 4  # not all distances at once
    k2, k1, _, ok = near.rows(0.9)
    some = r.choice(6000, 200, replace=False)
    d = ((one[some][:, None, :] - two[None]) ** 2).sum(axis=2)
    assert (near.to[some] == d.argmin(axis=1)).all() and np.allclose(near.second[some], np.sort(d, axis=1)[:, 1])
    assert (k1[:50] == ((two[k2[:50]][:, None, :] - one[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert ok.any() and not ok.all()


def test_bits_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 1000)
    r = np.random.default_rng(6)
    sets = [r.integers(0, 1 << 12, n) for n in (70, 55)]  # few values: equal codes and many equal distances
    kp = spark.createDataFrame([(i, k, [int(c)]) for i, s in enumerate(sets) for k, c in enumerate(s)], "image long, kp long, desc_b array<long>")
    kp = kp.selectExpr("image AS image_id", "kp", "cast(null AS array<double>) AS desc_f", "desc_b", "cast(null AS struct<capture_id:long,marker_id:int,corner_index:int>) AS desc_m")
    one, two = (((s[:, None] >> np.arange(12)) & 1).astype(float) for s in sets)
    plans, run = [], matching.match_float_products
    monkeypatch.setattr(matching, "match_float_products", lambda *a, **k: plans.append(run(*a, **k)) or plans[-1])
    got = list(map(tuple, reconstruct.putative(spark.createDataFrame([(0, 1)], "i long, j long"), kp, 0.95).collect()))
    assert sorted(got) == sorted((0, 1, a, b) for a, b in matches(one, two, 0.95))
    assert all("collect_list" not in p._jdf.queryExecution().toString() for p in plans)  # no row holds a whole image


def test_equal_distances_in_bounded_memory():
    r = np.random.default_rng(7)
    codes = np.array([np.isin(np.arange(62), t) for t in itertools.combinations(range(62), 3)], float)
    one, two = codes[r.choice(len(codes), 3000, replace=False)], 1 - codes[r.choice(len(codes), 3000, replace=False)]  # most distances are the least there is
    k1, k2, again = r.permutation(3000), r.permutation(3000), r.random(3000) < 0.2
    tracemalloc.start()
    near = matching._Nearest(k1, one)
    for i in range(0, 3000, 1100):
        near.add(k2[i : i + 1100], two[i : i + 1100], again[i : i + 1100])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6  # 136 MB when ties were listed one by one
    one, two, again = one[np.argsort(k1)], two[np.argsort(k2)], again[np.argsort(k2)]
    d = one.sum(axis=1)[:, None] + two.sum(axis=1)[None] - 2 * one @ two.T
    assert (near.to[np.argsort(near.kp)] == d.argmin(axis=1)).all()
    d = np.concatenate([d, np.where(again, d, np.inf)], axis=1)
    assert (near.second[np.argsort(near.kp)] == np.sort(d, axis=1)[:, 1]).all()
    to, first, e, _ = near.rows(0.9)
    assert sorted(to) == list(range(3000)) and (first == d[:, to].argmin(axis=0)).all() and (e == d[:, to].min(axis=0)).all()


def test_words_are_shuffled_as_words(spark, monkeypatch):
    r = np.random.default_rng(8)
    near = r.integers(-(1 << 63), 1 << 63, size=(30, 2))
    sets = [near[r.integers(0, 30, n)] ^ (np.int64(1) << r.integers(0, 64, size=(n, 2))) for n in (41, 36)]
    rows = [(i, k, [int(w) for w in c]) for i, s in enumerate(sets) for k, c in enumerate(s)] + [(0, 800, None), (0, 900, [None, 1])]
    kp = spark.createDataFrame(rows, "image_id long, kp long, desc_b array<long>")
    kp = kp.selectExpr("image_id", "kp", "cast(null AS array<double>) AS desc_f", "desc_b", "cast(null AS struct<capture_id:long,marker_id:int,corner_index:int>) AS desc_m")
    one, two = (np.array([[(int(w) >> b) & 1 for w in c for b in range(64)] for c in s], float) for s in sets)
    plans, run = [], matching.match_float_products
    monkeypatch.setattr(matching, "match_float_products", lambda *a, **k: plans.append(run(*a, **k)) or plans[-1])
    got = list(map(tuple, reconstruct.putative(spark.createDataFrame([(0, 1)], "i long, j long"), kp, 0.95).collect()))
    assert got and sorted(got) == sorted((0, 1, a, b) for a, b in matches(one, two, 0.95))
    dealt, nodes = [], [plans[-1]._jdf.queryExecution().analyzed()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        dealt += [node.schema().simpleString()] if node.nodeName().startswith("Repartition") else []
    assert dealt and all("v:array<bigint>" in x for x in dealt)  # a number for each bit is 64 times as much
