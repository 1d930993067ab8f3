import math

import numpy as np

from tessella.llm import topk
from tessella.llm.topk import Lists, Reading, exact_top_k


def brute(rows, queries, k):
    q = {i: v for i, v in rows if v and None not in v and all(math.isfinite(x) for x in v)}
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and None not in v and all(math.isfinite(x) for x in v)]
    out = set()
    for a in queries:
        if a in q:
            x = [math.floor(1024 * y) for y in q[a]]
            s = sorted([(-sum(p * r for p, r in zip(x, v)), i) for i, v in ok if i != a and len(v) == len(x)])[:k]
            out |= {(a, n + 1, i, -t) for n, (t, i) in enumerate(s)}
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 200)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(r.normal(size=8), 1 if i % 3 else 3)]) for i in range(1500)]
    rows += [(2000, None), (2001, [1.0, None] * 4), (2002, [float("nan")] + [1.0] * 7), (2003, [float("inf")] + [1.0] * 7), (2004, []), (2005, [1.0, 2.0]), (2010, [3.0, 2.0]), (2100, [1e30] * 8)]
    df = spark.createDataFrame([(*x, 1, 1) for x in rows], "vec_id long, embedding array<double>, rank int, score int").repartition(3)
    got = exact_top_k(df, df.where("vec_id % 100 = 0"), 10)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute([x for x in rows if x[0] != 2100], range(0, 2100, 100), 9)
    seen = set(map(tuple, got.collect()))
    big = {x for x in seen if 2100 in (x[0], x[2])}
    assert {x[3] for x in big if x[0] != 2100} <= {(1 << 63) - 1, -(1 << 63)}
    plain = set(map(tuple, exact_top_k(df.where("vec_id <> 2100"), df.where("vec_id % 100 = 0 and vec_id <> 2100"), 9).collect()))
    assert plain == want
    assert exact_top_k(df.limit(0), df).count() == 0 and exact_top_k(df, df.limit(0)).count() == 0


def read_to(x, q, depth):
    order = np.argsort(x, axis=0, kind="stable")
    reading = Reading(x, order, np.argsort(order, axis=0), q)
    for d in sorted({depth // 3, depth // 2, depth} - {0}):
        reading.read(d)
    return reading


def test_bounds_hold():
    r = np.random.default_rng(2)
    x = np.floor(1024 * np.round(r.normal(size=(3000, 6)), 1))  # with ties
    q = np.floor(1024 * r.normal(size=(20, 6)))
    q[3] = 0
    true = x @ q.T
    for depth in (1, 100, 1500, 2999):
        reading = read_to(x, q, depth)
        assert (reading.lower(np.arange(20)) <= true).all() and (reading.upper(np.arange(20)) >= true).all()
        for j in range(20):
            read = [np.r_[reading.order[3000 - depth :, d]] if q[j, d] > 0 else reading.order[:depth, d] for d in range(6) if q[j, d]]
            unseen = np.setdiff1d(np.arange(3000), np.concatenate(read) if read else [])
            assert (true[unseen, j] <= reading.outsider()[j]).all()
    assert (read_to(x, q, 3000).partial == true).all()


def test_reading_stops_before_the_end():
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    x = np.floor(1024 * (centres[r.integers(0, 12, 4000)] * 3 + r.normal(size=(4000, 16)) * 0.2))
    q = np.floor(1024 * centres * 3)
    lists = Lists(np.arange(4000), x)
    got = lists.top(np.arange(12) + 10_000, q, 10, np.full(12, -np.inf))
    for (name, ids, scores), want in zip(sorted(got, key=lambda g: g[0]), (x @ q.T).T):
        order = np.lexsort((np.arange(4000), -want))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
    assert len(lists.depths) == 12 and max(lists.depths) < 0.75 and np.mean(lists.depths) < 0.6


def test_repeated_and_null_ids(spark):
    rows = [(100, [None, 1.0]), (100, [2.0, 1.0]), (100, [3.0, 1.0]), (None, [9.0, 9.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.25]), (200, [float("nan"), 1.0]), (300, None), (400, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, exact_top_k(df, df.where("vec_id % 100 = 0"), 10).collect()))
    assert got == [(100, 1, 1, 3 * 1024 * 1024), (100, 2, 1, 3 * 1024 * 1024), (100, 3, 2, 1024 * 1024 + 256 * 1024)]


def test_blocks_and_readers(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("READERS", 3), ("STEPS", 5)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=5)]) for i in range(700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    assert set(map(tuple, exact_top_k(df, df.where("vec_id % 50 = 0"), 4).collect())) == brute(rows, range(0, 700, 50), 4)
