import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import decontaminate
from tessella.llm.decontaminate import contaminated, tiles, without_contaminated


def greedy(a, b, m):
    """Greedy string tiling by the definition."""
    ma, mb, out = [False] * len(a), [x is None for x in b], []
    while True:
        best = None
        for x in range(len(a)):
            for y in range(len(b)):
                k = 0
                while x + k < len(a) and y + k < len(b) and not ma[x + k] and not mb[y + k] and a[x + k] == b[y + k]:
                    k += 1
                if k >= m and (best is None or k > best[2]):
                    best = (x, y, k)
        if best is None:
            return out
        x, y, k = best
        ma[x : x + k] = [True] * k
        mb[y : y + k] = [True] * k
        out.append(best)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=30), st.integers(1, 4), st.sampled_from([4, 20]))
def test_tiles_are_greedy(a, b, m, start):
    want, got = greedy(a, b, m), tiles(a, b, m, start)
    assert sorted(got) == sorted(want)
    for x, y, k in got:
        assert a[x : x + k] == b[y : y + k] and k >= m


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def test_reordered_passages_are_caught(spark):
    r = random.Random(1)
    items = [(i, words(r, 30)) for i in range(20)]
    docs, want = [], {}
    for i in range(200):
        w = words(r, 100)
        if i % 5 == 0:
            item, t = r.choice(items)
            parts = [t[0:10], t[10:20], t[20:30]]
            r.shuffle(parts)
            w = w[:40] + parts[0] + w[40:60] + parts[1] + parts[2] + w[60:]
            want[i] = item
        elif i % 5 == 1:
            _, t = r.choice(items)
            w = w[:40] + t[:9] + w[40:]  # a short quotation
        docs.append((i, " ".join(w).title() + ".", 3, "x"))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int, coverage string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(99, None), (98, "one two"), (97, "")], "item_id long, text string")
    got = contaminated(df, bench).collect()
    assert {g.doc_id: g.item_id for g in got} == want and len(got) == len(want)
    kept = without_contaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i in range(200)} - set(want)


def test_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 40)
    text = "a1 b2 c3 d4 e5 f6 g7 h8"
    df = spark.createDataFrame([(1, text.upper()), (1, text), (None, text), (2, None), (3, ""), (4, "É" + text)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, text), (6, text), (7, "z " * 30)], "item_id long, text string")
    got = sorted([(x.doc_id or -1, x.item_id, x.n_tiles) for x in contaminated(df, bench).collect()])
    assert got == [(-1, 5, 1), (-1, 6, 1), (1, 5, 1), (1, 5, 1), (1, 6, 1), (1, 6, 1), (4, 5, 1), (4, 6, 1)]
    assert contaminated(df.limit(0), bench).count() == 0 and contaminated(df, bench.limit(0)).count() == 0


def test_repeated_tokens():
    """One token again and again in both: the places that match are many, the tiles few."""
    assert tiles([7] * 800, [7] * 6000) == [(0, 0, 800)]
    assert sum(k for _, _, k in tiles([1, 2] * 300, [2, 1] * 500 + [None] + [3] * 500)) == 600
    got = tiles([1] * 400 + [2] + [1] * 400, [1] * 300 + [3] + [1] * 900)
    assert sum(k for _, _, k in got) == 800 and got[0] == (0, 301, 400)


def test_contaminated_against_brute_force(spark):
    """Every pair of document and item, tiled by the definition over all tokens."""
    import re

    r = random.Random(7)
    item_words = [words(r, r.choice([3, 5, 12, 30])) for _ in range(12)]
    items = [(i, " ".join(t)) for i, t in enumerate(item_words)] + [(50, "rep " * 20)]
    docs = []
    for i in range(60):
        w = words(r, r.choice([0, 5, 40]))
        for _ in range(r.randint(0, 4)):
            t = r.choice(item_words)
            k = r.randint(0, len(t) - 1)
            w += t[k : k + r.choice([4, 5, 9, 30])] + words(r, r.randint(0, 2))
        docs.append((i, ", ".join(w).upper()))
    docs += [(100, "rep " * 13), (101, "rep " * 11), (102, None), (103, "Rep-" * 300)]
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = []
    for d, text in docs:
        for n, item in items:
            a, b = tokens(item), tokens(text)
            laid = greedy(a, b, 5)
            if len(a) >= 5 and sum(x[2] for x in laid) >= 0.6 * len(a):
                want.append((d, n, round(sum(x[2] for x in laid) / len(a), 9), len(laid), max(x[2] for x in laid)))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, round(x.coverage, 9), x.n_tiles, x.longest_tile) for x in got) == sorted(want) and len(want) > 10
