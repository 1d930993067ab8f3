import random
import re

from tessella.llm.ngram_join import ngram_jaccard_join

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=5):
    sets = {}
    for i, t in rows:
        w = TOKEN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(60)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.7:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w = w[: r.randint(1, len(w))]
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 4, 5, 6, 40, 90, 200]))))
    return texts + ["", None, " \n\t", "A b", "a B", "one", "É é x y z", "é é x y z", "a\x0bb c", "x" * 3_000_000 + " y z"]


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = [(i * 3, t) for i, t in enumerate(corpus(seed))]
        got = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {tuple(x) for x in got} == brute(rows)
        assert len(got) == len(rows)


def test_edges(spark):
    empty = ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string, n long, component long"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 6), (None, "a b c d e f", 7), (2, "a b c d e f", None)]
    got = sorted(map(tuple, ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 0, None)]


def test_all_links_of_classes(spark):
    import random

    from tessella.llm.ngram_join import class_links

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    data = []
    for _ in range(4):
        base = [word() for _ in range(80)]
        for _ in range(12):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                w[r.randrange(80)] = word()
            data.append((len(data), " ".join(w)))
    data += [(900, None), (901, ""), (902, "one two"), (903, "one two"), (3, data[3][1])]
    sets = {}
    for i, t in data:
        w = (t or "").split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    names = sorted((i, s) for s, i in first.items())
    links, members = class_links(spark.createDataFrame([*data, (None, "no id")], "doc_id long, text string"))
    got = [(x.a, x.b) for x in links.collect()]
    want = {(i, j) for i, s in names for j, t in names if i < j and near(s, t)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    rows = members.collect()
    assert len(rows) == len(data) + 1
    for x in rows:
        if x.doc_id is not None:
            assert x.class_id == (first[sets[x.doc_id]] if sets[x.doc_id] else None) and x.n_links == sum(near(sets[x.doc_id], t) for j, t in sets.items() if j != x.doc_id)
