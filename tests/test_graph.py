import random

from tessella.operators.graph import connected_components


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(200)] + [(None, 3), (4, None), (9, 9)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {(x.id, x.component) for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {(x, find(x)) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
