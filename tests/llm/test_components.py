import random

from cumulus.llm.components import components


def test_against_union(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(1_000, i) for i in range(400, 900)] + [(i, i + 1) for i in range(2_000, 2_060)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()))
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
