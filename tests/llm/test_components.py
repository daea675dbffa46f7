import random

from linkloom.llm.components import components


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 180)] + [(500, k) for k in range(501, 560)] + [(7, 7), (9, 8), (9, 8)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    got = {r.node: r.component for r in found}
    assert len(found) == len(got)
    assert {k: v for k, v in got.items()} == {k: root(k) for k in top if k != 7}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
