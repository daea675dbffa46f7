"""Graph queries against brute force on a small random graph."""

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.operators import graph, resolve


@pytest.fixture(scope="module")
def small(spark):
    rnd = random.Random(2)
    nodes = [f"domain:n{i},%_" for i in range(14)]  # ids may hold commas and wildcards
    pairs = sorted({tuple(rnd.sample(nodes, 2)) for _ in range(20)} | {(nodes[0], nodes[1]), (nodes[1], nodes[2]), (nodes[2], nodes[0])})
    rels = spark.createDataFrame(
        [(f"{a}:r:{b}", "i", a, b, "r", 0.5, 1, None, "m") for a, b in pairs], schemas.RELATIONSHIPS
    )
    ents = spark.createDataFrame(
        [(n, "i", "Domain", n[7:], 0.5, None, None, 0, ["dns"], 1, {"a": "b"}) for n in nodes], schemas.ENTITIES
    )
    adjacent = {n: set() for n in nodes}
    for a, b in pairs:
        adjacent[a].add(b)
        adjacent[b].add(a)
    return ents, rels, nodes, pairs, adjacent


def within(adjacent, seed, depth):
    dist, queue = {seed: 0}, deque([seed])
    while queue:
        n = queue.popleft()
        if dist[n] < depth:
            for m in adjacent[n]:
                if m not in dist:
                    dist[m] = dist[n] + 1
                    queue.append(m)
    return dist


def test_neighbours_and_induced_edges(spark, small):
    ents, rels, nodes, pairs, adjacent = small
    seeds = ents.select("investigation_id", F.col("id").alias("seed"))
    for depth in (1, 3):
        found, edges = graph.neighbors(ents, rels, seeds, depth)
        got = {}
        for r in found.collect():
            got.setdefault(r.seed, {})[r.id] = r.hops
        assert got == {n: within(adjacent, n, depth) for n in nodes}
        want = sorted((s, a, b) for s in nodes for a, b in pairs if a in got[s] and b in got[s])
        assert sorted((r.seed, r.source_id, r.target_id) for r in edges.collect()) == want


def test_node_limit_keeps_the_nearest(spark, small):
    ents, rels, nodes, _pairs, adjacent = small
    seeds = ents.select("investigation_id", F.col("id").alias("seed"))
    found, _ = graph.neighbors(ents, rels, seeds, 2, max_nodes=3)
    for seed in nodes:
        dist = within(adjacent, seed, 2)
        want = [n for _d, n in sorted((d, n) for n, d in dist.items())][:3]
        assert sorted(r.id for r in found.where(F.col("seed") == seed).collect()) == sorted(want)


def test_paths(spark, small):
    _ents, rels, nodes, _pairs, adjacent = small
    wanted = [(nodes[0], nodes[5]), (nodes[3], nodes[9]), (nodes[4], nodes[4])]

    def walk(path, dst, left):
        if path[-1] == dst:
            return [path]
        if not left:
            return []
        return [p for m in adjacent[path[-1]] if m not in path for p in walk([*path, m], dst, left - 1)]

    df = spark.createDataFrame([("i", a, b) for a, b in wanted], "investigation_id string, src string, dst string")
    got = sorted((r.src, r.dst, tuple(r.path)) for r in graph.paths(rels, df, 5).collect())
    assert got == sorted((a, b, tuple(p)) for a, b in wanted for p in walk([a], b, 5))
    few = graph.paths(rels, df, 5, keep=2)
    assert all(r["count"] <= 2 for r in few.groupBy("src", "dst").count().collect())
    assert few.count() == sum(min(2, len(walk([a], b, 5))) for a, b in wanted)


def test_long_paths_in_a_ladder(spark):
    """Two rails with rungs between them: 8 hops lead over a node of each step, and each odd way ends on the other rail."""
    edges = [(f"{r}{k}", f"{r}{k + 1}") for r in "ab" for k in range(8)] + [(f"a{k}", f"b{k}") for k in range(9)]
    rels = spark.createDataFrame(
        [(f"{a}:r:{b}", "i", a, b, "r", 0.5, 1, None, "m") for a, b in edges], schemas.RELATIONSHIPS
    )
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walk(path, dst, left):
        if path[-1] == dst:
            return [tuple(path)]
        return [p for m in near[path[-1]] if left and m not in path for p in walk([*path, m], dst, left - 1)]

    pairs = spark.createDataFrame([("i", "a0", "b5"), ("i", "a0", "a8"), ("i", "b2", "a4")], "investigation_id string, src string, dst string")
    got = sorted(tuple(r.path) for r in graph.paths(rels, pairs, 8).collect())
    assert got == sorted(walk(["a0"], "b5", 8) + walk(["a0"], "a8", 8) + walk(["b2"], "a4", 8))


def test_edges_both_ways(spark, small):
    _ents, rels, _nodes, pairs, _adjacent = small
    assert resolve.edges_bidi(rels).count() == 2 * len(pairs)


def test_paging_drops_or_keeps_dangling_edges(spark, small):
    ents, rels, nodes, pairs, _adjacent = small
    page = set(sorted(nodes)[2:7])
    some, edges = graph.subgraph(ents, rels, limit=5, offset=2)
    assert {r.id for r in some.collect()} == page
    assert edges.count() == sum(a in page and b in page for a, b in pairs)
    assert graph.subgraph(ents, rels, limit=5, keep_dangling=True)[1].count() == len(pairs)


def test_elements(spark, small):
    ents, rels, *_ = small
    nodes, edges = graph.to_graph_json(ents, rels)
    data = json.loads(nodes.first().element)["data"]
    assert data["source_count"] == 1 and data["label"] == data["id"][7:] and data["properties"] == {"a": "b"}
    assert json.loads(edges.first().element)["data"]["relationship_type"] == "r"
