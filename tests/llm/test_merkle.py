import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import merkle as M

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, source, lang, n_chars, text):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root of a list of nodes, and of each the runs above it: (own place, run)."""
    ways = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            first = at[k] // 8 * 8
            way.append((at[k] - first, nodes[first : first + 8]))
            at[k] //= 8
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], ways


def brute_force(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    trees = {k: trees[k] for k in sorted(trees, key=lambda x: (x is not None, (x or "").encode()))}
    out, subs = [], []
    for docs in trees.values():
        docs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        root, ways = climb([leaf(*r) for r in docs])
        subs.append((root, ways, docs))
    root, tops = climb([s[0] for s in subs])
    for (sub, ways, docs), top in zip(subs, tops, strict=True):
        for r, way in zip(docs, ways, strict=True):
            claimed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                claimed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            node, proof = leaf(*claimed), []
            for own, run in way + top:
                proof += run[:own] + run[own + 1 :]
                node = h(*run[:own], node, *run[own + 1 :])
            out.append((r[0], leaf(*r), sub, root, h(*proof), node, node == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 512, 513, 700])
def test_positions_in_the_log(n):
    """Where the closed form puts each node is where a builder of the whole tree writes it."""
    leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    log = M.built(leaves, M.height(n))
    nodes, seen = leaves, []
    for level in range(M.height(n) + 1):
        for k, node in enumerate(nodes):
            at = M.position(level, k, n)
            assert log[32 * at : 32 * at + 32] == node
            seen.append(at)
        nodes = [M.digest(b"".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    assert sorted(seen) == list(range(len(log) // 32))


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_query_against_brute_force(spark, levels):
    """With blocks of 8 leaves a tree takes several tiers."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = found(M.document_manifest(docs, levels))
    assert got == brute_force(rows)
    assert {r[6] for r in got} == {True, False}


def odd(spark):
    rows = [(k, "s", "many", 3, "Text") for k in range(600)]
    rows += [(7, "s", "many", 3, "Text")] * 20 + [(7, "s", "many", 3, "other")]
    rows += [(None, None, None, None, None), (None, "a", None, 1, "x"), (None, "a", None, 1, "x")]
    rows += [(9, "é:", "", 0, ""), (12, "b", "one", 5, "Ünï A" * 50_000), (12, "b", "é", 5, None)]
    clash = ("tree", "idx", "n", "block", "digest", "log", "leaves", "above", "name", "root", "proof", "_p", "_u", "_c", "leaf")
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    return rows, df.withColumns({c: F.lit("x") for c in clash})


@pytest.mark.parametrize("levels", [1, 3])
def test_odd_rows(spark, levels):
    rows, df = odd(spark)
    assert found(M.document_manifest(df, levels)) == brute_force(rows)
    assert found(M.document_manifest(df.repartition(5, F.rand(1)), levels)) == brute_force(rows)


def test_no_rows(spark):
    _, df = odd(spark)
    assert M.document_manifest(df.limit(0)).count() == 0


def test_log_of_the_whole_tree(spark):
    """The tiers' nodes together are one log without gaps, and its last node is the root of the tree."""
    _, df = odd(spark)
    made = M.manifest(M.document_leaves(df), ["doc_id", "digest"], 2)
    logs = {}
    for r in M.log_nodes(made.tiers, 2).collect():
        logs.setdefault(r.tree, []).append(r)
    roots = {r.tree: r.subroot for r in made.roots.collect()}
    leaves = {}
    for r in made.leaves.orderBy("idx").collect():
        leaves.setdefault(r.tree, []).append(bytes(r.digest))
    assert set(logs) == set(roots) == set(leaves)
    for tree, rows in logs.items():
        rows.sort(key=lambda r: r.position)
        assert [r.position for r in rows] == list(range(len(rows)))
        assert b"".join(bytes(r.digest) for r in rows) == M.built(leaves[tree], M.height(len(leaves[tree])))
        assert rows[-1].digest == roots[tree]


def test_proof_of_a_wrong_place_fails(spark):
    _, df = odd(spark)
    rows = M.proofs(M.manifest(M.document_leaves(df), ["doc_id", "digest"])).collect()
    good = [r for r in rows if r.tree == "1many"]
    for a, b in zip(good, good[1:], strict=False):
        assert M.folded(bytes(a.digest), bytes(a.proof)) == a.root
        assert a.digest == b.digest or M.folded(bytes(a.digest), bytes(b.proof)) != a.root
