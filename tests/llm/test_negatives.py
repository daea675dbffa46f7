import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import negatives as N

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [1, 3, 300, 40_000, 2**24])
@pytest.mark.parametrize("width", [1, 64, 1_100])
def test_scores_are_exact(most, width):
    rng = np.random.default_rng(width)
    a = rng.integers(-most, most, (9, width), endpoint=True)
    b = rng.integers(-most, most, (31, width), endpoint=True)
    a[0], b[0], b[1] = most, most, -most
    got = N.Scores(b, N.moduli(width * most * most)).of(a)
    want = a.astype(object) @ b.T.astype(object)
    assert (got.astype(object) == want).all()


def test_moduli_tell_all_scores_apart():
    for bound in (1, 100, 125, 126, 10**6, 10**12, 2**61):
        primes = N.moduli(bound)
        assert math.prod(primes) > 2 * bound and math.prod(primes[:-1]) <= 2 * bound
        assert all(N.EXACT // (p // 2) ** 2 > 0 for p in primes)
    with pytest.raises(ValueError):
        N.moduli(2**63)


def brute_force(rows, anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    kept = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [math.floor(scale * float(x)) for x in v])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    out = set()
    for a, (label, v) in kept.items():
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=False)), b, own) for b, (own, w) in kept.items() if b != a]
        scored.sort()
        for minus, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -minus <= 100 * -x[0] <= high * -minus]
            out |= {(a, p, k, n, -minus, -s) for k, (s, n, _) in enumerate(fits[:negatives], 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = N.op13(spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(got.dtypes) == {c: "int" if c == "rank" else "bigint" for c in got.columns}
    want = brute_force(rows, lambda x: x % 100 == 0)
    assert found(got) == want and want


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(3)), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for k in range(300)]
    rows += [(k, 1, [0.5, 0.25, 0.5, -0.25]) for k in range(300, 360)]
    rows += [(360, 1, []), (361, 2, [0.5] * 9), (362, None, [1.0]), (363, 1, None), (364, 1, [1.0, None])]
    rows += [(365, 1, [float("nan")]), (366, 0, [float("inf")]), (None, 1, [1.0] * 6), (-10, 1, [0.75] * 6)]
    rows += [(20, 0, [0.25] * 6), (20, 2, [0.5] * 6)] + [(30, 1, [0.5] * 6)] * 50
    return rows


@pytest.mark.parametrize("blocks", [(N.BLOCK_ROWS, N.BLOCK_ANCHORS), (40, 7)])
@pytest.mark.parametrize("how", [{}, {"positives": 2, "negatives": 9, "low": 50, "high": 150}])
def test_odd_rows(spark, monkeypatch, blocks, how):
    monkeypatch.setattr(N, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(N, "BLOCK_ANCHORS", blocks[1])
    df = spark.createDataFrame(odd_rows(), "vec_id bigint, label int, embedding array<float>")
    clash = ("i", "j", "c", "r", "place", "ids", "labels", "is_anchor", "anchor_id", "at", "rank", "friends", "least", "top", "p")
    df = df.withColumns({c: F.lit("x") for c in clash})
    got = N.hard_negatives(df, F.col("vec_id") % 10 == 0, **how)
    want = brute_force(odd_rows(), lambda x: x % 10 == 0, **how)
    assert found(got) == want and want


def test_large_components(spark):
    rows = [(k, k % 2, [(-1) ** (k // 3) * 3000.5 * k, 7.25, 1e5]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = N.hard_negatives(df, F.col("vec_id") % 20 == 0)
    assert found(got) == brute_force(rows, lambda x: x % 20 == 0)
    wide = df.withColumn("embedding", F.array(F.lit(1e17)))
    with pytest.raises(ValueError):
        N.hard_negatives(wide, F.col("vec_id") % 20 == 0)


def test_no_rows_and_no_anchors(spark):
    df = spark.createDataFrame(odd_rows(), "vec_id bigint, label int, embedding array<float>")
    for none in (N.hard_negatives(df.limit(0), F.lit(True)), N.hard_negatives(df, F.col("vec_id") > 10**6)):
        assert none.collect() == [] and dict(none.dtypes)["rank"] == "int"
    assert N.hard_negatives(df.where("label = 1"), F.lit(True)).collect() == []
