import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing as M

SF = "/root/testdata/sf0.001"


def brute_force(rows, weights=M.WEIGHTS, percent=M.PERCENT, epochs=M.EPOCHS):
    """rows: (doc_id, source, text). A Counter of (doc_id, size, source_size, target, taken), targets as fractions."""
    groups = defaultdict(list)
    for doc_id, source, text in rows:
        key = hashlib.md5(f"{M.SEED}:{doc_id if doc_id is not None else text or ''}".encode()).hexdigest()[:12]
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        groups[source].append((key, doc_id is not None, doc_id or 0, size, doc_id))
    order = sorted(groups, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[3] for r in groups[s]) for s in order}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), Fraction(percent, 100) * sum(size.values())
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= epochs * size[s]}
        for s in full or open_:
            target[s] = Fraction(epochs * size[s]) if full else share * weight[s]
        open_, rest = (open_ - full, rest - sum(target[s] for s in full)) if full else (set(), 0)
    out = Counter()
    for s in order:
        left = math.floor(target[s])
        taken = [0] * len(groups[s])
        groups[s].sort()
        while left > 0:
            for k, r in enumerate(groups[s]):
                take = min(left, r[3])
                taken[k] += take
                left -= take
        for r, t in zip(groups[s], taken, strict=True):
            out[r[4], r[3], size[s], round(float(target[s]), 6), t] += 1
    return out


def found(df):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(M.op11(spark, SF)) == brute_force(rows)


def test_all_native(spark):
    plan = M.op11(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


ODD = [
    (1, "b", "one two three"),
    (2, "b", None),
    (3, None, "a b c d e f g"),
    (4, None, ""),
    (5, "é", "x " * 5000),
    (6, "a", "lone"),
    (7, "", "in a source without a name"),
    (None, "b", "no id here"),
    (None, "b", "no id there"),
    (None, None, None),
]


@pytest.mark.parametrize("percent, epochs", [(150, 2), (30, 1), (1000, 3)])
def test_odd_rows(spark, percent, epochs):
    rows = ODD + [(8, "b", "the same row again")] * 2500 + [(9, "é", "twice here")] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    clash = ("key", "bin", "copies", "size", "at", "start", "target", "all", "place", "_s", "_p", "run", "copy", "words")
    df = df.withColumns({c: F.lit("x") for c in clash})
    want = brute_force(rows, percent=percent, epochs=epochs)
    assert found(M.mixture(df, percent=percent, epochs=epochs)) == want
    again = df.repartition(7, F.rand(3))
    assert found(M.mixture(again, percent=percent, epochs=epochs)) == want


def test_no_rows_and_no_words(spark):
    df = spark.createDataFrame(ODD, "doc_id bigint, source string, text string")
    assert M.mixture(df.limit(0)).count() == 0
    assert M.mixed_texts(df.limit(0)).count() == 0
    none = M.mixture(df.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(none) == len(ODD) and {(r.size, r.source_size, r.target, r.taken) for r in none} == {(0, 0, 0.0, 0)}


def test_weights_from_a_table(spark):
    df = spark.createDataFrame(
        [(k, s, "w " * 100) for k, s in enumerate(["a"] * 30 + ["b"] * 30 + [None] * 30 + ["c"] * 30)],
        "doc_id bigint, source string, text string",
    )
    weights = spark.createDataFrame([("a", 1.0), ("b", 8.0), (None, 3.0)], "source string, weight double")
    rows = M.mixture(df, weights=weights, percent=75, epochs=2).collect()
    target = {r.source: r.target for r in rows}
    assert target == {"a": 750.0, "b": 6000.0, None: 2250.0, "c": 0.0}
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
    assert taken == {"a": 750, "b": 6000, None: 2250, "c": 0}


def test_texts_of_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    plan = {r.doc_id: r for r in M.mixture(docs).collect()}
    words, epochs = Counter(), Counter()
    cut = Counter()
    for r in M.mixed_texts(docs).collect():
        assert len(r.text.split()) == r.n_words or not r.text.isascii()
        assert text[r.doc_id].startswith(r.text)
        cut[r.source] += r.text != text[r.doc_id]
        words[r.doc_id] += r.n_words
        epochs[r.doc_id] += 1
    assert words == {d: r.taken for d, r in plan.items() if r.taken}
    assert max(epochs.values()) == 2 and max(cut.values()) == 1
    twice = docs.unionByName(docs.limit(1))
    with pytest.raises(Exception, match="ids that differ"):
        M.mixed_texts(twice).collect()
