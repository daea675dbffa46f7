import random

import numpy as np
from prose import prose

from linkloom.llm import secret_scan as S


def corpus(spark, n=60):
    rng = random.Random(3)
    rows = []
    for k in range(n):
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        token = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        card = "".join(rng.choice("0123456789") for _ in range(16))
        mail = f"name{k}.{rng.randrange(99)}@mail.example.com"
        rows.append((k, f'{prose(30, k)} {key} é {prose(5)} token = "{token}" x {card} {mail} {prose(20, k)}', key, token))
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, token string")


def test_secrets_are_found_and_harmless_values_are_not(spark):
    docs = corpus(spark)
    model = S.train(docs)
    found = S.secret_findings(docs, model).join(docs, "doc_id").collect()
    for r in found:
        value = r.text[r.start : r.start + r.length]
        assert r.secret == (value in (r.key, r.token)), value
    assert sum(r.secret for r in found) == 120
    for r in S.redacted(docs, model).collect():
        assert r.key not in r.text and r.token not in r.text and r.text.count("[SECRET]") == 2 and "@mail" in r.text


def test_odd_documents(spark, odd_docs, no_docs):
    model = S.train(odd_docs)
    assert S.secret_findings(odd_docs, model).where("secret").count() == 0
    assert S.redacted(odd_docs, model).collect() == odd_docs.collect()
    empty = S.train(no_docs)
    assert S.secret_findings(no_docs, empty).count() == 0
    assert S.secret_findings(corpus(spark, 2), empty).where("secret").count() == 0


def test_forest_learns_an_exclusive_or():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    forest = S.Forest(x[:400], y[:400], trees=30)
    assert ((forest.scores(x[400:]) >= 0.5) == y[400:]).mean() > 0.9


def test_counts_cover_the_corpus(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (2, "ab c"), (3, None)], "doc_id bigint, text string").repartition(3)
    counts = S.summed_counts(S.survey(docs).where("part IS NOT NULL"), chunk=S.CHUNK)
    assert counts[0 * S.KINDS + 1] == 3 and counts[S.KINDS * S.KINDS + S.slot(b"ab")] == 3
