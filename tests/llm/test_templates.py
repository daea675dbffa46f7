from pyspark.sql import functions as F

from prose import prose
from linkloom.llm import templates as T

QUESTION = "Alice has 12 apples and Bob gives her 30 kg of pears, so how many fruits does the happy Alice own after 12 days?"
OTHER = "Carol has 7 apples and Dave gives her 55 lb of pears, so how many fruits does the happy Carol own after 7 days?"
MIXED = "Carol has 7 apples and Dave gives her 55 lb of pears, so how many fruits does the happy Eve own after 9 days?"


def bench(spark):
    items = [(1, QUESTION), (2, "a short one"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10"), (2, "a short one")]
    return spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))


def test_copies_and_new_parameters(spark):
    rows = [
        (1, f"{prose(30)} {QUESTION} {prose(30)}"),
        (2, f"{prose(30)} {OTHER} {prose(30)}"),
        (3, f"{prose(30)} {MIXED} {prose(30)}"),
        (4, f"{prose(30)} {QUESTION[:40]} {prose(30)}"),
        (5, f"{prose(10)}. A short one {prose(9)}"),
        (6, "7 1 2 3 4 5 6 7 8 9 10"),
        (7, "21 22 23 24 25 26 27 28 29 30"),
        (8, prose(300)),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    got = {(r.doc_id, r.item_id): r for r in T.leaks(docs, bench(spark)).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 2), (6, 5)}
    assert got[1, 1].n_changed == 0 and got[2, 1].n_changed > 0 and got[1, 1].coverage > 0.9
    left = T.without_leaks(docs, bench(spark))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 7, 8}


def test_odd_documents(spark, odd_docs, no_docs):
    assert T.leaks(odd_docs, bench(spark)).count() == 0
    assert T.without_leaks(odd_docs, bench(spark)).count() == 9
    assert T.leaks(no_docs, bench(spark)).count() == 0 and T.leaks(odd_docs, bench(spark).limit(0)).count() == 0
    own = odd_docs.where("text IS NOT NULL").select(F.col("doc_id").alias("item_id"), "text")
    got = {(r.doc_id, r.item_id) for r in T.leaks(odd_docs, own).collect()}
    assert got == {(1, 1), (1, 6), (6, 1), (6, 6), (5, 5), (None, None)}


def test_every_item_is_found_where_it_stands(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in T.op2(spark, sf_dir).collect()}
    docs = [(r.doc_id, r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text.lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {(d, i) for d, t in docs for i, q in items if q in t} <= got
    assert got <= {(d, i) for d, t in docs for i, q in items if " ".join(q.split()[:6]) in " ".join(t.split())}


def found(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items, 1)), "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(docs, 1)), "doc_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in T.leaks(docs, items).collect()}


def test_words_that_begin_sentences_may_be_names(spark):
    items = ["What is the capital of France?", "Tom buys 3 pens and 4 cups. Tom then sells 2 of them."]
    docs = [
        f"{prose(20)} Question: What is the capital of France? {prose(20)}",
        f"{prose(20)}, What is the capital of France? {prose(20)}",
        f"{prose(20)}. Sam buys 3 pens and 4 cups. Sam then sells 2 of them. {prose(20)}",
        f"{prose(20)} Tom buys 3 pens and 4 cups. Tom then sells 2 of them. {prose(20)}",
        f"{prose(20)}. What was the anthem of France? {prose(20)}",
    ]
    got = found(spark, items, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2)}
    assert got[1, 1].n_changed == got[2, 1].n_changed == got[4, 2].n_changed == 0 < got[3, 2].n_changed


def test_a_copy_is_not_outvoted_by_variants(spark):
    item = "the farmer picks 5 apples and 5 pears for the market and sells 5 baskets there every day"
    variant = "the farmer picks {} apples and {} pears for the market and sells {} baskets there every day"
    variants = [variant.format(10 + k, 40 + k, 70 + k) for k in range(4)]
    many = " ".join([prose(30), *variants, prose(30, 2), item, prose(30, 3), *variants])
    close = " ".join([*variants, item, *variants])
    got = found(spark, [item], [many, close, " ".join(variants)])
    assert set(got) == {(1, 1), (2, 1)}
    assert {(r.coverage, r.n_changed, r.n_consistent == r.n_slots) for r in got.values()} == {(1.0, 0, True)}
