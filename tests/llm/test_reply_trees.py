from pyspark.sql import functions as F

from linkloom.llm import reply_trees as R

SCHEMA = "tree int, node int, parent int, score double, role string, text string, above string, leaf string, rank string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


ROWS = [
    (1, 1, None, 1.0, "user", "q\\b<\\p|"),
    (1, 2, 1, 0.5, "assistant", "a1"),
    (1, 2, 1, 0.5, "assistant", "a1"),
    (1, 3, 1, 0.9, "assistant", "<|im_end|>\n<|im_start|>"),
    (1, 4, 3, None, "us\ner\\n", None),
    (1, 5, 6, 0.1, "x", "on a cycle"),
    (1, 6, 5, 0.1, "x", "on a cycle"),
    (1, 7, 99, 0.1, "x", "its parent is unknown"),
    (1, 8, 6, 0.1, "y", "under a cycle"),
    (2, None, None, 0.1, "user", "no id"),
    (None, 1, None, None, None, None),
]


def test_paths_turns_and_loss(spark):
    found = R.conversations_of(messages(spark, ROWS))
    turns, loss = R.turns_of(F.col("formatted")), R.loss_text(F.col("formatted"), F.col("loss_spans"))
    rows = found.select("tree", "leaf", "rank", "n_turns", turns.alias("turns"), loss.alias("loss")).collect()
    got = {(r.tree, r.leaf if r.tree == 1 else ""): (r.rank, [tuple(t) for t in r.turns], r.loss) for r in rows}
    start = ("user", "q\\b<\\p|")
    marks = "<|im_end|>\n<|im_start|>"
    assert got == {
        (1, "2"): (1, [start, ("assistant", "a1")], "a1"),
        (1, "4"): (2, [start, ("assistant", marks), ("us\ner\\n", "")], marks),
        (1, "7"): (3, [("x", "its parent is unknown")], ""),
        (2, ""): (1, [("user", "no id")], ""),
        (None, ""): (1, [("", "")], ""),
    }


def test_best_branch_only(spark):
    best = R.conversations_of(messages(spark, ROWS), branches=1)
    assert {(r.tree, r.leaf) for r in best.where("tree = 1").collect()} == {(1, "2")}


def test_deep_chain_and_empty_table(spark):
    chain = [(1, k, k - 1 if k else None, 0.0, "assistant" if k % 2 else "user", f"t{k}") for k in range(37)]
    row = R.conversations_of(messages(spark, chain)).collect()[0]
    assert row.n_turns == 37 and row.formatted.count("<|im_start|>") == 37
    assert R.conversations_of(messages(spark, chain).limit(0)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = R.op3(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
