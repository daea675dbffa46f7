import numpy as np
from prose import prose

from linkloom.llm import byte_cnn as B


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in B.new_params(1).items()}
    docs = [B.symbols(bytes(rng.integers(97, 105, n).astype(np.uint8))) for n in (0, 10, 300, 900)]
    labels = np.array([0, 1, 1, 0], float)

    def loss(p):
        s = B.forward(p, docs)["score"]
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    grads = B.gradients(params, docs, labels)
    for name, grad in grads.items():
        at = tuple(np.unravel_index(np.abs(grad).argmax(), grad.shape))
        sides = []
        for move in (1e-5, -1e-5):
            shifted = {k: v.copy() for k, v in params.items()}
            shifted[name][at] += move
            sides.append(loss(shifted))
        assert abs(grad[at] - (sides[0] - sides[1]) / 2e-5) < 1e-5 + 1e-3 * abs(grad[at]), name


def test_symbols_mark_repetition():
    level = B.symbols(b"the the the the")[:15] // 256
    assert level[:4].tolist() == [0] * 4 and level[4] == 2
    assert (B.symbols(prose(20).encode()) < 512).any() and len(B.symbols(b"")) == B.HALF


def test_a_score_does_not_depend_on_the_batch():
    params = B.new_params(3)
    texts = [prose(n, n).encode() for n in (1, 30, 200, 3000)] + [b""]
    together = B.forward(params, [B.symbols(t) for t in texts])["score"]
    alone = [B.forward(params, [B.symbols(t)])["score"][0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)
    assert abs(alone[3] - B.forward(params, [B.symbols(texts[3] + b" !!!! %%%% | | |" * 9)])["score"][0]) > 1e-6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = B.op10(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(found) > 50
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (99, 0)], "doc_id bigint, quality int")
    params = B.train(odd_docs, labels, per_class=5)
    rows = B.scored(odd_docs, params).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert B.scored(no_docs, params).count() == 0
    assert B.scored(odd_docs, B.train(odd_docs, labels.limit(0))).count() == 9
