import itertools
import math
import zlib
from collections import Counter

import numpy as np

from linkloom.llm import hidden_markov as H


def small_model(states=3, seed=0):
    rng = np.random.default_rng(seed)
    shares = [rng.random(shape) for shape in ((states,), (states, states), (states, H.KINDS))]
    return H.Hmm(*(x / x.sum(axis=-1, keepdims=True) for x in shares))


def test_recursions_against_all_state_paths():
    model = small_model()
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, H.KINDS, n).astype(np.int32) for n in (1, 4, 2, 5)]
    lengths = np.array([len(s) for s in seqs])
    starts = np.cumsum(lengths) - lengths
    found = H.forward(model, np.concatenate(seqs), starts, lengths)
    counts = H.expected(model, np.concatenate(seqs), starts, lengths, np.ones(4, bool))
    want = H.Hmm(*(np.zeros_like(x) for x in model))
    for k, s in enumerate(seqs):
        paths = []
        for p in itertools.product(range(3), repeat=len(s)):
            prob = model.start[p[0]] * model.emit[p[0], s[0]]
            for a, b, o in zip(p, p[1:], s[1:], strict=False):
                prob *= model.move[a, b] * model.emit[b, o]
            paths.append((p, prob))
        total = sum(x for _, x in paths)
        assert abs(math.log(total) - found[k]) < 1e-9
        for p, prob in paths:
            want.start[p[0]] += prob / total
            for a, b in itertools.pairwise(p):
                want.move[a, b] += prob / total
            for a, o in zip(p, s, strict=True):
                want.emit[a, o] += prob / total
    assert all(np.allclose(a, b) for a, b in zip(counts, want, strict=True))


def plain_passes(model, classes):
    """Forward and backward over one sequence, rescaled at every word: expected counts and the log likelihood."""
    alpha, total = [], 0.0
    for t, o in enumerate(classes):
        now = (model.start if t == 0 else alpha[-1] @ model.move) * model.emit[:, o]
        total += math.log(now.sum())
        alpha.append(now / now.sum())
    beta = np.ones(len(model.start))
    move, emit = np.zeros_like(model.move), np.zeros_like(model.emit)
    for t in range(len(classes) - 1, -1, -1):
        share = alpha[t] * beta
        emit[:, classes[t]] += share / share.sum()
        if t:
            pairs = alpha[t - 1][:, None] * model.move * (model.emit[:, classes[t]] * beta)
            move += pairs / pairs.sum()
            beta = model.move @ (model.emit[:, classes[t]] * beta)
            beta /= beta.sum()
    return move, emit, total


def test_long_sequences_against_rescaling_at_every_word():
    model = small_model(4, seed=7)
    rng = np.random.default_rng(8)
    lengths = np.array([1, 7, 8, 9, 16, 17, 300, 300, 511])
    seqs = [rng.integers(0, H.KINDS, n).astype(np.int32) for n in lengths]
    flat, starts = np.concatenate(seqs), np.cumsum(lengths) - lengths
    want = [plain_passes(model, s) for s in seqs]
    assert np.allclose(H.forward(model, flat, starts, lengths), [w[2] for w in want], rtol=1e-10)
    counts, likelihood = H.expected_and_likelihood(model, flat, starts, lengths, np.ones(len(seqs), bool))
    assert np.allclose(counts.move, sum(w[0] for w in want)) and np.allclose(counts.emit, sum(w[1] for w in want))
    assert abs(likelihood - sum(w[2] for w in want)) < 1e-6


def test_a_round_does_not_lower_the_likelihood():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 6, 40).astype(np.int32) + 10 * (k % 2) for k in range(12)]
    sizes = np.array([len(s) for s in seqs])
    model, last = small_model(2), -np.inf
    for _ in range(20):
        now = H.forward(model, np.concatenate(seqs), np.cumsum(sizes) - sizes, sizes).sum()
        assert now >= last - 0.5
        last = now
        model = H.from_counts(H.expected(model, *H._stretches(seqs)))
    low, high = sorted(model.emit[:, :10].sum(axis=1).tolist())
    assert low < 0.1 and high > 0.9


def test_counts_base_and_gain(spark, sf_dir):
    rows = {r.doc_id: r for r in H.op5(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    train = Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), None])
    n, v = sum(train.values()), len(train)
    for i, t in docs.items():
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens)
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_documents(odd_docs, no_docs):
    rows = H.scored(odd_docs, rounds=1).collect()
    assert len(rows) == 9 and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert H.scored(no_docs, rounds=1).count() == 0


def test_states_of_a_rare_language_come_from_all_texts(spark):
    """1,800 texts in one language and 200 in another, whose training texts lie behind the first 600 by hash of id."""
    rng = np.random.default_rng(2)
    ids = spark.range(1, 6000).selectExpr("id", "xxhash64(id) AS h", "crc32(CAST(CAST(id AS STRING) AS BINARY)) % 7 AS p")
    rows = sorted((r.h, r.id, r.p) for r in ids.collect())
    train = [i for _, i, p in rows if p != 2]
    held = [i for _, i, p in rows if p == 2][:6]
    def text(stem):
        return " ".join(f"{stem}{x}" for x in rng.integers(0, 40, 200))
    docs = [(i, text("one")) for i in train[:1800]] + [(i, text("two")) for i in train[1800:2000]]
    docs += [(i, text("two")) for i in held]
    got = H.scored(spark.createDataFrame(docs, "doc_id bigint, text string")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got)
    assert len(got) == 6 and gain > 0.7, gain


def test_rounds_go_on_until_the_likelihood_settles(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = H.written(H.class_rows(H.texts(docs)))
    tokens = np.zeros(H.KINDS, np.int64)
    for r in rows.collect():
        tokens += np.bincount(np.frombuffer(r.classes, "<u2"), minlength=H.KINDS)
    counts = H.trained(rows, tokens, H.STATES)
    assert abs(counts.emit.sum() - tokens.sum()) < 1e-3 * tokens.sum()
    model = H.from_counts(counts)
    after, now = H.trained_round(rows, model)
    _, later = H.trained_round(rows, H.from_counts(after))
    assert later - now <= 2 * H.SETTLED * abs(later)
