"""A byte-level convolutional network that tells good texts from bad ones, in numpy.

Each byte of the whole text is a symbol: its value, and whether the bytes from it on repeat what stood a few bytes
before. Symbols have learned vectors; learned filters of eight bytes slide over them in steps of four; chunks of 512
bytes, each overlapping the next by half, keep the maximum of each filter; a hidden layer reads every chunk; and the
mean and maximum of the hidden layer over all chunks give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import batches_of, query, record_batch, table, texts, train_part

STEP = 4
HALF = 256
DEPTH = 12
FILTERS = 16
HIDDEN = 12
#: Distances at which a repetition is looked for, and the lengths of agreement that count.
LAGS = range(2, 33)
RUNS = (4, 8)
SYMBOLS = 256 * (len(RUNS) + 1)
#: At most so many labelled rows of each class are learned from: those with the smallest hashes of their ids.
SAMPLE_PER_CLASS = 1_000
EPOCHS = 14
THRESHOLD = 0.3
HELD_OUT_PARTS = 5
#: Bytes that are scored together.
BATCH_BYTES = 1 << 20

Params = dict[str, np.ndarray]


def symbols(text: bytes) -> np.ndarray:
    """One symbol per byte, zeros behind the text up to a whole number of half chunks."""
    n = len(text)
    out = np.zeros((n // HALF + 1) * HALF, np.int16)
    data = np.frombuffer(text, np.uint8)
    level = np.zeros(n, np.int16)
    for lag in LAGS:
        if n < lag + RUNS[0]:
            break
        agree = data[lag:] == data[:-lag]
        length = 1
        for k, run in enumerate(RUNS):
            while length < run:
                if len(agree) <= length:
                    agree = agree[:0]
                    break
                agree = agree[:-length] & agree[length:]
                length *= 2
            level[lag : lag + len(agree)][agree] = np.maximum(level[lag : lag + len(agree)][agree], k + 1)
    out[:n] = data + 256 * level
    return out


def new_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)

    def random(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "vectors": random(SYMBOLS, DEPTH, scale=0.5),
        "near": random(STEP * DEPTH, FILTERS, scale=0.1),
        "far": random(STEP * DEPTH, FILTERS, scale=0.1),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": random(FILTERS, HIDDEN, scale=0.35),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": random(2 * HIDDEN, scale=0.2),
        "out_bias": np.zeros(1, np.float32),
    }


def forward(params: Params, docs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """All layers for the symbols of some documents."""
    halves = np.array([len(d) // HALF for d in docs])
    last = np.cumsum(halves) - 1
    first = last - halves + 1
    symbol = np.concatenate(docs)
    blocks = params["vectors"][symbol].reshape(-1, STEP * DEPTH)
    response = blocks @ params["near"]
    response[:-1] += blocks[1:] @ params["far"]
    ends = (last + 1) * (HALF // STEP) - 1
    response[ends] = blocks[ends] @ params["near"]
    response = np.maximum(response + params["filter_bias"], 0).reshape(-1, HALF // STEP, FILTERS)
    half = response.max(axis=1)
    chunk = half.copy()
    inner = np.ones(len(half), bool)
    inner[last] = False
    inner = np.flatnonzero(inner)
    chunk[inner] = np.maximum(half[inner], half[inner + 1])
    hidden = np.maximum(chunk @ params["hidden"] + params["hidden_bias"], 0)
    mean = np.add.reduceat(hidden, first, axis=0) / halves[:, None].astype(np.float32)
    top = np.maximum.reduceat(hidden, first, axis=0)
    logit = np.concatenate([mean, top], axis=1) @ params["out"] + params["out_bias"]
    score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    names = ("symbol", "blocks", "response", "half", "chunk", "inner", "hidden", "mean", "top", "halves", "first")
    kept = (symbol, blocks, response, half, chunk, inner, hidden, mean, top, halves, first)
    return {"score": score, **dict(zip(names, kept, strict=True))}


def gradients(params: Params, docs: list[np.ndarray], labels: np.ndarray) -> Params:
    """Gradients of the mean log loss."""
    f = forward(params, docs)
    error = ((f["score"] - labels) / len(docs)).astype(np.float32)
    grads = {"out": np.concatenate([f["mean"], f["top"]], axis=1).T @ error, "out_bias": error.sum(keepdims=True)}
    back = error[:, None] * params["out"][None, :]
    owner = np.repeat(np.arange(len(docs)), f["halves"])
    d_hidden = (back[:, :HIDDEN] / f["halves"][:, None].astype(np.float32))[owner]
    best = f["hidden"] == f["top"][owner]
    d_hidden = d_hidden + back[owner, HIDDEN:] * best / np.maximum(np.add.reduceat(best, f["first"], axis=0)[owner], 1)
    d_hidden = (d_hidden * (f["hidden"] > 0)).astype(np.float32)
    grads["hidden"] = f["chunk"].T @ d_hidden
    grads["hidden_bias"] = d_hidden.sum(axis=0)
    d_chunk = d_hidden @ params["hidden"].T
    d_half = np.zeros_like(d_chunk)
    inner = f["inner"]
    own = f["half"] >= f["chunk"]
    d_half += d_chunk * own
    d_half[inner + 1] += (d_chunk * ~own)[inner]
    d_half *= f["half"] > 0
    # Only the strongest position of a filter in a half chunk has a gradient.
    at = f["response"].argmax(axis=1) + np.arange(len(d_half))[:, None] * (HALF // STEP)
    grads["filter_bias"] = d_half.sum(axis=0)
    blocks, symbol = f["blocks"], f["symbol"].reshape(-1, STEP)
    document_end = np.zeros(len(blocks), bool)
    document_end[(f["first"] + f["halves"]) * (HALF // STEP) - 1] = True
    grads["near"], grads["far"] = np.zeros_like(params["near"]), np.zeros_like(params["far"])
    grads["vectors"] = np.zeros_like(params["vectors"])
    for name, shift in (("near", 0), ("far", 1)):
        for k in range(FILTERS):
            rows, weight = at[:, k] + shift, d_half[:, k]
            use = (weight != 0) & (rows < len(blocks))
            if shift:
                use &= ~document_end[at[:, k]]
            rows, weight = rows[use], weight[use]
            grads[name][:, k] = weight @ blocks[rows]
            part = params[name][:, k].reshape(STEP, DEPTH)
            for w in range(STEP):
                mass = np.bincount(symbol[rows, w], weights=weight, minlength=SYMBOLS).astype(np.float32)
                grads["vectors"] += mass[:, None] * part[w]
    return grads


def fit(samples: list[tuple[bytes, int]], *, epochs: int = EPOCHS, seed: int = 7) -> Params:
    """Adam over shuffled batches of whole documents; classes count alike. One class alone gives its constant score."""
    params = new_params(seed)
    labels = np.array([y for _, y in samples], np.float32)
    if len(set(labels.tolist())) < 2:
        params["out"][:] = 0
        params["out_bias"][:] = 0 if not len(labels) else (6 if labels[0] else -6)
        return params
    docs = [symbols(t) for t, _ in samples]
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    bad, good = np.flatnonzero(labels == 0), np.flatnonzero(labels == 1)
    for epoch in range(epochs):
        size = max(len(bad), len(good))
        order = np.stack([np.resize(rng.permutation(bad), size), np.resize(rng.permutation(good), size)], 1).ravel()
        rate = 4e-3 * (1 - epoch / epochs) + 2e-4
        for some in batches_of(order.tolist(), lambda i: len(docs[i]), 1 << 17):
            grads = gradients(params, [docs[i] for i in some], labels[some])
            step += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
                params[name] = (params[name] - rate * move).astype(np.float32)
    return params


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = SAMPLE_PER_CLASS) -> Params:
    """Learns from at most ``per_class`` labelled documents of each class, whole texts; the rest of the labels is not
    needed. Rows without a label or a document are left out; a document with both labels counts as both."""
    known = labels.where("quality IN (0, 1)").select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality").distinct()
    known = known.where(train_part(F.col("doc_id"), HELD_OUT_PARTS) != 0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(per_class)
    chosen = chosen.unionByName(known.where("quality = 1").orderBy(*order).limit(per_class))
    found = texts(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "quality"])
    rows = found.select("doc_id", "text", "quality").collect()
    return fit([(bytes(r.text), r.quality) for r in sorted(rows, key=lambda r: (r.doc_id, r.quality))])


def scored(docs: DataFrame, params: Params) -> DataFrame:
    """Rows (doc_id, score) for each document, 0 to 1.

    A null or empty text is scored as one of zero bytes. Rows are scored one by one: repeated rows give repeated rows, a
    null id stays null, an empty table gives no rows, and columns other than doc_id and text are not read. A task holds
    one Arrow batch and the layers of about 1 MB of text, or of one longer text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            scores: list[np.ndarray] = []
            for some in batches_of(batch.column("text").to_pylist(), len, BATCH_BYTES):
                scores.append(forward(shared.value, [symbols(t) for t in some])["score"])
            columns = {"doc_id": batch.column("doc_id"), "score": np.concatenate(scores) if scores else []}
            yield record_batch(schema, columns)

    return texts(docs).mapInArrow(run, "doc_id bigint, score double")


@query("op10_byte_cnn")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    params = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, params).select(
        "doc_id",
        (train_part(F.col("doc_id"), HELD_OUT_PARTS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
