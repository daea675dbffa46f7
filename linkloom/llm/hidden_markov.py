"""A hidden Markov language model over whole texts.

Latent states emit word classes (hashes of words into a fixed number of classes, the end of a text being one of its
own), and a class emits its words by their smoothed counts. Expected counts of starts, moves and emissions are computed
in every partition and summed, round after round, over all training texts (Baum-Welch); then the scaled forward
recursion gives the exact likelihood of each whole text. Word counts of the whole corpus meet the texts in blocks, so
that no task and no broadcast holds the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import (
    Hashes,
    batches_of,
    count_rows,
    lower,
    query,
    record_batch,
    summed_counts,
    table,
    texts,
    train_part,
    words,
    written,
)

STATES = 8
CLASSES = 1 << 14
END = CLASSES
#: Words that no training text has are one class, as they are one word to the base model.
UNSEEN = CLASSES + 1
KINDS = CLASSES + 2
PARTS, HELD_OUT = 7, 2
#: Rounds over all training texts go on until one raises their log likelihood by less than this share.
SETTLED = 5e-4
#: The states start from the counts of the whole corpus, each class's times e to the power of so much normal noise.
NOISE = 0.5
#: Every state has so many words of the overall mix besides its own.
PRIOR_WORDS = 20_000
#: Training runs over stretches of so many words; a stretch inside a text starts in the long-run mix of states.
STRETCH = 512
#: Forward shares are brought back to a sum of 1 every so many words; what a few words come to is far from the least
#: double.
RESCALE = 8
BATCH_TOKENS = 400_000
BLOCK_BYTES = 12 << 20
#: Expected counts are summed as whole numbers of this fraction, so that the sum does not depend on its order.
UNIT = 1 << 20
CHUNK = 4_096


class Hmm(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def long_run(self) -> np.ndarray:
        mix = np.full(len(self.start), 1 / len(self.start))
        for _ in range(50):
            mix = mix @ self.move
        return mix


def token_classes(text: bytes, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words, and its classes with the end."""
    found = hashes.array(words(lower(text)))
    return found, np.append((found % np.uint64(CLASSES)).astype(np.int32), np.int32(END))


def _by_time(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length, how many are longer than each time, and where each time begins if all are laid out
    time by time."""
    order = np.argsort(-lengths, kind="stable")
    top = int(lengths.max(initial=0))
    active = np.searchsorted(-lengths[order], -np.arange(top), side="left")
    return order, active, np.r_[0, np.cumsum(active)]


def _rescaled(alpha: np.ndarray) -> np.ndarray:
    """Divides every row by its sum, in place, and gives the sums."""
    scale = alpha @ np.ones(alpha.shape[1])
    alpha *= (1 / scale)[:, None]
    return scale


def forward(model: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log probability of each class sequence, exact over its whole length."""
    order, active, _ = _by_time(starts, lengths)
    begin = starts[order]
    emit = np.ascontiguousarray(model.emit.T)
    total = np.zeros(len(order))
    alpha = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t, n in enumerate(active.tolist()):
        if t:
            # Sequences that have ended add what has come together since they were rescaled last.
            total[n : len(alpha)] += np.log(alpha[n:] @ np.ones(alpha.shape[1]))
            alpha = alpha[:n] @ model.move
        alpha = alpha * emit[classes[begin[:n] + t]]
        if t % RESCALE == RESCALE - 1:
            total[:n] += np.log(_rescaled(alpha))
    total[: len(alpha)] += np.log(alpha @ np.ones(alpha.shape[1]))
    out = np.zeros(len(order))
    out[order] = total
    return out


def expected(model: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> Hmm:
    """Expected counts of starts (of sequences that begin a text), moves and emissions."""
    return expected_and_likelihood(model, classes, starts, lengths, first)[0]


def expected_and_likelihood(
    model: Hmm, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray
) -> tuple[Hmm, float]:
    """Expected counts, and the natural log likelihood of the sequences under the model."""
    order, active, offset = _by_time(starts, lengths)
    begin = starts[order]
    states = len(model.start)
    ones = np.ones(states)
    laid = np.concatenate([classes[begin[:n] + t] for t, n in enumerate(active.tolist())])
    # Emissions first; on the way back each row is multiplied by what follows it.
    ahead = np.ascontiguousarray(model.emit.T)[laid]
    alpha = np.empty((len(laid), states))
    scales = {}
    likelihood = 0.0
    for t, n in enumerate(active.tolist()):
        a, b = offset[t], offset[t + 1]
        now = alpha[a:b]
        if t == 0:
            now[:] = np.where(first[order][:, None], model.start, model.long_run())
        else:
            np.matmul(alpha[offset[t - 1] : offset[t - 1] + n], model.move, out=now)
        now *= ahead[a:b]
        if t % RESCALE == RESCALE - 1:
            scales[t] = _rescaled(now)
            likelihood += float(np.log(scales[t]).sum())
    ends = alpha[offset[lengths[order] - 1] + np.arange(len(order))] @ ones
    likelihood += float(np.log(ends).sum())
    moves = np.zeros((states, states))
    back = np.ascontiguousarray(model.move.T)
    beta = np.ones((0, states))
    for t in range(len(active) - 1, -1, -1):
        a, b = offset[t], offset[t + 1]
        going = len(beta)
        here = np.empty((b - a, states))
        here[going:] = (1 / ends[going : b - a])[:, None]
        if going:
            after = ahead[b : b + going]
            after *= beta
            if t + 1 in scales:
                after *= (1 / scales[t + 1])[:, None]
            np.matmul(after, back, out=here[:going])
            moves += alpha[a : a + going].T @ after
        beta = here
        alpha[a:b] *= here
    begun = alpha[: offset[1]][first[order]].sum(axis=0)
    emits = np.stack([np.bincount(laid, weights=alpha[:, k], minlength=KINDS) for k in range(states)])
    return Hmm(begun, moves * model.move, emits), likelihood


def from_counts(counts: Hmm) -> Hmm:
    """The model whose probabilities are the counts' shares; small constants keep every event possible."""
    share = counts.emit.sum(axis=0) + 1
    emit = counts.emit + 1e-3 * (counts.emit.sum(axis=1, keepdims=True) + 1) * (share / share.sum())
    move = counts.move + 1e-2
    start = counts.start + 1e-2
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _stretches(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All sequences end to end, cut into stretches: classes, starts, lengths, and which stretches begin a text."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    begins = np.cumsum(sizes) - sizes
    pieces = -(-sizes // STRETCH)
    which = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = begins[which] + nth * STRETCH
    lengths = np.minimum(STRETCH, sizes[which] - nth * STRETCH)
    return np.concatenate(sequences), starts, lengths, nth == 0


def first_model(tokens: np.ndarray, states: int, seed: int = 3) -> Hmm:
    """States that start from the class counts of all training texts, each with noise of its own."""
    rng = np.random.default_rng(seed)
    emit = (tokens + 0.1) * np.exp(NOISE * rng.standard_normal((states, KINDS)))
    return Hmm(
        np.full(states, 1 / states), 0.9 * np.eye(states) + 0.1 / states, emit / emit.sum(axis=1, keepdims=True)
    )


def class_rows(docs: DataFrame) -> DataFrame:
    """(classes): for each text its classes with the end, as 16-bit numbers, so that rounds need not split texts again."""
    schema = pa.schema([("classes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            found = (token_classes(t, hashes)[1].astype("<u2").tobytes() for t in batch.column("text").to_pylist())
            for some in batches_of(found, len, 2 * BATCH_TOKENS):
                yield record_batch(schema, {"classes": some})

    return docs.select("text").mapInArrow(run, "classes binary")


def trained_round(rows: DataFrame, model: Hmm) -> tuple[Hmm, float]:
    """Expected counts and log likelihood of one round, summed over all partitions of ``class_rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)
    size = states * (1 + states + KINDS) + 1
    room = -(-size // CHUNK) * CHUNK
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(room)
        for batch in batches:
            sequences = (np.frombuffer(x, "<u2").astype(np.int32) for x in batch.column("classes").to_pylist())
            for some in batches_of(sequences, len, BATCH_TOKENS):
                counts, likelihood = expected_and_likelihood(shared.value, *_stretches(some))
                total[:size] += np.concatenate([counts.start, counts.move.ravel(), counts.emit.ravel(), [likelihood]])
        yield record_batch(schema, count_rows(np.rint(total * UNIT).astype(np.int64), CHUNK))

    total = summed_counts(rows.mapInArrow(run, "part int, counts binary"), chunk=CHUNK)
    shared.destroy()
    total = (total if len(total) else np.zeros(room, np.int64))[:size] / UNIT
    a, b = states, states + states * states
    found = Hmm(total[:a], total[a:b].reshape(states, states), total[b:-1].reshape(states, KINDS))
    return found, float(total[-1])


def trained(rows: DataFrame, tokens: np.ndarray, states: int, rounds: int | None = None) -> Hmm:
    """Expected counts of the last round. Every round sees all rows of ``class_rows``; without ``rounds`` they go on
    until the likelihood settles, which it must, as no likelihood is above 1."""
    model, last = first_model(tokens, states), -np.inf
    done = 0
    while True:
        counts, now = trained_round(rows, model)
        done += 1
        if done == rounds or rounds is None and now - last <= SETTLED * abs(now):
            return counts
        model, last = from_counts(counts), now


class Counts(NamedTuple):
    """What the classes' words come to: tokens and distinct words per class, the end included."""

    tokens: np.ndarray
    distinct: np.ndarray

    @property
    def n(self) -> int:
        return int(self.tokens.sum())

    @property
    def v(self) -> int:
        return int(self.distinct.sum())

    def room(self) -> np.ndarray:
        """What the add-one smoothed counts of a class sum to; the class of unseen words has one."""
        out = self.tokens + self.distinct.astype(float)
        out[UNSEEN] = 1
        return out


def finished(counts: Hmm, words_of: Counts) -> Hmm:
    """The final model: emissions get the weight that smoothing adds to their class, so that classes of rare words are as
    likely as their words, and unseen words have their share in every state."""
    model = from_counts(counts)
    room = words_of.room()
    seen = np.where(words_of.tokens > 0, room / np.maximum(words_of.tokens, 1), 0)
    emit = counts.emit * seen + PRIOR_WORDS * room / room.sum()
    emit[:, UNSEEN] = emit.sum(axis=1) / room.sum()
    return model._replace(emit=emit / emit.sum(axis=1, keepdims=True))


def _numbered(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of several texts, and for each word of theirs the place of its hash."""
    flat = pa.array(np.concatenate(found)).dictionary_encode()
    return flat.dictionary.to_numpy(), flat.indices.to_numpy()


def in_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_id, text, train): texts dealt into blocks of about 12 MB by a hash of id and text."""
    rows = texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    return rows.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"),
        "doc_id",
        "text",
        (train_part(F.col("doc_id"), PARTS) != HELD_OUT).alias("train"),
    )


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, hash, c): the distinct words of each block, and how often its training texts have them."""
    schema = pa.schema([("block", pa.int64()), ("hash", pa.int64()), ("c", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        hashes = Hashes()
        found, weights = [], []
        for text, train in zip(group.column("text").to_pylist(), group.column("train").to_pylist(), strict=True):
            some = hashes.array(words(lower(text)))
            found.append(some)
            weights.append(np.full(len(some), train, np.int8))
        distinct, place = _numbered(found)
        counts = np.bincount(place, weights=np.concatenate(weights), minlength=len(distinct)).astype(np.int64)
        block = group.column("block")[0].as_py()
        return pa.table([np.full(len(distinct), block, np.int64), distinct.view(np.int64), counts], schema=schema)

    return blocks.groupBy("block").applyInArrow(run, "block bigint, hash bigint, c bigint")


def scored(docs: DataFrame, *, states: int = STATES, rounds: int | None = None) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document.

    The model learns from all texts whose crc32 of the id, as text, modulo 7 is not 2. A null or empty text is its end
    alone. Rows are scored one by one: repeated rows count and are scored each, a null id counts as the empty id text,
    an empty table gives no rows, and columns other than doc_id and text are not read. Words are told apart by 64-bit
    hashes. A task holds one block of texts, or one longer text, and the distinct words of that block.
    """
    blocks = in_blocks(docs)
    local = written(block_words(blocks))
    total = local.groupBy("hash").agg(F.sum("c").alias("c"), F.min("block").alias("home"))
    vocabulary = local.select("block", "hash").join(total, "hash")
    vocabulary = written(vocabulary.select("block", "hash", "c", (F.col("block") == F.col("home")).alias("once")))
    # Each word's total is counted once, in its first block.
    kind = F.pmod("hash", F.lit(CLASSES))
    by_class = (
        vocabulary.where("once")
        .groupBy(kind.alias("class"))
        .agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("bigint")).alias("v"))
        .collect()
    )
    train_rows = blocks.where("train").select("doc_id", "text")
    n_train = train_rows.select("doc_id").count()
    tokens, distinct = np.zeros(KINDS, np.int64), np.zeros(KINDS, np.int64)
    for r in by_class:
        tokens[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    tokens[END], distinct[END] = n_train, int(n_train > 0)
    words_of = Counts(tokens, distinct)

    counts = trained(written(class_rows(train_rows)), tokens, states, rounds)
    model = finished(counts, words_of)
    shared = docs.sparkSession.sparkContext.broadcast((model, words_of))
    ddl = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double"
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_())]
        + [(x, pa.int64()) for x in ("n_tokens", "n_known", "train_tokens")]
        + [("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, words_of = shared.value
        if not left.num_rows:
            return schema.empty_table()
        known = right.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, known_counts = known[order], right.column("c").to_numpy()[order]
        hashes = Hashes()
        room = np.log10(np.maximum(words_of.room(), 1))
        whole = np.log10(words_of.n + words_of.v + 1)
        found = [hashes.array(words(lower(text))) for text in left.column("text").to_pylist()]
        distinct, place = _numbered(found)
        # The vocabulary has every word of the block.
        count_of = known_counts[np.searchsorted(known, distinct)]
        class_of = np.where(count_of > 0, (distinct % np.uint64(CLASSES)).astype(np.int32), np.int32(UNSEEN))
        ends = np.cumsum([len(f) for f in found])[:-1]
        sequences, rows = [], []
        for spots in np.split(place, ends):
            c = np.append(count_of[spots], words_of.tokens[END])
            classes = np.append(class_of[spots], np.int32(END if words_of.tokens[END] else UNSEEN))
            plain = np.log10(c + 1.0)
            sequences.append(classes)
            rows.append((len(c), int((c > 0).sum()), (plain - whole).sum(), (plain - room[classes]).sum()))
        lengths = np.array([len(s) for s in sequences], np.int64)
        likelihood = forward(model, np.concatenate(sequences), np.cumsum(lengths) - lengths, lengths) / np.log(10)
        n_tokens, n_known, base, inside = map(np.array, zip(*rows, strict=True))
        held_out = np.array(left.column("train").to_pylist()) == False  # noqa: E712
        columns = [
            left.column("doc_id"),
            pa.array(held_out),
            pa.array(n_tokens),
            pa.array(n_known),
            pa.array(np.full(len(rows), words_of.n, np.int64)),
            pa.array(base),
            pa.array(likelihood + inside),
        ]
        return pa.Table.from_arrays(columns, schema=schema)

    return blocks.groupBy("block").cogroup(vocabulary.select("block", "hash", "c").groupBy("block")).applyInArrow(run, ddl)


@query("op5_hidden_markov")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
