"""Secret scans whose false positives a random forest removes.

Candidates are long runs of key-like characters. Some have the form of a known secret or of something harmless; these
labelled findings train the forest. Its features are the length, the classes and transitions of the characters (against
transition counts of the whole corpus), the share of letters in dictionary words (words that the whole corpus has
often), path-like marks, and the neighbouring words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import (
    Hashes,
    count_rows,
    query,
    record_batch,
    summed_counts,
    table,
    texts,
    words,
    written,
)

RUN = re.compile(rb"(?<![A-Za-z0-9_+/.@~-])[A-Za-z0-9_+/.@~-]{12,}={0,2}")
TURN = re.compile(rb"[a-z][A-Z]")
# Published forms of keys, and of values that are none.
KEY_FORMS = re.compile(
    rb"AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36,}$|xox[abpr]-[A-Za-z0-9-]{10,}$|AIza[A-Za-z0-9_-]{35}$"
    rb"|sk_live_[A-Za-z0-9]{16,}$|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+"
)
ASSIGNED = re.compile(rb"(?i)(password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s*[=:]\s*[\"']?$")
HARMLESS = re.compile(
    rb"[\w.+-]+@[\w-]+(\.[\w-]+)+$|\+?[0-9][0-9.-]*$|(www\.)?([a-z][a-z-]*\.)+[a-z]{2,}(/[\w./-]*)?$"
    rb"|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|/?([A-Za-z]+/)+[A-Za-z.]+$"
)
KEYWORDS = re.compile(rb"(?i)pass|pwd|token|secret|key|auth|credential")
#: At most so many labelled findings of each class are learned from: those with the smallest hashes.
SAMPLE_PER_CLASS = 4_000
TREES = 40
DEPTH = 8
BINS = 32
THRESHOLD = 0.5
REDACTED = b"[SECRET]"
#: Counters: transitions between 64 kinds of bytes, then words by hash. Their number is fixed.
KINDS = 64
WORD_SLOTS = 1 << 18
CHUNK = 4_096
BEFORE = 64
AFTER = 48
NEIGHBOUR_BUCKETS = 8


class Candidate(NamedTuple):
    start: int
    value: bytes
    before: bytes
    after: bytes


def _kinds() -> np.ndarray:
    """Letters and digits are kinds of their own; other ASCII bytes and all others are one each."""
    out = np.zeros(256, np.int64)
    own = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    out[:128] = 62
    out[128:] = 63
    for k, byte in enumerate(own):
        out[byte] = k
    return out


KIND = _kinds()


def _likely(run: bytes) -> bool:
    if any(48 <= b < 58 for b in run) or KEY_FORMS.match(run):
        return True
    return len(run) >= 20 and TURN.search(run) is not None


def candidates(text: bytes, text_words: list[bytes]) -> list[Candidate]:
    """Runs of at least 12 key-like characters that hold a digit or have a known form, or of 20 in mixed case."""
    if not any(len(w) > 11 and not (w.isalpha() and w.islower()) and RUN.search(w) for w in text_words):
        return []
    return [
        Candidate(m.start(), m[0], text[max(0, m.start() - BEFORE) : m.start()], text[m.end() : m.end() + AFTER])
        for m in RUN.finditer(text)
        if _likely(m[0])
    ]


def rule_label(c: Candidate) -> int | None:
    """1 for the form of a secret, 0 for a harmless form, None where no rule speaks."""
    if KEY_FORMS.match(c.value):
        return 1
    if HARMLESS.match(c.value):
        return 0
    if ASSIGNED.search(c.before):
        return 1
    return None


class Corpus(NamedTuple):
    """What the features know of the whole corpus: log probabilities of transitions, and how often words occur."""

    transitions: np.ndarray
    word_slots: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Corpus:
        counts = np.resize(counts, KINDS * KINDS + WORD_SLOTS) if len(counts) else np.zeros(KINDS * KINDS + WORD_SLOTS)
        pairs = counts[: KINDS * KINDS].reshape(KINDS, KINDS) + 1.0
        slots = counts[KINDS * KINDS :]
        # A slot above the mean load by far holds a frequent word.
        common = slots > 4 * slots.mean() + 8
        return cls(np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32), common)


def slot(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) % WORD_SLOTS


def features(c: Candidate, corpus: Corpus) -> list[float]:
    data = np.frombuffer(c.value, np.uint8)
    n = len(data)
    kind = KIND[data]
    group = np.select([kind < 26, kind < 52, kind < 62], [0, 1, 2], 3)
    shares = np.bincount(group, minlength=4) / n
    histogram = np.bincount(data)
    p = histogram[histogram > 0] / n
    steps = corpus.transitions[kind[:-1], kind[1:]]
    runs = re.findall(rb"[a-z]{3,}", c.value.lower())
    known = sum(len(r) for r in runs if corpus.word_slots[slot(r)])
    prior, later = c.before.split()[-3:], c.after.split()[:2]
    near = [0.0] * (2 * NEIGHBOUR_BUCKETS)
    for place, found in ((0, prior[-1:]), (NEIGHBOUR_BUCKETS, later[:1])):
        for word in found:
            near[place + slot(word.lower()) % NEIGHBOUR_BUCKETS] = 1.0
    return [
        float(n),
        *shares.tolist(),
        float((group[1:] != group[:-1]).mean()) if n > 1 else 0.0,
        float(-(p * np.log2(p)).sum()),
        float(steps.mean()) if n > 1 else 0.0,
        float(steps.min()) if n > 1 else 0.0,
        max((len(r) for r in runs), default=0) / n,
        known / n,
        float(c.value.count(b"/")),
        float(c.value.count(b".")),
        float(b"@" in c.value),
        float(c.before[-1:] in (b'"', b"'")),
        float(c.before.rstrip(b"\"' ")[-1:] in (b"=", b":")),
        float(any(KEYWORDS.search(w) for w in prior)),
        float(any(KEYWORDS.search(w) for w in later)),
        *near,
    ]


class Forest:
    """Trees on bootstrap samples, each split chosen by Gini impurity among a random part of the features."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, seed: int = 11):
        self.depth = depth
        self.default = float(labels.mean()) if len(labels) else 0.0
        self.edges = [np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1])) for x in rows.T] if len(rows) else []
        self.trees: list[np.ndarray] = []
        if len(np.unique(labels)) < 2:
            return
        binned = self._binned(rows)
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            chosen = rng.integers(0, len(rows), len(rows))
            self.trees.append(self._grow(binned[chosen], labels[chosen], rng))

    def _binned(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, side="left") for e, x in zip(self.edges, rows.T, strict=True)], axis=1)

    def _grow(self, rows: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Nodes as rows (feature or -1, bin, left, right, share of 1)."""
        nodes: list[list[float]] = []
        todo = [(np.arange(len(rows)), 0, -1, 0)]
        tried = max(1, int(np.sqrt(rows.shape[1])) + 1)
        while todo:
            at, level, parent, side = todo.pop()
            here, y = len(nodes), labels[at]
            if parent >= 0:
                nodes[parent][2 + side] = here
            nodes.append([-1, 0, 0, 0, float(y.mean())])
            if level == self.depth or len(at) < 4 or y.min() == y.max():
                continue
            best = (np.inf, -1, 0)
            for f in rng.choice(rows.shape[1], tried, replace=False):
                x = rows[at, f]
                total = np.bincount(x, minlength=BINS).astype(float)
                ones = np.bincount(x, weights=y, minlength=BINS)
                n_left, o_left = total.cumsum()[:-1], ones.cumsum()[:-1]
                n_right, o_right = len(at) - n_left, ones.sum() - o_left
                ok = (n_left > 0) & (n_right > 0)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost = o_left * (1 - o_left / n_left) + o_right * (1 - o_right / n_right)
                cost[~ok] = np.inf
                k = int(cost.argmin())
                if cost[k] < best[0]:
                    best = (cost[k], int(f), k)
            if best[1] < 0:
                continue
            nodes[here][:2] = best[1:]
            left = rows[at, best[1]] <= best[2]
            todo += [(at[left], level + 1, here, 0), (at[~left], level + 1, here, 1)]
        return np.array(nodes)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """The mean share of 1 in the leaves that the rows reach."""
        if not self.trees or not len(rows):
            return np.full(len(rows), self.default)
        binned = self._binned(rows)
        total = np.zeros(len(rows))
        for tree in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                feature = tree[at, 0].astype(np.int64)
                inner = feature >= 0
                left = binned[np.arange(len(rows)), np.maximum(feature, 0)] <= tree[at, 1]
                at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
            total += tree[at, 4]
        return total / len(self.trees)


class Model(NamedTuple):
    corpus: Corpus
    forest: Forest

    def scores(self, found: list[Candidate]) -> list[float]:
        if not found:
            return []
        return self.forest.scores(np.array([features(c, self.corpus) for c in found])).tolist()


def survey(docs: DataFrame) -> DataFrame:
    """One pass over all whole texts: the counters of each task, and all findings that a rule can label."""
    ddl = "part int, counts binary, label int, hash bigint, value binary, before binary, after binary"
    schema = pa.schema(
        [("part", pa.int32()), ("counts", pa.binary()), ("label", pa.int32()), ("hash", pa.int64())]
        + [(x, pa.binary()) for x in ("value", "before", "after")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(KINDS * KINDS, np.int64)
        slots = np.zeros(WORD_SLOTS, np.int64)
        hashes = Hashes()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                kind = KIND[np.frombuffer(text, np.uint8)]
                pairs += np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
                text_words = words(text)
                at = hashes.array(words(text.lower())) % np.uint64(WORD_SLOTS)
                np.add.at(slots, at.astype(np.int64), 1)
                for c in candidates(text, text_words):
                    label = rule_label(c)
                    if label is not None:
                        order = xxhash.xxh3_64_intdigest(c.value + b"\0" + c.before) >> 1
                        rows.append((label, order, c.value, c.before, c.after))
            if rows:
                label, order, value, before, after = map(list, zip(*rows, strict=True))
                empty: list = [None] * len(rows)
                columns = {"part": empty, "counts": empty, "label": label, "hash": order}
                yield record_batch(schema, columns | {"value": value, "before": before, "after": after})
        counted = count_rows(np.concatenate([pairs, slots]), CHUNK)
        empty = [None] * len(counted["part"])
        yield record_batch(schema, counted | dict.fromkeys(("label", "hash", "value", "before", "after"), empty))

    return texts(docs).mapInArrow(run, ddl)


def train(docs: DataFrame, *, per_class: int = SAMPLE_PER_CLASS, seed: int = 11) -> Model:
    """Counts over all documents, and a forest from at most ``per_class`` labelled findings of each class."""
    found = written(survey(docs))
    corpus = Corpus.of(summed_counts(found.where("part IS NOT NULL"), chunk=CHUNK))
    rows = []
    for label in (0, 1):
        chosen = found.where(F.col("label") == label).orderBy("hash", "value", "before", "after").limit(per_class)
        rows += chosen.select("label", "value", "before", "after").collect()
    labelled = [(Candidate(0, bytes(r.value), bytes(r.before), bytes(r.after)), r.label) for r in rows]
    x = np.array([features(c, corpus) for c, _ in labelled]) if labelled else np.zeros((0, 1))
    return Model(corpus, Forest(x, np.array([y for _, y in labelled], float), seed=seed))


def secret_findings(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, start, length, value_sha256, score, secret) for every candidate in every whole text.

    ``start`` and ``length`` count code points; ``secret`` is false for what the forest takes for a false positive. A
    null or empty text has no candidate. Rows are scanned one by one: repeated rows give repeated findings, a null id
    stays null, an empty table gives no rows, and columns other than doc_id and text are not read.
    """
    ddl = "doc_id bigint, start bigint, length bigint, value_sha256 string, score double, secret boolean"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("value_sha256", pa.string())]
            + [("score", pa.float64()), ("secret", pa.bool_())]
        )
        for batch in batches:
            found: list[tuple[int | None, int, Candidate]] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c in candidates(text, words(text)):
                    found.append((doc_id, len(text[: c.start].decode("utf-8", "replace")), c))
            scores = shared.value.scores([c for _, _, c in found])
            columns = {
                "doc_id": [d for d, _, _ in found],
                "start": [s for _, s, _ in found],
                "length": [len(c.value) for _, _, c in found],
                "value_sha256": [hashlib.sha256(c.value).hexdigest() for _, _, c in found],
                "score": scores,
                "secret": [s >= THRESHOLD for s in scores],
            }
            yield record_batch(schema, columns)

    return texts(docs).mapInArrow(run, ddl)


def redacted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, with each secret in ``text`` replaced by a mark and ``n_chars``, where there is
    such a column, counted again for texts that change. Null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            found = [(k, c) for k, t in enumerate(old) if t for c in candidates(t, words(t))]
            scores = shared.value.scores([c for _, c in found])
            spans: dict[int, list[Candidate]] = {}
            for (k, c), score in zip(found, scores, strict=True):
                if score >= THRESHOLD:
                    spans.setdefault(k, []).append(c)
            new = list(old)
            for k, cs in spans.items():
                out, at = [], 0
                for c in cs:
                    out += [old[k][at : c.start], REDACTED]
                    at = c.start + len(c.value)
                new[k] = b"".join(out) + old[k][at:]
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["text"] = [None if t is None else t.decode("utf-8", "replace") for t in new]
            if "n_chars" in columns and spans:
                counts = columns["n_chars"].to_pylist()
                for k in spans:
                    counts[k] = len(columns["text"][k])
                columns["n_chars"] = counts
            yield record_batch(batch.schema, columns)

    return docs.mapInArrow(run, schema)


@query("op7_secret_forest")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_findings(docs, train(docs))
