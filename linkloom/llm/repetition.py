"""Quality rules by suffix arrays: how much of a text is repeated inside it, and how long the longest repeat is.

The suffix array is built over the word sequence of each whole text by prefix doubling. Its longest-common-prefix
values give, for every position, the longest substring starting there that occurs again; the intervals of suffixes
sharing such a prefix are the maximal repeated substrings, and the union of their spans is the covered part.
Many texts are sorted together; the text number leads every key, so suffixes of two texts never compare as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import batches_of, query, record_batch, slices, table, texts, words

SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 5
#: A repeat counts as such from this many words on.
MIN_WORDS = 8
#: More than this percentage of the words in repeats, or a longer repeat than this, and a text is rejected.
MAX_COVERED_PERCENT = 20
MAX_LONGEST = 60
#: Words sorted together.
SORTED_WORDS = 200_000

DDL = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_covered bigint, longest_repeat bigint, base_failed boolean, kept boolean"
)


def longest_repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position of texts laid end to end, the length of the longest substring of its text that starts there
    and also elsewhere in the same text.

    ids: a number per word, equal only for equal words of the same text. ends: for each position, the end of its text.
    """
    n = len(ids)
    out = np.zeros(n + 1, np.int64)
    if n < 2:
        return out[:n]
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, sizes)
    levels = [rank.astype(np.int32)]
    active = order[np.repeat(sizes > 1, sizes)]
    step = 1
    while len(active):
        # Positions in groups that share their first `step` words are ordered by the `step` words that follow.
        ahead = active + step
        inside = ahead < ends[active]
        follow = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        old = rank[active]
        key = old * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        active, key, old = active[order], key[order], old[order]
        place = np.arange(len(active))
        fresh = np.r_[True, key[1:] != key[:-1]]
        new_start = np.maximum.accumulate(np.where(fresh, place, 0))
        old_start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], place, 0))
        rank[active] = old + new_start - old_start
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.r_[starts, len(active)])
        active = active[np.repeat(sizes > 1, sizes)]
        step *= 2
        if len(active):
            levels.append(rank.astype(np.int32))
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    # Common prefix of neighbouring suffixes: equal ranks at a level mean equal stretches of that many words.
    left, right = suffixes[:-1], suffixes[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    i, j = left.copy(), right.copy()
    for depth in range(len(levels) - 1, -1, -1):
        ranks = levels[depth]
        equal = (i < n) & (j < n)
        equal[equal] = ranks[i[equal]] == ranks[j[equal]]
        i[equal] += 1 << depth
        j[equal] += 1 << depth
    common = i - left
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out[:n]


def covered(repeats: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words."""
    n = len(repeats)
    marks = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(repeats >= least)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + repeats[at], -1)
    return np.cumsum(marks)[:n] > 0


def repeat_spans(text_words: list, least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """The union of the spans (start, end in words) of all repeats of one word sequence."""
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in text_words], np.int64)
    inside = covered(longest_repeats(ids, np.full(len(ids), len(ids))), least)
    edges = np.flatnonzero(np.diff(np.r_[0, inside.astype(np.int8), 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _measure(rows: list, min_words: int, max_covered: int, max_longest: int) -> dict[str, list]:
    """Columns for (doc_id, text, words) rows that are sorted together."""
    counts = np.array([len(w) for _, _, w in rows], np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(x, len(numbers)) for _, _, w in rows for x in w), np.int64, int(counts.sum()))
    stops = np.cumsum(counts)
    owner = np.repeat(np.arange(len(rows)), counts)
    found = longest_repeats(ids + owner * len(numbers), np.repeat(stops, counts))
    repeat_words = np.bincount(owner[covered(found, BASE_WINDOW)], minlength=len(rows))
    n_covered = np.bincount(owner[covered(found, min_words)], minlength=len(rows))
    longest = np.zeros(len(rows), np.int64)
    np.maximum.at(longest, owner, found)
    base_failed = (counts < 10) | (100 * repeat_words > 20 * counts)
    kept = ~base_failed & (100 * n_covered <= max_covered * counts) & (longest <= max_longest)
    return {
        "doc_id": [d for d, _, _ in rows],
        "n_words": counts,
        "word_chars": [len(t.decode("utf-8", "replace")) - len(t) + sum(map(len, w)) for _, t, w in rows],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for _, t, _ in rows],
        "n_dup_lines": [_dup_lines(t) for _, t, _ in rows],
        "n_repeat_words": repeat_words,
        "n_covered": n_covered,
        "longest_repeat": longest,
        "base_failed": base_failed,
        "kept": kept,
    }


SCHEMA = pa.schema(
    [(name, {"bigint": pa.int64(), "boolean": pa.bool_()}[kind]) for name, kind in (x.split() for x in DDL.split(", "))]
)


def repetition(
    docs: DataFrame,
    *,
    min_words: int = MIN_WORDS,
    max_covered: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """One row per document: base counts, words covered by repeats of at least ``min_words`` words, the longest repeat
    in words, and the verdict.

    ``kept`` is false where the base rules fail (under 10 words, or over 20 % of the words in repeated 5-word windows),
    where repeats cover more than ``max_covered`` percent of the words, or where one is longer than ``max_longest``. A null or
    empty text has no words and fails. Rows are judged one by one: repeated rows give repeated rows, a null id stays
    null, an empty table gives no rows, and columns other than doc_id and text are not read. Texts are whole, of any
    length; a task holds one Arrow batch and the ranks of about 200,000 words (or of one longer text) at a time.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            ids = part.column("doc_id").to_pylist()
            rows = ((d, t, words(t)) for d, t in zip(ids, map(bytes, part.column("text").to_pylist()), strict=True))
            for some in batches_of(rows, lambda r: len(r[2]), SORTED_WORDS):
                yield record_batch(SCHEMA, _measure(some, min_words, max_covered, max_longest))

    return texts(docs).mapInArrow(run, DDL)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the quality rules keep; a null text is empty and goes. Rows are judged one
    by one, so of repeated rows all stay or none; an empty table stays empty."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            raw = [(x or "").encode() for x in part.column("text").to_pylist()]
            rows = ((k, t, words(t)) for k, t in enumerate(raw))
            keep: list[bool] = []
            for some in batches_of(rows, lambda r: len(r[2]), SORTED_WORDS):
                keep += _measure(some, MIN_WORDS, MAX_COVERED_PERCENT, MAX_LONGEST)["kept"].tolist()
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: A window of MAX_LONGEST + 1 words, as windows of MIN_WORDS words that cover it.
_LONG = ", ".join(f"hm[i + {k}]" for k in [*range(0, MAX_LONGEST + 1 - MIN_WORDS, MIN_WORDS), MAX_LONGEST + 1 - MIN_WORDS])
_ORACLE = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, sum(n - 1) AS d FROM (SELECT doc_id, line, count(*) AS n FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL) GROUP BY 1),
h AS (SELECT doc_id, ws, list_transform(range(1, len(ws) + 1), lambda i: hash(ws[i:i+4])) AS h5,
    list_transform(range(1, len(ws) + 1), lambda i: hash(ws[i:i+{MIN_WORDS - 1}])) AS hm FROM w),
p AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i, unnest(h5) AS h5, unnest(hm) AS hm,
    unnest(list_transform(range(1, len(ws) + 1), lambda i: hash([{_LONG}]))) AS hx FROM h),
g AS (SELECT doc_id, i, n,
    i + 4 <= n AND count(*) OVER (PARTITION BY doc_id, h5) > 1 AS r5,
    i + {MIN_WORDS - 1} <= n AND count(*) OVER (PARTITION BY doc_id, hm) > 1 AS rm,
    i + {MAX_LONGEST} <= n AND count(*) OVER (PARTITION BY doc_id, hx) > 1 AS rx FROM p),
s AS (SELECT doc_id, i, rx,
    bool_or(r5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c5,
    bool_or(rm) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW) AS cm FROM g),
a AS (SELECT doc_id, count(*) FILTER (c5) AS n5, count(*) FILTER (cm) AS nm, bool_or(rx) AS rx FROM s GROUP BY 1),
b AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d, 0) AS n_dup_lines,
    coalesce(n5, 0) AS n_repeat_words, coalesce(nm, 0) AS n_covered, coalesce(rx, false) AS repeat_too_long
    FROM w LEFT JOIN l USING (doc_id) LEFT JOIN a USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, n_covered,
    repeat_too_long, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_covered <= {MAX_COVERED_PERCENT} * n_words
    AND NOT repeat_too_long AS kept FROM b
"""


@query("op1_suffix_array_repetition", _ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition(table(spark, sf_dir, "documents"))
    return measured.withColumn("repeat_too_long", F.col("longest_repeat") > MAX_LONGEST).drop("longest_repeat")
