import random
from collections import Counter

import numpy as np
from prose import prose

from linkloom.llm import repetition as R


def brute(words):
    n = len(words)
    out = []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def test_longest_repeats_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(rng.randrange(1, 5))]
        ids = np.array([w + 10 * k for k, t in enumerate(texts) for w in t], np.int64)
        sizes = np.array([len(t) for t in texts])
        found = R.longest_repeats(ids, np.repeat(np.cumsum(sizes), sizes))
        assert found.tolist() == [x for t in texts for x in brute(t)]


def test_one_word_many_times():
    found = R.longest_repeats(np.zeros(5000, np.int64), np.full(5000, 5000))
    assert found.tolist() == [max(4999 - i if i else 4999, min(i, 1), 5000 - i if i else 0) for i in range(5000)]


def test_spans_are_the_windows_that_occur_twice():
    rng = random.Random(4)
    for _ in range(40):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        m = rng.randrange(1, 6)
        windows = Counter(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
        inside = {i + k for i in range(len(words) - m + 1) if windows[tuple(words[i : i + m])] > 1 for k in range(m)}
        assert {i for a, b in R.repeat_spans(words, m) for i in range(a, b)} == inside


def test_odd_documents(odd_docs, no_docs):
    rows = R.repetition(odd_docs).collect()
    assert len(rows) == 9 and R.repetition(no_docs).count() == 0
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[1].kept and by[5].kept and by[5].n_words == 30_000
    assert not any(by[k].kept for k in (2, 3, 4)) and by[2].n_words == 0
    assert sum(r.doc_id == 6 for r in rows) == 2
    assert R.kept_documents(odd_docs).columns == odd_docs.columns
    assert R.kept_documents(odd_docs).count() == sum(r.kept for r in rows)


def test_verdicts(spark):
    passage = prose(70, 3)
    long_repeat = passage + " " + prose(900, 8) + " " + passage
    docs = spark.createDataFrame(
        [(1, "the " * 50), (2, long_repeat), (3, prose(200, 4)), (4, "a b c")], "doc_id bigint, text string"
    )
    by = {r.doc_id: r for r in R.repetition(docs).collect()}
    assert by[1].base_failed and not by[1].kept
    assert not by[2].base_failed and by[2].longest_repeat == 70 and not by[2].kept
    assert by[3].kept and by[4].base_failed
