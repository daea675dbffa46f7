import random

import pytest
from prose import prose

from linkloom.llm import jaccard_join as J


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())


def brute(rows):
    """(n_shingles, component) by comparing all pairs; rows of one id are one document."""
    sets = [(i, shingles(t)) for i, t in rows]
    top = {i: i for i, _ in rows if i is not None}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = root(i), root(j)
                top[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def family(rng, size, copies, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(size)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(words)) if words else 0
            words[k : k + 1] = rng.choice([[], [f"w{rng.randrange(400)}"], [*words[k : k + 1], f"w{rng.randrange(400)}"]])
        yield " ".join(words)


@pytest.mark.parametrize(("hot_bits", "percent"), [(12, 90), (1, 90)])
def test_components_against_brute_force(spark, monkeypatch, hot_bits, percent):
    monkeypatch.setattr(J, "HOT_BITS", hot_bits)
    rng = random.Random(hot_bits)
    texts = ["", "a", "A", "a b", "A  b", "a b c", None]
    for size in (3, 8, 20, 21, 60, 150):
        texts += family(rng, size, 12, 4)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in J.linked_components(docs, percent=percent).collect()), key=str)
    assert got == brute(rows)


def test_repeated_ids_null_ids_and_other_columns(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    more = [(7, prose(80, 21)), (7, prose(80, 22)), (8, prose(80, 21)), (9, prose(80, 22)), (None, prose(80, 21))]
    extra = spark.createDataFrame(more, "doc_id bigint, text string")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    got = sorted((tuple(r) for r in J.linked_components(docs).collect()), key=str)
    assert got == brute(rows + more)
    assert J.linked_components(no_docs).count() == 0
    kept = J.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 7] and ids.count(None) == 3


def test_prefix_is_long_enough():
    for n in range(1, 60):
        for m in range(n, 60):
            least = min(x for x in range(n + 1) if 190 * x >= 90 * (n + m)) if 100 * n >= 90 * m else None
            if least is not None:
                assert J.prefix_length(n, 90) > n - least
