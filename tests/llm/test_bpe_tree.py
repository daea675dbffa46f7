import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from linkloom.llm import bpe_tree as B

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", "the", "'", "'r", "e", "'re", " ", "  ", "\n", "\t", "1", "23", "é", "日本", "…", "'ll", "!!", " ", "🙂"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 5, 40])
def test_any_leaf_size_gives_the_same(leaf, library, monkeypatch):
    monkeypatch.setattr(B, "LEAF_CHARS", leaf)
    monkeypatch.setattr(B, "LEAF_BYTES", leaf)
    coder = B.TreeBPE(B.read_ranks(PATH), public_tokenizers.PATTERN)
    rng = random.Random(leaf)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(40)))
        assert coder.pieces(text) == coder.pattern.findall(text)
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefghijklmnop", "aé"])
def test_long_pieces(alphabet, library):
    coder = B.coder_of(PATH, public_tokenizers.PATTERN)
    rng = random.Random(1)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    assert coder.encode(text) == library.encode_ordinary(text)


def test_odd_documents(odd_docs, no_docs, library):
    rows = B.digests(odd_docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd_docs.collect():
        ids = library.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert B.digests(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    tokens = B.encoded(odd_docs, PATH, public_tokenizers.PATTERN)
    back = {(r.doc_id, bytes(r.data)) for r in B.decoded(tokens, PATH, public_tokenizers.PATTERN).collect()}
    assert back == {(r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()}
