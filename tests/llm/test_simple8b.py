import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from linkloom.llm import simple8b as S

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 9, 16, 30, 60, 64])
@pytest.mark.parametrize("n", [0, 1, 59, 61, S.FRAME, S.FRAME + 1])
def test_round_trip(n, bits):
    rng = np.random.default_rng(bits * 100 + n)
    ids = rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True)
    ids[rng.random(n) < 0.4] %= 5
    data, frames = S.pack(ids)
    assert (S.unpack(data, frames, n) == ids).all()
    assert len(frames) == -(-n // S.FRAME)


def test_small_ids_share_words():
    data, _ = S.pack(np.ones(6000, np.uint64))
    assert len(data) == 8 * 100


ODD = ["", "a", " a", "a  b", "a\n\nb", "don't we'll 're", "a\x1c b", "q\x85 w", "\ta b", "a <|endoftext|> b", "é ño 12kg"]
ODD += ["日本 語。 x", "word.,\nword; z!?", "a　 b", "a' 'b '' ,, .", "x" * 3000, "ß² ½ n.b. ..."]


@pytest.mark.parametrize("text", ODD)
def test_words_as_the_library(text):
    library = Tokenizer.from_file(PATH)
    found = np.frombuffer(S.encoder_of(PATH).encode(text), "<u4").tolist()
    assert found == library.encode(text, add_special_tokens=False).ids


def test_odd_documents(odd_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    rows = S.read_packed(S.write_packed(odd_docs, PATH)).collect()
    assert len(rows) == 9 and S.read_packed(S.write_packed(no_docs, PATH)).count() == 0
    texts = sorted(
        ((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())
    )
    at = 0
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), texts, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, at, len(ids), crc)
        at += len(ids)
