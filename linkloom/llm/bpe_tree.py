"""Byte-level BPE as a monoid: texts and pieces are encoded by halves, and neighbours are joined at their seam.

Two monoids are at work. *Pieces* of a text (the matches of the splitting pattern): halves of a text are split on their
own; the join re-splits a window around the seam, from a piece that starts far enough before the seam to be settled up
to the first boundary that the right half also has. The pattern looks at nothing before a match, so all pieces beyond a
common boundary are the same. *Tokens* of a piece: halves of a long piece are encoded on their own; the join re-encodes
a window of tokens around the seam, growing it until the two pairs of tokens at its borders are stable. A sequence of
tokens is the BPE encoding of its bytes if and only if each neighbouring pair is the encoding of the pair's bytes, so
stable borders prove that nothing outside the window changes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm.common import give_back, query, record_batch, table, texts

#: Texts of up to so many characters, and pieces of up to so many bytes, are leaves of the tree.
LEAF_CHARS = 4_096
LEAF_BYTES = 32
#: Rows whose ids are held at a time.
ROWS = 500
#: The pattern's longest look ahead of a position that it does not consume: two letters after an apostrophe.
LOOK = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class TreeBPE:
    """Encoder and decoder for one rank file and splitting pattern; remembers up to ``limit`` pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 500_000):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.limit = limit
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    # Tokens of one piece

    def _merge(self, data: bytes) -> list[int]:
        """Leaf: merges the pair of lowest rank, the leftmost of equals, until none is left."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        parts = [data[i : i + 1] for i in range(len(data))]
        costs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, -1
            for i, cost in enumerate(costs):
                if cost is not None and (best is None or cost < best):
                    best, at = cost, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _stable(self, left: int, right: int) -> bool:
        """Whether the two tokens are the encoding of their bytes."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            joined = self._merge(self.bytes_of[left] + self.bytes_of[right])
            found = self.pairs[left, right] = joined == [left, right]
        return found

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation, from the encodings of two neighbours."""
        if not left or not right or self._stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self._bytes(left[a:]) + self._bytes(right[:b])
            middle = self._merge(window)
            settled_left = a == 0 or self._stable(left[a - 1], middle[0])
            settled_right = b == len(right) or self._stable(middle[-1], right[b])
            if settled_left and settled_right:
                return left[:a] + middle + right[b:]
            width *= 2

    def _bytes(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))

    def encode_piece(self, data: bytes) -> list[int]:
        """One piece: halves are encoded and joined, level by level."""
        level = [self._merge(data[i : i + LEAF_BYTES]) for i in range(0, len(data), LEAF_BYTES)]
        while len(level) > 1:
            pairs = [self.join_tokens(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0] if level else []

    # Pieces of a text

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        """The pieces of the concatenation, from the pieces of two neighbours."""
        if not left or not right:
            return left + right
        # Pieces from the first that is not settled: it reaches the seam, or the pattern could look beyond the seam.
        a, tail = len(left), 0
        while a and (a == len(left) or tail < LOOK):
            a -= 1
            tail += len(left[a])
        width = 4
        while True:
            b = min(len(right), width)
            window = "".join(left[a:]) + "".join(right[:b])
            middle = self.pattern.findall(window)
            if b == len(right):
                return left[:a] + middle
            # The window's own end may cut a piece: only boundaries well before it count.
            ends = set()
            at = tail
            for piece in right[:b]:
                at += len(piece)
                ends.add(at)
            at = 0
            for k, piece in enumerate(middle):
                at += len(piece)
                if at > tail and at in ends and at + LOOK <= len(window) and k + 1 < len(middle):
                    skip, seen = 0, tail
                    while seen < at:
                        seen += len(right[skip])
                        skip += 1
                    return left[:a] + middle[: k + 1] + right[skip:]
            width *= 2

    def pieces(self, text: str) -> list[str]:
        level = [self.pattern.findall(text[i : i + LEAF_CHARS]) for i in range(0, len(text), LEAF_CHARS)]
        while len(level) > 1:
            pairs = [self.join_pieces(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0] if level else []

    # Whole texts

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for piece in self.pieces(text):
            tokens = known.get(piece)
            if tokens is None:
                tokens = tuple(self.encode_piece(piece.encode()))
                if len(piece) <= 64:
                    if len(known) >= self.limit:
                        known.clear()
                    known[piece] = tokens
            out += tokens
        return out

    def decode(self, tokens: list[int]) -> bytes:
        """The bytes of all tokens, concatenated up the tree."""
        level = [self._bytes(tokens[i : i + LEAF_CHARS]) for i in range(0, len(tokens), LEAF_CHARS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_CODERS: dict[tuple[str, str], TreeBPE] = {}


def coder_of(path: str, pattern: str) -> TreeBPE:
    """One coder per worker and file; what it remembers serves later tasks."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = TreeBPE(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids array<int>) with the token ids of each whole text.

    A null or empty text has no ids. Rows are encoded one by one: repeated rows give repeated rows, a null id stays null,
    an empty table gives no rows, and columns other than doc_id and text are not read. ``ranks`` is a path that every
    executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                ids = [coder.encode(t.decode("utf-8", "replace")) for t in some.column("text").to_pylist()]
                yield record_batch(schema, {"doc_id": some.column("doc_id"), "ids": ids})
        # The worker may serve other stages next.
        _CODERS.clear()
        give_back()

    return texts(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Rows (doc_id, data binary) with the bytes that (doc_id, ids) rows stand for; null ids stand for no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            data = [coder.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), "data": data})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document the number of tokens, the digest of their ids, and the digest of the bytes they decode to."""
    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        )
        for batch in batches:
            rows: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text.decode("utf-8", "replace"))
                rows["n_tokens"].append(len(ids))
                rows["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                rows["decoded_sha256"].append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield record_batch(schema, {"doc_id": batch.column("doc_id"), **rows})

    return texts(docs).mapInArrow(run, ddl)


@query("op6_bpe_tree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
