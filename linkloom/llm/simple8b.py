"""Token ids in 64-bit words (Simple-8b): a selector of four bits says how many ids of how many bits a word holds.

The file format is a Parquet dataset of blocks in document order. A block holds whole documents; its ids are cut into
frames, each frame starts a new word, and the block lists the word at which each frame starts, so that frames are
decoded independently and all words of one selector at once. An id of over 60 bits is an escape: a word with
selector 0, followed by the id as a raw word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import query, record_batch, table, texts, written

# Ids per word and bits per id of selectors 2 to 15; 0 is the escape, 1 is unused.
COUNTS = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
FRAME = 16_384
#: A block is closed by the document that brings it to this many ids.
BLOCK_IDS = 65_536
END_ID = 0

BLOCK_DDL = (
    "part int, block int, first_id bigint, n_ids bigint, words binary, frames array<bigint>, doc_ids array<bigint>, "
    "doc_tokens array<bigint>"
)


def pack_frame(ids: np.ndarray) -> np.ndarray:
    """The words of one frame: each takes as many of the next ids as any selector can hold."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    kind = np.uint32 if ids.max() < 1 << 32 else np.uint64
    values = np.concatenate([ids.astype(kind), np.zeros(60, kind)])
    most = values[:n].copy()
    wide = most.astype(np.uint64) >> np.uint64(60) != 0
    choice = np.where(wide, ESCAPE, 15)
    # What fits a denser selector also fits every sparser one.
    seen = 1
    for selector in range(14, 1, -1):
        while seen < COUNTS[selector]:
            np.maximum(most, values[seen : seen + n], out=most)
            seen += 1
        fits = most.astype(np.uint64) < np.uint64(1 << int(BITS[selector]))
        if not fits.any():
            break
        choice[fits] = selector
    step = COUNTS[choice].tolist()
    starts = []
    at = 0
    while at < n:
        starts.append(at)
        at += step[at]
    begin = np.array(starts, np.int64)
    chosen = choice[begin]
    escaped = chosen == ESCAPE
    place = np.arange(len(begin)) + np.cumsum(escaped) - escaped
    out = np.zeros(len(begin) + int(escaped.sum()), np.uint64)
    values = values.astype(np.uint64)
    for selector in np.unique(chosen):
        rows = chosen == selector
        first = begin[rows]
        if selector == ESCAPE:
            out[place[rows] + 1] = values[first]
            continue
        word = np.full(len(first), int(selector) << 60, np.uint64)
        for k in range(int(COUNTS[selector])):
            word |= values[first + k] << np.uint64(k * int(BITS[selector]))
        out[place[rows]] = word
    return out


def unpack_frame(packed: np.ndarray, n: int) -> np.ndarray:
    """The ids of one frame of ``n`` ids."""
    selectors = (packed >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(packed), bool)
    if (selectors == ESCAPE).any():
        # A raw word may look like anything, so escapes are followed from the front.
        at = 0
        escapes = np.flatnonzero(selectors == ESCAPE).tolist()
        for escape in escapes:
            if escape >= at and not raw[escape]:
                raw[escape + 1] = True
                at = escape + 2
    heads = np.flatnonzero(~raw)
    chosen = selectors[heads]
    starts = np.r_[0, np.cumsum(COUNTS[chosen])]
    out = np.zeros(int(starts[-1]), np.uint64)
    for selector in np.unique(chosen):
        rows = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            out[starts[rows]] = packed[heads[rows] + 1]
            continue
        word, first, bits = packed[heads[rows]], starts[rows], int(BITS[selector])
        for k in range(int(COUNTS[selector])):
            out[first + k] = word >> np.uint64(k * bits) & np.uint64((1 << bits) - 1)
    return out[:n]


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """The words of all frames, little-endian, and the word at which each frame starts."""
    packed = [pack_frame(ids[i : i + FRAME]) for i in range(0, len(ids), FRAME)]
    starts = np.cumsum([0] + [len(p) for p in packed])[:-1].tolist()
    return b"".join(p.astype("<u8").tobytes() for p in packed), starts


def unpack(data: bytes, frames: list[int], n: int) -> np.ndarray:
    packed = np.frombuffer(data, "<u8")
    ends = [*frames[1:], len(packed)][: len(frames)]
    found = [
        unpack_frame(packed[a:b], min(FRAME, n - k * FRAME)) for k, (a, b) in enumerate(zip(frames, ends, strict=True))
    ]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class _OtherSpace(Exception):
    """A word that is empty or has white space in it or at its ends."""


class _Words(dict):
    """The ids of words, asked of the library once; emptied at ``limit`` words."""

    TAIL = ".,;:!?"

    def __init__(self, encoder: WordEncoder, space: str, limit: int):
        super().__init__()
        self.encoder, self.space, self.limit = encoder, space, limit

    def __missing__(self, word: str) -> bytes:
        if word.split() != [word]:
            raise _OtherSpace
        if len(self) >= self.limit:
            self.clear()
        core = word.rstrip(self.TAIL)
        if len(core) < len(word) and core and core[-1].isalpha():
            value = self[core] + self.encoder.plain[word[len(core) :]]
        elif word.isalpha() and max(word) < "\u0250":
            value = self.encoder.letters_only(self.space + word)
        else:
            value = self.encoder.whole(self.space + word)
        self[word] = value
        return value


class WordEncoder:
    """Ids of whole texts by a byte-level tokenizer of the tokenizers library.

    A single space or line feed between two characters that are no white space always starts a new pre-token, so a text
    is the sequence of its lines and, in them, of words with the space before them; the ids of a word are asked of the
    library once and remembered. A text with any other white space goes to the library whole.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # The library finds its added tokens in any text; texts that hold one go to it whole.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.spaced = _Words(self, " ", limit)
        self.plain = _Words(self, "", limit // 10)
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters_only(self, word: str) -> bytes:
        """Letters, with a space before them or not, are one pre-token, which the library's model takes as it is."""
        piece = word.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.library.model.tokenize(piece)], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self.whole(text)
        parts: list[bytes] = []
        try:
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                parts.append(self.plain[first])
                parts += map(self.spaced.__getitem__, rest)
                parts.append(self.feed)
        except _OtherSpace:
            return self.whole(text)
        return b"".join(parts[:-1])


def write_packed(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID) -> DataFrame:
    """Encodes all texts and writes them in ascending doc_id order; returns the written blocks.

    The texts are range-partitioned by id, so parts follow each other in id order; a block row carries the ids of its
    documents and their lengths. Null ids come first; equal ids are ordered by text. A null or empty text is the end id
    alone. Other columns are not read; an empty table writes no block. ``tokenizer`` is a path that every executor has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("part", pa.int32()),
                ("block", pa.int32()),
                ("first_id", pa.int64()),
                ("n_ids", pa.int64()),
                ("words", pa.binary()),
                ("frames", pa.list_(pa.int64())),
                ("doc_ids", pa.list_(pa.int64())),
                ("doc_tokens", pa.list_(pa.int64())),
            ]
        )
        encoder = encoder_of(tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        block, first, size = 0, 0, 0
        held: list[tuple[int | None, bytes]] = []

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            data, frames = pack(ids)
            row = {
                "part": [part],
                "block": [block],
                "first_id": [first],
                "n_ids": [len(ids)],
                "words": [data],
                "frames": [frames],
                "doc_ids": [[d for d, _ in held]],
                "doc_tokens": [[len(x) // 4 for _, x in held]],
            }
            return record_batch(schema, row)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append((doc_id, encoder.encode(text.decode("utf-8", "replace")) + end))
                size += len(held[-1][1]) // 4
                if size >= BLOCK_IDS:
                    yield closed()
                    block, first, size, held = block + 1, first + size, 0, []
        if held:
            yield closed()

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, BLOCK_DDL))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker and file; what it remembers serves later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def read_packed(blocks: DataFrame) -> DataFrame:
    """Per document, read back from written blocks: doc_id, start, n_tokens and ids_crc32."""
    ddl = "part int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("part", pa.int32()), *((x, pa.int64()) for x in ("doc_id", "place", "n_tokens", "ids_crc32"))]
        )
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["words"], row["frames"], row["n_ids"]).astype("<u4")
                stops = np.cumsum(row["doc_tokens"])
                starts = stops - row["doc_tokens"]
                columns = {
                    "part": [row["part"]] * len(stops),
                    "doc_id": row["doc_ids"],
                    "place": starts + row["first_id"],
                    "n_tokens": row["doc_tokens"],
                    "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, stops, strict=True)],
                }
                yield record_batch(schema, columns)

    # One row per part: the ids of all parts before it.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    found = blocks.select("part", "first_id", "n_ids", "words", "frames", "doc_ids", "doc_tokens").mapInArrow(run, ddl)
    start = (F.col("_shift") + F.col("place")).cast("bigint").alias("start")
    return found.join(shifts, "part").select("doc_id", start, "n_tokens", "ids_crc32")


@query("op4_simple8b")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_packed(write_packed(docs, public_tokenizers.path("byte_bpe_50k.json")))
