"""What the operators share: the words of a text, tables for queries, and written intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import cut_lineage as written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), the text as bytes. A null text is an empty one; other columns are not looked at."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"))


def words(text: bytes) -> list[bytes]:
    """Runs of other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.split()


def lower(text: bytes) -> bytes:
    """A-Z become a-z; all else stays."""
    return text.lower()


class Hashes(dict):
    """64-bit hashes of words, remembered for up to ``limit`` words; the memory of a task stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def train_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def batches_of(rows: Iterable, weigh: Callable, most: int) -> Iterator[list]:
    """Runs of neighbouring rows whose weights sum to about ``most``; a heavier row is a run of its own."""
    run: list = []
    total = 0
    for row in rows:
        weight = weigh(row)
        if run and total + weight > most:
            yield run
            run, total = [], 0
        run.append(row)
        total += weight
    if run:
        yield run


#: Rows of an Arrow batch that become Python objects at a time, and their bytes.
SLICE_ROWS, SLICE_BYTES = 500, 4 << 20


def give_back() -> None:
    """Returns freed memory to the system; a Python worker lives on after its task, and other stages use the same
    executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows of a bounded number and, but for a single longer text, of bounded bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(sizes.astype(np.float64)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0.0
            stop = int(np.searchsorted(ends, before + SLICE_BYTES, "right"))
            stop = min(max(stop, start + 1), start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def record_batch(schema: pa.Schema, columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def summed_counts(rows: DataFrame, *, chunk: int) -> np.ndarray:
    """The sum of equally long counter arrays that come as rows (part int, counts binary): pieces of ``chunk``
    little-endian 64-bit counters. The caller's arrays have a fixed length, so the sum has it too; the pieces are summed
    where they meet by number, one after the other."""

    def run(batches: Iterator) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(counts, "<i8")
                sums[part] = sums[part] + values if part in sums else values
        schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
        columns = {"part": list(sums), "counts": [v.astype("<i8").tobytes() for v in sums.values()]}
        yield record_batch(schema, columns)

    # A second sum joins what tasks have summed, should a piece's rows come in several of them.
    found = rows.select("part", "counts").repartition("part").mapInArrow(run, "part int, counts binary").collect()
    size = chunk * (1 + max((r.part for r in found), default=-1))
    out = np.zeros(size, np.int64)
    for r in found:
        out[r.part * chunk : (r.part + 1) * chunk] += np.frombuffer(r.counts, "<i8")
    return out


def count_rows(counts: np.ndarray, chunk: int) -> dict[str, list]:
    """Columns part and counts of a counter array, for ``summed_counts``."""
    pieces = counts.astype("<i8").reshape(-1, chunk)
    return {"part": list(range(len(pieces))), "counts": [p.tobytes() for p in pieces]}
