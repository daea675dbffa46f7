"""Benchmark decontamination by canonical templates.

Numbers, units after them and names inside sentences become typed placeholders; windows of the canonical words of all
documents are hash-joined with those of the benchmark, and the values in the placeholders must correspond one to one,
so that a question with other numbers and names is found and a mere pattern is not. A capitalised word that begins a
sentence is a name or not, so each window has a hash for either case, and one for its words as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import (
    batches_of,
    count_rows,
    free_name,
    query,
    record_batch,
    slices,
    summed_counts,
    table,
    texts,
    words,
    written,
)

WINDOW = 8
#: Placeholders stand in a window's hashes if so many of its words are none; else only the words as they are count.
MIN_LITERALS = 4
#: A document leaks an item if windows cover this share of the item's words, and this share of the slots corresponds.
MIN_COVERAGE = 0.5
MIN_CONSISTENT = 0.9
#: Documents emit a window only if a benchmark window has its slot of this fixed-size table; the join then decides.
SLOTS = 1 << 20
CHUNK = 4_096
BATCH_WORDS = 100_000

PUNCTUATION = b".,;:!?()[]{}\"'`*#>%$&|<"
ENDS = (b".", b"!", b"?")
NUMBER = re.compile(rb"[+-]?[0-9][0-9.,/:-]*$")
MEASURE = re.compile(rb"[+-]?[0-9][0-9.,]*([a-z]{1,4})$")
NAME = re.compile(rb"(?:[A-Z]|\xc3[\x80-\x9e])(?:[a-z'-]|[\xc3-\xf4][\x80-\xbf]+)+$")
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg lb oz t ml l gal s sec min h hr hour hours minute minutes second seconds day days "
    b"week weeks month months year years meter meters metre metres mile miles inch inches foot feet gram grams kilogram "
    b"kilograms pound pounds liter liters litre litres percent dollar dollars euro euros cent cents degree degrees "
    b"mph kmh hz khz mhz ghz kb mb gb tb w kw v a".split()
)
LITERAL, NUM, UNIT, NAMED, MEASURED = range(5)
CODES = np.array([0, *(xxhash.xxh3_64_intdigest(b"<%d>" % k) for k in (NUM, UNIT, NAMED, MEASURED))], np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)


class Canon(dict):
    """Numbers words; for each number the hash of its plain form, what it may stand for, and whether it ends a
    sentence. Emptied at ``limit`` words between texts."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit
        self.code = np.zeros(1024, np.uint64)
        self.kind = np.zeros(1024, np.int8)
        self.ends = np.zeros(1024, bool)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.code):
            self.code, self.kind, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.code, self.kind, self.ends))
        plain = word.strip(PUNCTUATION)
        low = plain.lower()
        measure = MEASURE.match(low)
        kind = LITERAL
        if NUMBER.match(plain):
            kind = NUM
        elif measure and measure[1] in UNITS:
            kind = MEASURED
        elif low in UNITS:
            kind = UNIT
        elif NAME.match(plain):
            kind = NAMED
        self.code[at] = xxhash.xxh3_64_intdigest(low)
        self.kind[at] = kind
        self.ends[at] = word.rstrip(b"\"')]}*#%$&|<>").endswith(ENDS)
        self[word] = at
        return at

    def read(self, items: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the words of some texts, laid end to end: plain codes, kinds of placeholders (0: none), these if no word
        that begins a sentence is a name, and which text."""
        if len(self) >= self.limit:
            self.clear()
        lengths = np.array([len(w) for w in items], np.int64)
        ids = np.fromiter((self[w] for ws in items for w in ws), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(items)), lengths)
        kind = self.kind[ids].copy()
        first = np.r_[True, owner[1:] != owner[:-1]] if len(ids) else np.zeros(0, bool)
        after_end = first | np.r_[True, self.ends[ids][:-1]] if len(ids) else first
        after_number = ~first & np.r_[False, kind[:-1] == NUM] if len(ids) else first
        kind[(kind == UNIT) & ~after_number] = LITERAL
        inside = np.where((kind == NAMED) & after_end, LITERAL, kind).astype(kind.dtype)
        return self.code[ids], kind, inside, owner


def _rolled(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    found = np.zeros(n, np.uint64)
    for k in range(size):
        found = found * BASE + codes[k : n + k]
    found += np.uint64(size)
    found = (found ^ found >> np.uint64(29)) * BASE
    return found ^ found >> np.uint64(32)


def window_hashes(
    codes: np.ndarray, kinds: tuple[np.ndarray, ...], owner: np.ndarray, size: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions at which a window of ``size`` words lies in one text and the hashes of these windows: first of the
    words as they are, then by each of ``kinds`` where placeholders may stand and make a hash that is not there yet."""
    n = len(codes) - size + 1
    if n <= 0:
        return [(np.zeros(0, np.int64), np.zeros(0, np.uint64))] * (1 + len(kinds))
    own = owner[:n] == owner[size - 1 :]
    hashes = [_rolled(codes, size)]
    places = [np.flatnonzero(own)]
    for kind in kinds:
        literals = np.r_[0, np.cumsum(kind == LITERAL)]
        enough = literals[size:] - literals[:-size] >= min(MIN_LITERALS, (size + 1) // 2)
        found = _rolled(np.where(kind == LITERAL, codes, CODES[kind]), size)
        new = own & enough
        for other in hashes:
            new &= found != other
        # A window without placeholders of this kind has the hash of one before.
        hashes.append(np.where(enough, found, hashes[0]))
        places.append(np.flatnonzero(new))
    return [(at, found[at]) for at, found in zip(places, hashes, strict=True)]


def _slots(ws: list[bytes], kinds: np.ndarray) -> list[str | None]:
    """The values in the placeholders of a window, with their kinds; None for words that are none."""
    return [
        None if k == LITERAL else f"{k}:{w.strip(PUNCTUATION).lower().decode('utf-8', 'replace')}"
        for w, k in zip(ws, kinds.tolist(), strict=True)
    ]


def _window_rows(items: DataFrame, sizes: list[int] | None, wanted) -> DataFrame:
    """Rows (doc_id, n_words, size, place, hash, plain, slots) of all windows, or of those whose table slot is ``wanted``;
    ``plain`` if the hash is that of the words as they are.

    Without ``sizes``, each text has windows of WINDOW words, or one of all its words if it has fewer.
    """
    ddl = "doc_id bigint, n_words bigint, size int, place bigint, hash bigint, plain boolean, slots array<string>"
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("size", pa.int32()), ("place", pa.int64()), ("hash", pa.int64())]
        + [("plain", pa.bool_()), ("slots", pa.list_(pa.string()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            # Only the words of one run of texts are held at a time.
            split = ((doc_id, words(t)) for doc_id, t in zip(ids, batch.column("text").to_pylist(), strict=True))
            for some in batches_of(split, lambda x: len(x[1]), BATCH_WORDS):
                codes, named, inside, owner = canon.read([ws for _, ws in some])
                lengths = [len(ws) for _, ws in some]
                starts = np.cumsum([0, *lengths])
                rows: list[tuple] = []
                for size in sizes or sorted({min(WINDOW, n) for n in lengths if n}):
                    variants = window_hashes(codes, (inside, named), owner, size)
                    for kinds, (at, hashes) in zip((None, inside, named), variants, strict=True):
                        plain = kinds is None
                        if sizes is None and size < WINDOW:  # the whole of a short text
                            whole = np.array(lengths)[owner[at]] == size
                            at, hashes = at[whole], hashes[whole]
                        if wanted is not None:
                            hit = wanted.value[(hashes % np.uint64(SLOTS)).astype(np.int64)]
                            at, hashes = at[hit], hashes[hit]
                        for p, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
                            k = int(owner[p])
                            place = p - int(starts[k])
                            doc_id, ws = some[k]
                            slots = _slots(ws[place : place + size], (inside if plain else kinds)[p : p + size])
                            rows.append((doc_id, len(ws), size, place, h, plain, slots))
                if rows:
                    yield record_batch(schema, dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return texts(items).mapInArrow(run, ddl)


def _slot_table(windows: DataFrame) -> np.ndarray:
    """Which slots of the fixed-size table have a benchmark window."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts[(hashes % np.uint64(SLOTS)).astype(np.int64)] = 1
        yield record_batch(schema, count_rows(counts, CHUNK))

    found = summed_counts(windows.select("hash").mapInArrow(run, "part int, counts binary"), chunk=CHUNK)
    return np.resize(found, SLOTS) > 0 if len(found) else np.zeros(SLOTS, bool)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    min_coverage: float = MIN_COVERAGE,
    min_consistent: float = MIN_CONSISTENT,
) -> DataFrame:
    """Rows (doc_id, item_id, coverage, n_slots, n_consistent, n_changed) of documents that hold benchmark items.

    A pair is reported if one of these passes by itself: the windows of one alignment, of neighbouring alignments (words
    put in or left out), those of them that are verbatim, or all windows of the pair, should an item be scattered. The
    figures are those of the one that passes with the most coverage, then with the fewest changed values.
    ``coverage`` is the share of the item's words in these windows; ``n_slots`` counts placeholder values in them,
    ``n_consistent`` those where each value of the item stands for one value of the document and the other way round,
    ``n_changed`` those with another value than the item: 0 means a copy, more a re-parameterised one.
    An item of fewer than 8 words is one window of all its words. Texts are whole; null and empty ones have no window
    and no leak, and empty tables give no rows. Documents are told apart by doc_id, items by item_id: rows repeated
    under one id count once, null ids as one document or item. Other columns are not read.
    """
    items = written(_window_rows(benchmark.select(F.col("item_id").alias("doc_id"), "text"), None, None))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most 8 values
    empty = "doc_id bigint, item_id bigint, coverage double, n_slots bigint, n_consistent bigint, n_changed bigint"
    if not sizes:
        return docs.sparkSession.createDataFrame([], empty)
    wanted = docs.sparkSession.sparkContext.broadcast(_slot_table(items))
    found = _window_rows(docs, sizes, wanted)
    theirs = items.select(
        "hash",
        "size",
        F.col("doc_id").alias("item_id"),
        F.col("n_words").alias("item_words"),
        F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"),
    )
    pairs = found.select("doc_id", "size", "place", "hash", "plain", "slots").join(theirs, ["hash", "size"])
    key = ["doc_id", "item_id"]
    # Neighbouring alignments of a pair are one run.
    shifted = pairs.withColumn("shift", F.col("place") - F.col("item_place"))
    by_shift = W.partitionBy(*key).orderBy("shift")
    shifted = shifted.withColumn("_new", (F.col("shift") - F.lag("shift").over(by_shift) > WINDOW).cast("int"))
    shifted = shifted.withColumn("run", F.sum(F.coalesce("_new", F.lit(0))).over(by_shift))
    zipped = F.arrays_zip(F.col("slots").alias("ours"), F.col("item_slots").alias("theirs"))
    tokens = shifted.select(
        *key, "item_words", "item_place", "shift", "run", "plain", F.posexplode(zipped).alias("k", "slot")
    ).select(
        *key, "item_words", "shift", "run", "plain", (F.col("item_place") + F.col("k")).alias("token"),
        F.col("slot.ours"), F.col("slot.theirs"),
    )

    def part(kind: str, at: str):
        return F.struct(F.lit(kind).alias("kind"), F.col(at).cast("bigint").alias("at"))

    everything = F.struct(F.lit("pair").alias("kind"), F.lit(0).cast("bigint").alias("at"))
    parts = F.array(everything, part("run", "run"), part("shift", "shift"), F.when(F.col("plain"), part("plain", "run")))
    tokens = tokens.withColumn("part", F.explode(F.array_compact(parts))).drop("run", "plain")
    tokens = written(tokens.distinct())
    key = [*key, "part"]
    covered = tokens.groupBy(*key).agg(
        (F.count_distinct("token") / F.max("item_words")).alias("coverage"),
    ).where(F.col("coverage") >= min_coverage)
    slots = tokens.where("theirs IS NOT NULL AND ours IS NOT NULL")
    values = slots.groupBy(*key, "shift", "theirs", "ours").agg(F.count("*").alias("n"))
    by_theirs = W.partitionBy(*key, "shift", "theirs").orderBy(F.desc("n"), "ours")
    by_ours = W.partitionBy(*key, "shift", "ours").orderBy(F.desc("n"), "theirs")
    ranked = values.withColumn("_a", F.row_number().over(by_theirs)).withColumn("_b", F.row_number().over(by_ours))
    checked = ranked.groupBy(*key).agg(
        F.sum("n").alias("n_slots"),
        F.sum(F.when((F.col("_a") == 1) & (F.col("_b") == 1), F.col("n")).otherwise(0)).alias("n_consistent"),
        F.sum(F.when(F.col("theirs") != F.col("ours"), F.col("n")).otherwise(0)).alias("n_changed"),
    )
    numbers = ("n_slots", "n_consistent", "n_changed")
    checked = checked.select(*(F.col(c).alias(f"_{c}") for c in key), *numbers)
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    passing = (
        covered.join(checked, same, "left")
        .select(*key, "coverage", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers))
        .where(F.col("n_consistent") >= min_consistent * F.col("n_slots"))
    )
    order = F.struct(F.col("coverage"), -F.col("n_changed"), F.col("n_slots"), F.col("n_consistent"))
    best = passing.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("coverage", *numbers), order).alias("_best"))
    return best.select("doc_id", "item_id", "_best.*")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item. Rows are judged one by one, also those without an id
    and those that share one; equal rows stay or go together. A null text holds nothing and stays; an empty table stays
    empty."""
    row = F.xxhash64("doc_id", "text")
    mark = free_name(docs, "leaking")
    found = leaks(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(found, row == F.col(mark), "left_anti")


@query("op2_template_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
