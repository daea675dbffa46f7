"""Exact Jaccard join of shingle sets by grouped prefixes, and the components of its links.

Documents with equal sets are one class. The shingles of all sets have one order, rare ones first (by the class of a
fixed-size table of counts over the whole corpus, then by hash); two sets that are similar enough share a shingle among
the first few of either, its prefix. Classes with the same prefix and size are one group; groups meet by the shingles of
their prefixes; pairs of groups are filtered by size and by the places of the shared shingle; then they are expanded to
their members, whose sets are compared exactly.

Large families of near copies would make a pair of any two members. Therefore each group is first compared with its most
promising neighbour only, and what is linked becomes a component; then all pairs of groups in different components are
joined. No link between components is lost, and the pairs inside a component are not needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import (
    Hashes,
    batches_of,
    count_rows,
    free_name,
    lower,
    query,
    record_batch,
    slices,
    summed_counts,
    table,
    texts,
    words,
    written,
)
from linkloom.llm.components import components

SHINGLE = 3
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Counters of shingles; a fixed number, whatever the corpus.
SLOTS = 1 << 20
CHUNK = 4_096
#: A prefix shingle that may occur more often than 2 to this power is dealt out over several tasks.
HOT_BITS = 12
#: So many ids may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
BATCH_WORDS = 200_000
#: Words whose hashes a task remembers.
HELD_WORDS = 150_000

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * M2
    return x ^ x >> np.uint64(29)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` words of one text; of all words if there are fewer; none for no words."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size))
    for k in range(size):
        out = out * M1 + hashes[k : n - size + 1 + k]
    return _mixed(out)


def shingle_set(text: bytes, hashes: Hashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a whole text, ascending."""
    return np.unique(shingle_hashes(hashes.array(words(lower(text))), size))


def prefix_length(n: int, percent: int) -> int:
    """So many first shingles of a set of n meet one of any set that is similar enough."""
    return n - -(-percent * n // 100) + 1 if n else 0


def parities(shingles: np.ndarray, kinds: int) -> np.ndarray:
    """For each of ``kinds`` kinds (a power of two), whether an odd number of shingles is of it, in 64-bit words. The
    halves of the words, combined by exclusive or, are the parities by half as many kinds."""
    odd = np.bincount((shingles >> np.uint64(8) & np.uint64(kinds - 1)).astype(np.int64), minlength=kinds) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def shingle_classes(docs: DataFrame, size: int) -> np.ndarray:
    """For each slot of the counters, the number of bits of its count over all shingles of all texts."""
    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        hashes = Hashes(HELD_WORDS)
        for batch in slices(batches):
            split = (words(lower(t)) for t in batch.column("text").to_pylist())
            for some in batches_of(split, len, BATCH_WORDS):
                found = np.concatenate([shingle_hashes(hashes.array(w), size) for w in some])
                counts += np.bincount((found % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        yield record_batch(schema, count_rows(counts, CHUNK))

    total = summed_counts(texts(docs).mapInArrow(run, "part int, counts binary"), chunk=CHUNK)
    bits = np.zeros(SLOTS, np.uint8)
    if len(total):
        bits[:] = np.frexp(total.astype(np.float64))[1]
    return bits


SIGNATURE = "doc_id bigint, n bigint, set_id binary, gid binary, p array<bigint>, q array<bigint>, prefix array<bigint>, hot array<int>"


def signatures(docs: DataFrame, bits: np.ndarray, size: int, percent: int) -> DataFrame:
    """Per document: size and digest of its set, digest of its prefix and size, parities of its shingles by 256 kinds and
    by at least twice as many kinds as there are shingles, its prefix, and how hot each prefix shingle may be."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("gid", pa.binary())]
        + [("p", pa.list_(pa.int64())), ("q", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("hot", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(HELD_WORDS)
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, hashes, size)
                kinds = shared.value[(found % np.uint64(SLOTS)).astype(np.int64)]
                n, take = len(found), prefix_length(len(found), percent)
                first = np.argsort(kinds, kind="stable")[:take]
                prefix = found[first]
                p, q = parities(found, 256), parities(found, 64 << max(0, (2 * n - 1) // 64).bit_length())
                gid = xxhash.xxh3_128_digest(n.to_bytes(8, "little") + prefix.tobytes())
                hot = np.maximum(kinds[first].astype(np.int32) - HOT_BITS, 0)
                rows.append((n, xxhash.xxh3_128_digest(found.tobytes()), gid, p, q, prefix.view(np.int64), hot))
            columns = dict(zip(schema.names[1:], map(list, zip(*rows, strict=True)), strict=True)) if rows else None
            if columns:
                yield record_batch(schema, {"doc_id": batch.column("doc_id"), **columns})

    return texts(docs).mapInArrow(run, SIGNATURE)


def _apart(a: Column, b: Column) -> Column:
    """How many of the 256 parities differ: never more than the shingles that only one of the sets has."""
    parts = [F.bit_count(F.get(a["p"], F.lit(k)).bitwiseXOR(F.get(b["p"], F.lit(k)))) for k in range(4)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def _apart_by_64(a: Column, b: Column) -> Column:
    """The same for the parities by 64 kinds, which are one number."""
    return F.bit_count(a["s"].bitwiseXOR(b["s"]))


def _enough(shared: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether so many shared shingles suffice for sets of these sizes."""
    return (100 + percent) * shared >= percent * (n_a + n_b)


def _sizes_fit(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _places_fit(n_a: Column, at_a: Column, n_b: Column, at_b: Column, percent: int) -> Column:
    """If the first shared shingle stands at these places, the rest can still be shared often enough."""
    return _enough(F.least(n_a - at_a, n_b - at_b), n_a, n_b, percent)


def _parities_fit(a: Column, b: Column, percent: int, apart=_apart) -> Column:
    """Sets with d parities apart share at most (n_a + n_b - d) / 2 shingles."""
    n = a["n"] + b["n"]
    return (100 + percent) * (n - apart(a, b)) >= 2 * percent * n


def _halved(q: Column, length: Column) -> Column:
    """Parities by half as many kinds, if there are more words than ``length``."""
    folded = F.zip_with(F.slice(q, 1, length), F.slice(q, length + 1, length), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(q) > length, folded).otherwise(q)


def _many_parities_fit(n: Column, q_a: Column, q_b: Column, percent: int) -> Column:
    """As ``_parities_fit``, by so many kinds that sets that are not similar hardly pass. Sizes of similar sets differ by
    less than a factor of two, and so do the numbers of words."""
    length = F.least(F.size(q_a), F.size(q_b))
    each = F.zip_with(_halved(q_a, length), _halved(q_b, length), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(each, F.lit(0), lambda total, x: total + x)
    return (100 + percent) * (n - apart) >= 2 * percent * n


def verified(pairs: DataFrame, marks: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of distinct (a, b) pairs of document ids, those whose whole texts have similar enough shingle sets.

    ``marks`` (cid, n, q) spare the comparison of most pairs that are not similar."""
    of = [marks.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("q").alias(f"q_{x}")) for x in "ab"]
    likely = pairs.join(of[0], "a").join(of[1], "b")
    likely = likely.where(_sizes_fit(F.col("n_a"), F.col("n_b"), percent))
    likely = likely.where(_many_parities_fit(F.col("n_a") + F.col("n_b"), F.col("q_a"), F.col("q_b"), percent))
    pairs = written(likely.select("a", "b").distinct())
    ids = written(pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct())
    needed = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    body = texts(docs)
    body = body.join(needed, body["doc_id"] == needed["_id"], "left_semi")
    of_a = body.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    of_b = body.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(of_a.hint("merge"), "a").join(of_b.hint("merge"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(HELD_WORDS)
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for batch in slices(batches, "text_b"):
            keep = []
            for text_a, text_b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if text_b != last[0]:
                    last = (text_b, shingle_set(text_b, hashes, size))
                found = shingle_set(text_a, hashes, size)
                shared = len(np.intersect1d(found, last[1], assume_unique=True))
                keep.append(100 * shared >= percent * (len(found) + len(last[1]) - shared))
            chosen = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(chosen.columns, schema=schema)

    return written(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"))


def linked_components(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable by links. A text without words, or null, has the empty set and
    links with nothing. A row without an id has no component and links with nothing. Rows that share an id are one
    document, which links where any of its texts does. Other columns are not read; an empty table gives no rows.
    Shingles are compared by 64-bit hashes.
    """
    bits = shingle_classes(docs, size)
    signed = written(signatures(docs, bits, size, percent))
    usable = signed.where("doc_id IS NOT NULL AND n > 0")
    # One class per set, named by its smallest document; one group per prefix and size, named by its smallest class.
    rest = F.struct("n", "gid", "p", "q", "prefix", "hot")
    classes = written(
        usable.groupBy("set_id").agg(F.min("doc_id").alias("cid"), F.min_by(rest, "doc_id").alias("r")).select("set_id", "cid", "r.*")
    )
    marks = classes.select("cid", "n", "q")
    leaders = classes.groupBy("gid").agg(F.min("cid").alias("g"))
    members = written(classes.select("gid", "cid", "n", "p").join(leaders, "gid").select("g", "cid", "n", "p"))
    heads = classes.join(leaders.select(F.col("gid").alias("_gid"), "g"), (F.col("gid") == F.col("_gid")) & (F.col("cid") == F.col("g")))
    short = F.get("p", F.lit(0))
    for k in (1, 2, 3):
        short = short.bitwiseXOR(F.get("p", F.lit(k)))
    entries = heads.select("g", "n", short.alias("s"), F.posexplode(F.arrays_zip("prefix", "hot")).alias("at", "e")).select(
        F.col("e.prefix").alias("key"), F.col("e.hot").alias("hot"), "g", "n", "at", "s"
    )
    # A hot shingle's groups are dealt out by part. In each part, groups stand by the place of the shingle: the fewer
    # rarer shingles stand before it, the fewer the group has for itself, so a family's most typical member comes first.
    part = F.pmod(F.xxhash64("g"), F.pow(F.lit(2), F.col("hot")).cast("bigint"))
    row = F.struct("g", "n", "at", "s")
    order = W.partitionBy("key", "part").orderBy("at", "n", "g")
    near = entries.withColumn("part", part).select(
        "key", "hot", "part", "g", "n", "at", "s", F.lag(row).over(order).alias("prev"), F.lead("g").over(order).alias("next"),
        F.first(row).over(order).alias("head"),
    ).where("prev IS NOT NULL OR next IS NOT NULL OR hot > 0")  # a shingle of one group joins nothing

    def distance(other: Column) -> Column:
        own = {"n": F.col("n"), "s": F.col("s")}
        fits = (
            (other["g"] != F.col("g"))
            & _sizes_fit(F.col("n"), other["n"], percent)
            & _places_fit(F.col("n"), F.col("at"), other["n"], other["at"], percent)
            & _parities_fit(own, other, percent, _apart_by_64)
        )
        return F.when(fits, F.struct((_apart_by_64(own, other) + other["at"]).alias("d"), other["g"].alias("to")))

    near = written(
        near.select(
            "key", "hot", "part", "g", "n", "at", "s", distance(F.col("prev")).alias("by_prev"), distance(F.col("head")).alias("by_head")
        )
    )
    # The heads of a hot shingle's parts are compared with the first of them all.
    hot = near.where("hot > 0")
    first = hot.groupBy("key").agg(F.min(F.struct("at", "n", "g", "s")).alias("top"))
    part_heads = hot.groupBy("key", "part").agg(F.min(F.struct("at", "n", "g", "s")).alias("h")).select("key", "h.*")
    across = part_heads.join(first, "key").select("g", distance(F.col("top")).alias("c"))
    choices = near.select("g", F.explode(F.array("by_prev", "by_head")).alias("c")).unionByName(across).where("c IS NOT NULL")
    best = choices.groupBy("g").agg(F.min("c").alias("c")).select(F.col("g").alias("a"), F.col("c.to").alias("b"))
    of_leader = members.where("g = cid").select(F.col("g").alias("_g"), F.struct("n", "p").alias("l"))
    inside = members.where("g != cid").join(of_leader, F.col("g") == F.col("_g"))
    inside = inside.where(_parities_fit({c: F.col(c) for c in ("n", "p")}, F.col("l"), percent))
    pairs = best.unionByName(inside.select(F.col("g").alias("a"), F.col("cid").alias("b")))
    edges = verified(_ordered(pairs), marks, docs, size, percent)
    # An id with several texts is one node.
    named = usable.select("doc_id", "set_id").join(classes.select("set_id", "cid"), "set_id").select("doc_id", "cid").distinct()
    several = named.groupBy("doc_id").agg(F.count("*").alias("_k"), F.min("cid").alias("_c")).where("_k > 1")
    own_edges = named.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    known = written(components(edges.unionByName(own_edges)))

    # All pairs of groups that still lie in different components.
    label = known.select(F.col("node").alias("cid"), "component")
    placed = written(
        members.join(label, "cid", "left").select("g", "cid", "n", "p", F.coalesce("component", "cid").alias("c"))
    )
    # A group's parities are those of its member, if it has only one; they spare an expansion that cannot succeed.
    parts = placed.groupBy("g", "c").agg(F.when(F.count("*") == 1, F.first("p")).alias("p"))
    buckets = near.select("key", "g", "n", "at").join(parts, "g")
    counts = buckets.groupBy("key", "c").agg(F.count("*").alias("k"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("_n"), F.max_by("c", F.struct("k", "c")).alias("main")).where("_n > 1")
    mixed = written(buckets.join(mixed.select("key", "main"), "key"))
    # Rows outside the main component of their shingle meet all rows of other components.
    minor = mixed.where("c != main").select("key", *(F.col(x).alias(f"{x}_1") for x in ("g", "n", "at", "c", "p")))
    ours, others = {"n": F.col("n_1"), "p": F.col("p_1")}, {"n": F.col("n"), "p": F.col("p")}
    met = minor.join(mixed, "key").where(
        (F.col("c_1") != F.col("c"))
        & _sizes_fit(F.col("n_1"), F.col("n"), percent)
        & _places_fit(F.col("n_1"), F.col("at_1"), F.col("n"), F.col("at"), percent)
        & F.coalesce(_parities_fit(ours, others, percent), F.lit(True))
    )
    groups = met.select("g_1", "c_1", "g", "c").distinct()
    split = placed.groupBy("g").agg(F.count_distinct("c").alias("_n")).where("_n > 1").select("g")
    own = placed.join(split, "g").select("g", "c").distinct()
    within = own.select(F.col("g").alias("g_1"), F.col("c").alias("c_1")).join(own, F.col("g_1") == F.col("g")).where("c_1 < c")
    groups = groups.unionByName(within.select("g_1", "c_1", "g", "c"))
    left = placed.select(
        F.col("g").alias("g_1"), F.col("c").alias("c_1"), F.struct("cid", "n", "p").alias("m_1")
    )
    right = placed.select("g", "c", F.struct("cid", "n", "p").alias("m"))
    expanded = groups.join(left, ["g_1", "c_1"]).join(right, ["g", "c"]).where(_parities_fit(F.col("m_1"), F.col("m"), percent))
    crossing = verified(
        _ordered(expanded.select(F.col("m_1.cid").alias("a"), F.col("m.cid").alias("b"))), marks, docs, size, percent
    )
    named_c = placed.select(F.col("cid").alias("_id"), "c")
    between = crossing.join(named_c, F.col("a") == F.col("_id")).select("b", F.col("c").alias("c_a"))
    between = between.join(named_c, F.col("b") == F.col("_id")).select(F.col("c_a").alias("a"), F.col("c").alias("b"))
    merged = written(components(between))
    final = placed.select("cid", "c").join(merged, F.col("c") == F.col("node"), "left")
    final = final.select("cid", F.coalesce("component", "c").alias("component")).distinct()
    by_set = classes.select("set_id", "cid").join(final, "cid").select("set_id", "component")
    of_rows = signed.select("doc_id", "n", F.when(F.expr("doc_id IS NOT NULL AND n > 0"), F.col("set_id")).alias("set_id"))
    found = of_rows.join(by_set, "set_id", "left")
    return written(
        found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )


def one_of_each_group(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, of which no linked document has a smaller id; one row of those with one id.

    Of rows with one id the first by text stays. Documents without words and rows without an id stay.
    """
    found = linked_components(docs, size=size, percent=percent)
    # Whatever the caller's columns are called, these names are none of them.
    mark = free_name(docs, "gone")
    gone = written(found.where("component_id < doc_id").select(F.col("doc_id").alias(mark)).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, F.col("doc_id") == F.col(mark), "left_anti")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark))
    repeated = written(repeated)
    if repeated.isEmpty():
        return kept
    order = W.partitionBy("doc_id").orderBy("text", F.xxhash64(*[F.col(c) for c in docs.columns]))
    some = kept.join(repeated, F.col("doc_id") == F.col(mark), "left_semi")
    first = some.withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).drop(mark)
    return kept.join(repeated, F.col("doc_id") == F.col(mark), "left_anti").unionByName(first)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


@query("op8_grouped_prefix_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))
