"""Merkle manifest of a dataset, with logs in postorder and proofs taken from them.

Leaves are numbered in order inside their tree. Builders, each for an aligned block of consecutive leaves, append every
node to their log when it is complete: a leaf when it comes, an inner node right after its last leaf. Where a node stands
in such a log follows from the sizes of the subtrees before it alone (``position``), so the siblings of any leaf are
found without a search. The roots of blocks are the leaves of the next tier, until a tree has one node left; the roots
of the trees are the leaves of one more tree. Proofs are taken from the top tier down: a block's own proof is the end of
every proof inside it.
"""

from __future__ import annotations

import hashlib
from binascii import hexlify
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import query, record_batch, table, written

ARITY = 8
#: A builder's block has ARITY to this power leaves.
LEVELS = 4
SIZE = 32


def digest(nodes: bytes) -> bytes:
    """The digest of a run of digests, taken over their lowercase hex text."""
    return hashlib.sha256(hexlify(nodes)).digest()


def height(n: int) -> int:
    """How often n nodes are put together by ARITY until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def position(level: int, index: int, n: int) -> int:
    """The place from 0, in the log of a tree of n leaves, of the node with this index on this level (0: leaves).

    It is complete with leaf e - 1. All that the leaves before completed stands before it, a whole subtree of each size
    for every full run among them; and so do its descendants on its right edge, one per level.
    """
    e = min((index + 1) * ARITY**level, n)
    place, full = level, e - 1
    while full:
        place += full
        full //= ARITY
    return place


def built(leaves: list[bytes], levels: int) -> bytes:
    """The log of one block: all nodes of up to ``levels`` levels above its leaves, as they are completed."""
    log: list[bytes] = []
    pending: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def complete(node: bytes, level: int) -> None:
        log.append(node)
        pending[level].append(node)
        if level < levels and len(pending[level]) == ARITY:
            close(level)

    def close(level: int) -> None:
        run, pending[level] = pending[level], []
        complete(digest(b"".join(run)), level + 1)

    for leaf in leaves:
        complete(leaf, 0)
    for level in range(levels):
        if pending[level]:
            close(level)
    return b"".join(log)


def entries(log: bytes, n: int, levels: int) -> list[list[bytes]]:
    """For each level of a block's log, the proof entries of its nodes: a byte with the node's place in its run, one with
    the length of the run, and the digests of the others."""
    out = []
    for level in range(levels):
        count = -(-n // ARITY**level)
        at = [SIZE * position(level, k, n) for k in range(count)]
        nodes = [log[a : a + SIZE] for a in at]
        found = []
        for first in range(0, count, ARITY):
            run = nodes[first : first + ARITY]
            whole = b"".join(run)
            for own in range(len(run)):
                found.append(bytes((own, len(run))) + whole[: SIZE * own] + whole[SIZE * own + SIZE :])
        out.append(found)
    return out


def block_proofs(log: bytes, n: int, levels: int, above: bytes) -> list[bytes]:
    """The proofs of all leaves of a block; ``above`` is the proof of the block's root."""
    ends = [above]
    for found in reversed(entries(log, n, levels)):
        ends = [own + ends[k // ARITY] for k, own in enumerate(found)]
    return ends


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and the siblings of its proof give."""
    at = 0
    while at < len(proof):
        own, count = proof[at], proof[at + 1]
        middle, end = at + 2 + SIZE * own, at + 2 + SIZE * (count - 1)
        leaf = digest(proof[at + 2 : middle] + leaf + proof[middle:end])
        at = end
    return leaf


def siblings(proof: bytes) -> bytes:
    """All digests of a proof, from the leaf up, left to right."""
    out, at = [], 0
    while at < len(proof):
        end = at + 2 + SIZE * (proof[at + 1] - 1)
        out.append(proof[at + 2 : end])
        at = end
    return b"".join(out)


def encoded(value: Column, *, text: bool = False) -> Column:
    """A field of a leaf: ``-`` for null, else the number of its UTF-8 bytes, a colon, and the value."""
    value = value if text else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[f.cast("binary") for f in fields]), 256))


def numbered_leaves(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, the place of a row in its ``tree``, and n, the number of the tree's rows. No task sees a whole tree;
    rows that ``order`` cannot tell apart take neighbouring places, and spread over tasks all the same."""
    rows = rows.withColumn("_u", F.monotonically_increasing_id())
    order = [*order, "_u"]
    placed = written(rows.repartitionByRange("tree", *order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("tree", "_p").agg(F.count("*").alias("_c"))
    tree = W.partitionBy("tree").orderBy("_p")
    shifts = counts.select(
        "tree", "_p", F.coalesce(F.sum("_c").over(tree.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(tree.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"),
    )
    found = placed.withColumn("_n", F.row_number().over(W.partitionBy("tree", "_p").orderBy(*order)))
    idx = (F.col("_n") + F.col("_before") - 1).cast("bigint")
    return found.join(shifts, ["tree", "_p"]).withColumn("idx", idx).drop("_u", "_p", "_n", "_before")


LOG_DDL = "tree string, block bigint, n bigint, leaves int, log binary"
LOG = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("leaves", pa.int32()), ("log", pa.binary())])


def _block_log(nodes: DataFrame, levels: int) -> DataFrame:
    """One row per aligned block of (tree, idx, n, digest) nodes, with its log."""
    span = ARITY**levels

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        n = group.column("n")[0].as_py()
        log = built(group.column("digest").to_pylist(), min(levels, height(n)))
        tree, block = group.column("tree")[0].as_py(), group.column("block")[0].as_py()
        return pa.Table.from_pylist(
            [{"tree": tree, "block": block, "n": n, "leaves": len(group), "log": log}], schema=LOG
        )

    placed = nodes.select("tree", "idx", "n", "digest", F.expr(f"idx div {span}").alias("block"))
    return placed.groupBy("tree", "block").applyInArrow(run, LOG_DDL)


def build(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The logs of all trees of (tree, idx, n, digest) nodes, one table (tree, block, n, leaves, log) per tier. A tier's
    nodes are the roots of the blocks of the one below; trees of one block end there."""
    span = ARITY**levels
    tiers = []
    while True:
        tiers.append(written(_block_log(nodes, levels)))
        more = tiers[-1].where(F.col("n") > span)
        if more.isEmpty():
            return tiers
        nodes = more.select("tree", F.col("block").alias("idx"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), _root("log"))


def _root(log: str) -> Column:
    """The last node of a block's log is its root."""
    return F.expr(f"substring({log}, -{SIZE}, {SIZE})").alias("digest")


def tree_roots(tiers: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """(tree, digest) of every tree."""
    found = [t.where(F.col("n") <= ARITY**levels).select("tree", _root("log")) for t in tiers]
    return reduce(DataFrame.unionByName, found)


def _above(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The lowest tier's blocks (tree, block, n, log, above, and what else ``tops`` has per tree), ``above`` being the
    proof of the block's root. ``tops`` has (tree, above): the proofs of the trees' roots."""
    span = ARITY**levels
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("above", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                proofs = block_proofs(row["log"], row["leaves"], min(levels, height(row["n"])), row["above"])
                first = row["block"] * span
                columns = {
                    "tree": [row["tree"]] * len(proofs), "block": range(first, first + len(proofs)), "above": proofs,
                }
                yield record_batch(schema, columns)

    known = None
    for tier in reversed(tiers):
        ended = tier.where(F.col("n") <= span).join(tops.select("tree", "above"), "tree")
        blocks = ended if known is None else ended.unionByName(tier.join(known, ["tree", "block"]))
        if tier is tiers[0]:
            return blocks.join(tops.drop("above"), "tree")
        columns = blocks.select("tree", "block", "n", "leaves", "log", "above")
        known = written(columns.mapInArrow(run, "tree string, block bigint, above binary"))


@dataclass
class Manifest:
    """Written tables: the numbered leaves (tree, idx, n, digest, and what else the caller's rows had), the logs of the
    trees by tier, those of the tree of roots, and per tree (tree, subroot, root, above)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    roots: DataFrame
    levels: int


def manifest(rows: DataFrame, order: list[str], levels: int = LEVELS) -> Manifest:
    """Builds all trees of ``rows`` (tree string, not null; digest; columns in ``order``; others are kept), and the tree
    of their roots, in the order of ``tree`` by bytes. No rows give empty tables."""
    # Texts are read and hashed once; dealing into ranges reads its input twice.
    leaves = written(numbered_leaves(written(rows), order))
    tiers = build(leaves, levels)
    subroots = written(tree_roots(tiers, levels).withColumnRenamed("tree", "name"))
    top = written(numbered_leaves(subroots.withColumn("tree", F.lit("all")), ["name"]))
    top_tiers = build(top, levels)
    root = tree_roots(top_tiers, levels).withColumnsRenamed({"digest": "root"})
    ends = top.select("tree").distinct().select("tree", F.lit(b"").alias("above"))
    proofs = extracted(top, top_tiers, ends, levels)
    roots = proofs.join(root, "tree").select(
        F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("above")
    )
    return Manifest(leaves, tiers, top_tiers, written(roots), levels)


def extracted(leaves: DataFrame, tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """The leaves with their ``proof`` up to the end of their tree's, which ``tops`` (tree, above, others) has; the
    others come along."""
    span = ARITY**levels
    blocks = _above(tiers, tops, levels)
    extra = [f for f in tops.schema.fields if f.name not in ("tree", "above")]
    rows = leaves.withColumn("block", F.expr(f"idx div {span}"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in [*leaves.schema.fields, *extra]] + ["proof binary"]

    def run(group: pa.Table, logs: pa.Table) -> pa.Table:
        row = logs.to_pylist()[0]
        proofs = block_proofs(row["log"], row["leaves"], min(levels, height(row["n"])), row["above"])
        places = [k % span for k in group.column("idx").to_pylist()]
        out = group.drop_columns(["block"])
        for f in extra:
            column = logs.column(f.name)
            out = out.append_column(f.name, pa.array([row[f.name]] * len(group), column.type))
        return out.append_column("proof", pa.array([proofs[k] for k in places], pa.binary()))

    both = rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block"))
    return both.applyInArrow(run, ", ".join(fields))


def proofs(made: Manifest) -> DataFrame:
    """The leaves of a manifest with subroot, root and proof (see ``entries`` for its bytes, lowest level first)."""
    return extracted(made.leaves, made.tiers, made.roots, made.levels)


def log_nodes(tiers: list[DataFrame], levels: int = LEVELS) -> DataFrame:
    """Every node of the trees with its place in the whole tree's log: (tree, position, level, idx, digest)."""
    span = ARITY**levels
    schema = pa.schema(
        [("tree", pa.string()), ("position", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary())]
    )

    def run_of(tier: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    columns: dict[str, list] = {name: [] for name in schema.names}
                    for level in range(0 if tier == 0 else 1, min(levels, height(row["n"])) + 1):
                        for k in range(-(-row["leaves"] // ARITY**level)):
                            own, idx = tier * levels + level, row["block"] * ARITY ** (levels - level) + k
                            at = SIZE * position(level, k, row["leaves"])
                            node = (row["tree"], position(own, idx, row["all"]), own, idx, row["log"][at : at + SIZE])
                            for name, value in zip(schema.names, node, strict=True):
                                columns[name].append(value)
                    yield record_batch(schema, columns)

        return run

    sizes = tiers[0].groupBy("tree").agg(F.sum("leaves").alias("all"))
    ddl = "tree string, position bigint, level int, idx bigint, digest binary"
    found = [t.join(sizes, "tree").mapInArrow(run_of(k), ddl) for k, t in enumerate(tiers)]
    return reduce(DataFrame.unionByName, found)


def checked(rows: DataFrame, claimed: str) -> DataFrame:
    """Of (doc_id, digest, subroot, root, proof) rows: the digest of the proof's siblings, the root that the leaf in
    column ``claimed`` gives with them, and whether it is the root; digests as hex text."""
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.string()) for x in names), ("verified", pa.bool_())])
    ddl = "doc_id bigint, " + ", ".join(f"{x} string" for x in names) + ", verified boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proof = batch.column("proof").to_pylist()
            root = batch.column("root").to_pylist()
            back = [folded(leaf, p) for leaf, p in zip(batch.column("claimed").to_pylist(), proof, strict=True)]
            columns = {
                "doc_id": batch.column("doc_id"),
                "leaf": [x.hex() for x in batch.column("digest").to_pylist()],
                "subroot": [x.hex() for x in batch.column("subroot").to_pylist()],
                "root": [x.hex() for x in root],
                "proof_sha256": [digest(siblings(p)).hex() for p in proof],
                "folded_root": [x.hex() for x in back],
                "verified": [a == b for a, b in zip(back, root, strict=True)],
            }
            yield record_batch(schema, columns)

    return rows.select("doc_id", "digest", F.col(claimed).alias("claimed"), "subroot", "root", "proof").mapInArrow(run, ddl)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered) of ``documents`` rows: a tree per lang, null before all others; ``tampered`` is
    the leaf of the row with A-Z of its text in lower case, where 3 divides the crc32 of the id."""
    plain = [encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    digest_ = leaf_of(*plain, encoded(text, text=True))
    lower = F.translate(text, ascii_uppercase, ascii_lowercase)
    tampered = F.when(changed, leaf_of(*plain, encoded(lower, text=True))).otherwise(digest_)
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return docs.select(
        tree.alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), digest_.alias("digest"), tampered.alias("tampered")
    )


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per row of ``docs``.

    Null fields are part of a leaf; rows without an id come first in their tree and are never tampered with. Rows that
    share an id stand in the order of their leaves; repeated rows are leaves of their own, side by side. A null lang is a
    tree of its own, an empty one another. An empty table gives no rows; other columns are not read. Texts are whole and
    hashed where they are read; only digests are shuffled.
    """
    made = manifest(document_leaves(docs), ["doc_id", "digest"], levels)
    return checked(proofs(made), "tampered")


#: Levels that the SQL unrolls: trees of up to 8**7 documents, up to 8**3 languages.
_SQL_LEVELS, _SQL_TOP = 7, 3


def _sql_tree(name: str, source: str, tree: str, levels: int) -> str:
    """Tables name0, name1, ...: (tree, i, h, before, after, n), a level each; a tree of one node stays as it is."""
    out, rows = [], source
    for k in range(levels + 1):
        run = f"PARTITION BY {tree}, i // {ARITY} ORDER BY i ROWS BETWEEN"
        out.append(f"""{name}{k} AS (SELECT {tree}, i, h, count(*) OVER (PARTITION BY {tree}) AS n,
          coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
          coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {rows})""")
        rows = f"""(SELECT {tree}, i // {ARITY} AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i))
          ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {tree}, i // {ARITY})"""
    return ",\n".join(out)


def _sql_fold(name: str, source: str, tree: str, levels: int, end: str) -> str:
    """Climbs from (tree, j, proof, f) rows; ends as table ``end``."""
    out = []
    for k in range(levels):
        to = end if k == levels - 1 else f"{name}_f{k + 1}"
        out.append(f"""{to} AS (SELECT x.* REPLACE (x.j // {ARITY} AS j, CASE WHEN y.n > 1 THEN proof || before || after
          ELSE proof END AS proof, CASE WHEN y.n > 1 THEN sha256(before || f || after) ELSE f END AS f)
          FROM {source if k == 0 else f"{name}_f{k}"} x JOIN {name}{k} y ON x.{tree} = y.{tree} AND x.j = y.i)""")
    return ",\n".join(out)


def _sql_field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"


_HEAD = " || ".join(_sql_field(x) for x in ("doc_id", "source", "lang", "n_chars"))
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
    ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""
_ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({_HEAD} || {_sql_field("text")}) AS h,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN sha256({_HEAD} ||
      {_sql_field(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")}) ELSE h END AS f FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM d),
{_sql_tree("l", "r", "tree", _SQL_LEVELS)},
s AS (SELECT 'all' AS whole, tree, h, row_number() OVER (ORDER BY tree) - 1 AS i FROM l{_SQL_LEVELS}),
{_sql_tree("t", "s", "whole", _SQL_TOP)},
f0 AS (SELECT doc_id, tree, h AS leaf, i AS j, '' AS proof, f FROM r),
{_sql_fold("l", "f0", "tree", _SQL_LEVELS, "f1")},
f2 AS (SELECT f1.* REPLACE (s.i AS j), s.whole, s.h AS subroot FROM f1 JOIN s USING (tree)),
{_sql_fold("t", "f2", "whole", _SQL_TOP, "f3")}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified
FROM f3 JOIN t{_SQL_TOP} USING (whole)
"""


@query("op12_merkle_manifest", _ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))
