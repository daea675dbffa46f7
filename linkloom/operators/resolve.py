"""Merging mentions into entities, linking entities that occur together or look alike.

Mentions stay long (one row per sighting) until they are aggregated, and an entity keeps counts of its evidence instead
of the list: a value seen in a third of all observations is then an ordinary row. The list itself is the provenance
table.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from linkloom.functions import values
from linkloom.operators.matching import ratios
from linkloom.session import cut_lineage

FUZZY_TYPES = ["Organization", "Person", "Username"]
SIMILARITY = 0.85
BLOCK_SIZE = 2000
EPS = 1e-9
UUID = r"^(?i)(?:urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def _merged_properties(rows: DataFrame, keys: list[str], order: list[Column], fill_empty: bool) -> DataFrame:
    """Per key columns, the first value of every property."""
    named = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    pairs = rows.select(*keys, *named, F.explode("properties").alias("_k", "_v"))
    if fill_empty:
        pairs = pairs.where(F.col("_v") != "")
    rank = F.struct(*[F.col(f"_o{i}") for i in range(len(order))], F.col("_v"))
    first = pairs.groupBy(*keys, "_k").agg(F.min_by("_v", rank).alias("_v"))
    return first.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("properties")
    )


def resolve_exact(mentions: DataFrame, fill_empty: bool = False) -> DataFrame:
    """One entity per (investigation, id): highest confidence, widest time span, all sources, first property values.

    The distinct count makes Spark aggregate by (id, observation) first, so a hot id is spread before it is merged.
    ``fill_empty`` lets a later value replace an empty one.
    """
    keys = ["investigation_id", "id"]
    merged = mentions.groupBy(*keys).agg(
        F.min("type").alias("type"),
        F.min("value").alias("value"),
        F.max("confidence").alias("confidence"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count_distinct("observation_id").alias("evidence_count"),
    )
    properties = _merged_properties(
        mentions, keys, [F.col("seen_at"), F.col("observation_id")], fill_empty
    )
    return _entity_columns(merged.join(properties, keys, "left"))


def _entity_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "id",
        "investigation_id",
        "type",
        "value",
        "confidence",
        "first_seen",
        "last_seen",
        F.size("sources").alias("source_count"),
        "sources",
        "evidence_count",
        F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )


def resolve_normalized(ents: DataFrame, prov: DataFrame | None = None) -> DataFrame:
    """Merges entities of one investigation, type and value; the id with the highest confidence stays.

    ``prov`` (entity_id, observation_id, investigation_id) lets merged entities count shared evidence once.
    """
    keys = ["investigation_id", "type", "value"]
    best = F.struct(-F.col("confidence"), F.col("id"))
    merged = ents.groupBy(*keys).agg(
        F.min_by("id", best).alias("id"),
        F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.sum("evidence_count").alias("evidence_count"),
        F.map_from_entries(F.array_sort(F.map_entries(F.min_by("properties", best)))).alias("properties"),
        F.count("*").alias("_ids"),
    )
    # Few entities have several ids. Only theirs are joined again; they are written, so that Spark knows how few.
    merged = cut_lineage(merged)
    several = cut_lineage(merged.where(F.col("_ids") > 1).select(*keys, F.col("id").alias("_kept")))
    rows = cut_lineage(ents.join(several, keys).select(*keys, "id", "_kept", "confidence", "properties"))
    properties = _merged_properties(rows, keys, [-F.col("confidence"), F.col("id")], False)
    out = merged.where(F.col("_ids") > 1).drop("properties").join(properties, keys, "left")
    if prov is not None:
        recount = (
            rows.select("investigation_id", F.col("id").alias("entity_id"), "_kept")
            .join(prov, ["investigation_id", "entity_id"])
            .groupBy("investigation_id", F.col("_kept").alias("id"))
            .agg(F.count_distinct("observation_id").alias("_evidence"))
        )
        out = out.join(recount, ["investigation_id", "id"], "left").withColumn(
            "evidence_count", F.coalesce("_evidence", "evidence_count")
        )
    return _entity_columns(merged.where(F.col("_ids") == 1)).unionByName(_entity_columns(out))


def entity_provenance(mentions: DataFrame, uuid_only: bool = True, once: bool = False) -> DataFrame:
    """Which observation an entity comes from, each pair once. Blank ids and, by default, non-UUID ids are left out.

    ``once`` says that an investigation has each pair once already. Then only the observations that several
    investigations have are grouped.
    """
    ok = F.coalesce(F.col("observation_id"), F.lit("")) != ""
    if uuid_only:
        ok = ok & F.col("observation_id").rlike(UUID)
    rows = mentions.where(ok).select(
        F.col("id").alias("entity_id"), "observation_id", "investigation_id", F.col("seen_at").alias("created_at")
    )

    def grouped(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("entity_id", "observation_id").agg(
            F.min("investigation_id").alias("investigation_id"), F.min("created_at").alias("created_at")
        )

    if not once:
        return grouped(rows)
    # A hash stands for the observation here: one that two observations share only has more rows grouped.
    inv, mark = F.struct("investigation_id"), F.xxhash64("observation_id").alias("_mark")
    spans = rows.groupBy(mark).agg(F.min(inv).alias("_low"), F.max(inv).alias("_high"))
    shared = cut_lineage(spans.where(~F.col("_low").eqNullSafe(F.col("_high"))).select("_mark"))
    marked = rows.withColumn("_mark", mark)
    alone = marked.join(shared, "_mark", "left_anti").drop("_mark")
    return alone.unionByName(grouped(marked.join(shared, "_mark", "left_semi")))


# --- edges -------------------------------------------------------------------------------------------------------


def merge_relationships(*edge_tables: DataFrame) -> DataFrame:
    """One relationship per (investigation, id): highest confidence, distinct evidence counted.

    Method and time come from the first table that has the edge, inside a table from the earliest sighting.
    """
    tables = [t.withColumn("_table", F.lit(i)) for i, t in enumerate(edge_tables)]
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    first = F.struct("_table", "seen_at", "observation_id", "method")
    return rows.groupBy("investigation_id", "id").agg(
        F.min("source_id").alias("source_id"),
        F.min("target_id").alias("target_id"),
        F.min("relationship_type").alias("relationship_type"),
        F.max("confidence").alias("confidence"),
        F.count_distinct("observation_id").alias("evidence_count"),
        F.min_by("seen_at", first).alias("discovered_at"),
        F.min_by("method", first).alias("method"),
    )


def edges_bidi(rels: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    rows = rels.select(
        "investigation_id",
        F.explode(
            F.array(
                F.struct(F.col("source_id").alias("from_id"), F.col("target_id").alias("to_id")),
                F.struct(F.col("target_id").alias("from_id"), F.col("source_id").alias("to_id")),
            )
        ).alias("e"),
    )
    return rows.select("e.from_id", "e.to_id", "investigation_id")


# --- co-occurrence -----------------------------------------------------------------------------------------------


def member_pairs(members: DataFrame, group: list[str], member: str, block_size: int = BLOCK_SIZE) -> DataFrame:
    """All unordered pairs of distinct members of a group, as ``id_a`` < ``id_b``.

    A group larger than ``block_size`` is cut into blocks and joined block by block, so the pairs of one large group
    are made by many tasks. Nothing is left out.
    """
    sized = members.join(members.groupBy(*group).agg(F.count("*").alias("_n")).where("_n > 1"), group)
    blocks = F.ceil(F.col("_n") / block_size).cast("int")
    placed = sized.withColumn("_blocks", blocks).withColumn(
        "_b", F.pmod(F.xxhash64(member), F.col("_blocks").cast("bigint")).cast("int")
    )
    left = placed.select(
        *group, F.col(member).alias("_x"), F.col("_b").alias("_i"),
        F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_j"),
    )
    right = placed.select(
        *group, F.col(member).alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"),
        F.col("_b").alias("_j"),
    )
    joined = left.join(right, [*group, "_i", "_j"]).where(
        ((F.col("_i") < F.col("_j")) & (F.col("_x") != F.col("_y"))) | (F.col("_x") < F.col("_y"))
    )
    return joined.select(*group, F.least("_x", "_y").alias("id_a"), F.greatest("_x", "_y").alias("id_b"))


#: Pairs that one cell of a dense investigation should hold, and fewer than which an investigation is not cut into cells.
CELL_PAIRS = 4_000_000
FEW_PAIRS = 100_000
PAIRS_AT_ONCE = 1_000_000
MOST_CELL_TASKS = 10_000
_COUNTED = (
    "investigation_id string, id_a string, id_b string, shared bigint, observation_id string, n_a bigint, n_b bigint"
)


def _cell_pairs(cell: pa.Table) -> pa.Table:
    """The pairs of entities of two blocks that share observations, counted in one table of both blocks, in order of their
    names. Rows with ``_names`` list the entities of a block by name, the others which of them an observation has."""
    i, j = cell["_i"][0].as_py(), cell["_j"][0].as_py()
    listed = cell.filter(cell["_names"].is_valid())
    named = dict(zip(listed["_b"].to_pylist(), range(len(listed)), strict=True))
    entities = {b: listed["_names"].slice(k, 1).combine_chunks().flatten() for b, k in named.items()}
    cell = cell.filter(cell["_members"].is_valid())
    lists = cell["_members"].combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    observation = cell["observation_id"].combine_chunks().dictionary_encode()
    names = observation.dictionary.take(pc.array_sort_indices(observation.dictionary))
    rank = np.empty(len(names), np.int64)
    rank[pc.array_sort_indices(observation.dictionary).to_numpy()] = np.arange(len(names))
    seen = np.repeat(rank[observation.indices.to_numpy()], sizes)
    block = np.repeat(cell["_b"].to_numpy(), sizes)

    def side(of: int) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
        """Entities of a block; observation and position among them of each membership, by observation."""
        mine = np.flatnonzero(block == of)
        mine = mine[np.argsort(seen[mine], kind="stable")]
        return entities.get(of, listed["_names"].combine_chunks().flatten().slice(0, 0)), seen[mine], flat[mine]

    left, left_seen, left_place = side(i)
    right, right_seen, right_place = side(j)
    shared = np.zeros(len(left) * len(right), np.int32)
    first = np.full(len(shared), len(names), np.int32)
    low = np.searchsorted(right_seen, left_seen, "left")
    many = np.searchsorted(right_seen, left_seen, "right") - low
    # A slice of memberships on the left with all that they meet on the right, about a million pairs at a time.
    ends = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "left")
    cuts = np.unique(np.concatenate([[0], ends, [len(many)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = many[a:b]
        behind = np.cumsum(n) - n
        met = np.arange(int(n.sum())) + np.repeat(low[a:b] - behind, n)
        cells = np.repeat(left_place[a:b].astype(np.int64) * len(right), n) + right_place[met]
        np.add.at(shared, cells, 1)
        np.minimum.at(first, cells, np.repeat(left_seen[a:b], n).astype(np.int32))
    at = np.flatnonzero(shared)
    x, y = np.divmod(at, max(1, len(right)))
    if i == j:
        once = x < y
        at, x, y = at[once], x[once], y[once]
    # Pairs in order of their names lie together in what is written of them.
    both = pa.concat_arrays([left.field("entity_id"), right.field("entity_id")])
    total = np.concatenate([left.field("_n").to_numpy(), right.field("_n").to_numpy()])
    by_name = pc.array_sort_indices(both).to_numpy()
    order = np.empty(len(both), np.int64)
    order[by_name] = np.arange(len(both))
    a, b = order[x], order[len(left) + y]
    a, b = np.minimum(a, b), np.maximum(a, b)
    sort = np.argsort(a * len(both) + b)
    at, a, b = at[sort], by_name[a[sort]], by_name[b[sort]]
    return pa.table(
        {
            "investigation_id": pa.repeat(cell["investigation_id"][0] if len(cell) else listed["investigation_id"][0], len(a)),
            "id_a": both.take(pa.array(a)),
            "id_b": both.take(pa.array(b)),
            "shared": shared[at].astype(np.int64),
            "observation_id": names.take(pa.array(first[at])),
            "n_a": total[a],
            "n_b": total[b],
        }
    )


def _dense_pairs(members: DataFrame, block_size: int) -> tuple[DataFrame, DataFrame]:
    """Counted pairs of the investigations in which an entity meets more others than there are blocks of entities, and
    the names of these investigations.

    Two blocks of entities make a cell. Each cell is sent the names and memberships of both and counts its pairs where they
    are made, so what is shuffled are memberships, as places among the names, once for each block, and never the pairs. The number of blocks keeps a
    cell to about ``CELL_PAIRS`` pairs and a table of ``block_size`` squared; that an entity meets more others than there
    are blocks also bounds the memberships of a cell.
    """
    inv = "investigation_id"
    sizes = members.groupBy(inv, "observation_id").agg(F.count("*").alias("n"))
    pairs = sizes.groupBy(inv).agg(F.sum("n").alias("members"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    entities = members.groupBy(inv, "entity_id").agg(F.max("_n")).groupBy(inv).agg(F.count("*").alias("entities"))
    blocks = F.ceil(F.greatest(F.sqrt(F.col("pairs") * 2 / CELL_PAIRS), F.col("entities") / block_size)).cast("int")
    dense = pairs.where(F.col("pairs") > FEW_PAIRS).join(entities, inv).withColumn("_blocks", blocks)
    dense = cut_lineage(dense.where(F.col("pairs") > F.col("members") * F.col("_blocks")).select(inv, "_blocks"))
    cells = dense.agg(F.sum(F.col("_blocks") * (F.col("_blocks") + 1) / 2).alias("n")).first()["n"] or 0
    block = F.pmod(F.xxhash64("entity_id"), F.col("_blocks").cast("bigint")).cast("int")
    placed = members.join(dense, inv).withColumn("_b", block)
    # A cell is sent the names of two blocks once; memberships are places among them.
    named = placed.groupBy(inv, "_blocks", "_b", "entity_id").agg(F.max("_n").alias("_n"))
    by_name = W.partitionBy(inv, "_blocks", "_b").orderBy("entity_id")
    named = cut_lineage(named.withColumn("_at", F.row_number().over(by_name) - 1))
    lists = placed.join(named.select(inv, "entity_id", "_at"), [inv, "entity_id"]).groupBy(
        inv, "observation_id", "_blocks", "_b"
    ).agg(F.array_sort(F.collect_list("_at")).alias("_members"))
    # Spark sorts lists of structs by the first field, the place.
    names = F.transform(F.array_sort(F.collect_list(F.struct("_at", "entity_id", "_n"))), lambda e: F.struct(e["entity_id"], e["_n"]))
    blocks_of = named.groupBy(inv, "_blocks", "_b").agg(names.alias("_names"))
    told = lists.unionByName(blocks_of, allowMissingColumns=True)
    sent = told.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        inv, F.least("_b", "_k").alias("_i"), F.greatest("_b", "_k").alias("_j"), "_b", "observation_id", "_members", "_names"
    )
    # Memberships are few beside the pairs that they make, so tasks are dealt by number.
    tasks = max(1, min(int(cells), MOST_CELL_TASKS))
    found = sent.repartition(tasks, inv, "_i", "_j").groupBy(inv, "_i", "_j").applyInArrow(_cell_pairs, _COUNTED)
    return found, dense.select(inv)


def co_occurrences(memberships: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Edges between entities that share observations.

    ``memberships``: investigation_id, observation_id, entity_id. Confidence is 1.5 times the Jaccard overlap of the
    two observation sets, kept between 0.3 and 0.9.
    """
    known = cut_lineage(memberships.select("investigation_id", "observation_id", "entity_id").distinct())
    totals = known.groupBy("investigation_id", "entity_id").agg(F.count("*").alias("_n"))
    members = known.where("observation_id IS NOT NULL").join(totals, ["investigation_id", "entity_id"])
    dense, of = _dense_pairs(members, block_size)
    others = known.join(of, "investigation_id", "left_anti")
    pairs = member_pairs(others, ["investigation_id", "observation_id"], "entity_id", block_size)
    shared = pairs.groupBy("investigation_id", "id_a", "id_b").agg(
        F.count("*").alias("shared"), F.min("observation_id").alias("observation_id")
    )
    a = totals.select("investigation_id", F.col("entity_id").alias("id_a"), F.col("_n").alias("n_a"))
    b = totals.select("investigation_id", F.col("entity_id").alias("id_b"), F.col("_n").alias("n_b"))
    counted = shared.join(a, ["investigation_id", "id_a"]).join(b, ["investigation_id", "id_b"]).unionByName(dense)
    overlap = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return counted.select(
        "investigation_id",
        F.concat_ws(":", "id_a", F.lit("co_occurs_with"), "id_b").alias("id"),
        F.col("id_a").alias("source_id"),
        F.col("id_b").alias("target_id"),
        F.lit("co_occurs_with").alias("relationship_type"),
        F.greatest(F.lit(0.3), F.least(F.lit(0.9), overlap * 1.5)).alias("confidence"),
        "observation_id",
        F.lit("co_occurrence").alias("method"),
        "shared",
    )


# --- similar names -----------------------------------------------------------------------------------------------


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(ratios(a, b), dtype="float64")


def _grams(name: Column) -> Column:
    """Pairs of neighbouring characters, numbered by occurrence."""
    n = F.length(name)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: name.substr(i, F.lit(2))))
    pairs = F.coalesce(pairs, F.array().cast("array<string>"))
    return F.transform(
        pairs,
        lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda d: d == g)).cast("string")),
    )


def _odd_characters(name: Column) -> Column:
    """For each of 64 classes of characters, whether the name has an odd number of them. Names differ in no more classes
    than they have unmatched characters."""
    one = F.lit(1).cast("bigint")

    def bit(c: Column) -> Column:
        return F.call_function("shiftleft", one, F.pmod(F.xxhash64(c), F.lit(64).cast("bigint")).cast("int"))

    return F.aggregate(F.split(name, ""), F.lit(0).cast("bigint"), lambda odd, c: odd.bitwiseXOR(bit(c)))


def _slack(la: Column, lb: Column, t: float) -> Column:
    """Most characters that can stay unmatched in names of lengths la <= lb; what the lengths differ by is one part, the
    rest falls on both alike."""
    most = F.floor((1 - t) * (la + lb) + 1e-9).cast("int")
    return most - F.pmod(most - (lb - la), F.lit(2))


def _least_grams(x: Column, y: Column, t: float) -> Column:
    """Grams that names of these lengths share at least: the matched characters, less one for each matched block."""
    la, lb = F.least(x, y), F.greatest(x, y)
    most = _slack(la, lb, t)
    return ((la + lb - most) / 2).cast("int") - most - 1


#: Variants of a name, with characters left out, up to which names meet by them.
MOST_VARIANTS = 400


def _left_out(la: Column, lb: Column, t: float) -> tuple[Column, Column]:
    """How many characters to leave out of names of lengths la <= lb, so that what is left of similar ones is equal."""
    most, more = _slack(la, lb, t), lb - la
    return ((most - more) / 2).cast("int"), ((most + more) / 2).cast("int")


def _few_variants(x: Column, y: Column, t: float) -> Column:
    """Whether names of these lengths meet by variants: few characters are left out of short names."""
    la, lb = F.least(x, y), F.greatest(x, y)

    def count(n: Column, k: Column) -> Column:
        ways = F.when(k == 0, 1).when(k == 1, n).when(k == 2, n * (n - 1) / 2).when(k == 3, n * (n - 1) * (n - 2) / 6)
        return ways.otherwise(MOST_VARIANTS + 1)

    a, b = _left_out(la, lb, t)
    return (a >= 0) & (count(la, a) <= MOST_VARIANTS) & (count(lb, b) <= MOST_VARIANTS)


def _variants(name: Column, k: Column) -> Column:
    """All texts that are left when k characters, at most three, are taken out of a name."""

    def shorter(texts: Column) -> Column:
        each = F.transform(
            texts,
            lambda v: F.transform(
                F.sequence(F.lit(1), F.length(v)),
                lambda i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v))),
            ),
        )
        return F.array_distinct(F.flatten(each))

    none = F.array(name)
    one = shorter(none)
    two = shorter(one)
    return F.when(k == 0, none).when(k == 1, one).when(k == 2, two).otherwise(shorter(two))


def _variant_pairs(names: DataFrame, kind: list[str], t: float) -> DataFrame:
    """Pairs of short names (id_a < id_b, a, b), each once, of which equal texts are left when the characters that may stay
    unmatched are taken out: similar names have a common part of that length. Work grows with the names, not with the
    pairs of names that share a gram, as numbered names all do."""
    n = F.col("n")

    def side(id_name: str, text: str, own: str, other: str, partners: Column, k: int) -> DataFrame:
        rows = names.select(
            *kind, F.col("id").alias(id_name), F.col("name").alias(text), n.alias(own), F.explode(partners).alias(other)
        )
        rows = rows.withColumn("_v", F.explode(_variants(F.col(text), _left_out(F.col("la"), F.col("lb"), t)[k])))
        return rows.withColumn("_key", F.xxhash64(*kind, "la", "lb", "_v")).drop("_v", "la", "lb")

    longer = F.filter("_have", lambda m: (m >= n) & _few_variants(n, m, t))
    shorter = F.filter("_have", lambda m: (m <= n) & _few_variants(m, n, t))
    short = side("id_s", "s", "la", "lb", longer, 0)
    long = side("id_l", "l", "lb", "la", shorter, 1).withColumnsRenamed({c: f"_{c}" for c in kind})
    # Names of one length meet in both roles.
    same = reduce(and_, [F.col(c) == F.col(f"_{c}") for c in kind])
    met = short.join(long, "_key").where(
        same & ((F.col("id_s") < F.col("id_l")) | ((F.col("id_s") != F.col("id_l")) & (F.length("s") != F.length("l"))))
    )
    first = F.col("id_s") < F.col("id_l")
    return met.select(
        *kind,
        F.least("id_s", "id_l").alias("id_a"), F.greatest("id_s", "id_l").alias("id_b"),
        F.when(first, F.col("s")).otherwise(F.col("l")).alias("a"),
        F.when(first, F.col("l")).otherwise(F.col("s")).alias("b"),
    ).distinct()


def _pieces(length: Column, parts: Column, index: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of piece ``index`` when a text is cut into ``parts`` even pieces."""
    start = F.floor(length * index / parts)
    return start, F.floor(length * (index + 1) / parts) - start


def _gram_pairs(names: DataFrame, kind: list[str], t: float) -> DataFrame:
    """Pairs of names (id_a < id_b, a, b) that a shared gram guarantees to find, each pair once.

    The prefix of a name is so many of its grams, rare ones first, that two names that are similar enough have a common
    one in their prefixes. The names that have a gram in their prefix meet block by block, so a gram that all names share
    is compared by many tasks; a pair that the edit distance allows counts at the first of its common grams.
    """
    n = F.col("n")
    longest = F.floor(n * (2 - t) / t + EPS).cast("int")
    shortest = F.greatest(F.lit(1), F.ceil(n * t / (2 - t) - EPS).cast("int"))
    # Lengths of partners that share a gram for sure. The prefix is long enough for the one that shares the fewest.
    lengths = F.filter(
        F.sequence(shortest, longest),
        lambda m: F.array_contains("_have", m) & (_least_grams(n, m, t) >= 1) & ~_few_variants(n, m, t),
    )
    able = names.withColumn("lengths", lengths).where(F.size("lengths") > 0)
    fewest = F.array_min(F.transform("lengths", lambda m: _least_grams(n, m, t)))
    grams = able.select(*kind, "id", "name", "n", "lengths", (n - fewest).alias("_take"), F.explode(_grams(F.col("name"))).alias("gram"))
    frequency = grams.groupBy(*kind, "gram").agg(F.count("*").alias("_f"))
    by_name = grams.join(frequency, [*kind, "gram"]).groupBy(*kind, "id", "name", "n", "lengths", "_take").agg(
        F.array_sort(F.collect_list(F.struct("_f", "gram"))).alias("_all")
    )
    prefix = F.transform(F.slice("_all", F.lit(1), F.col("_take")), lambda g: g["gram"])
    odd = _odd_characters(F.col("name"))
    entries = by_name.select(*kind, "id", "name", "n", "lengths", odd.alias("odd"), prefix.alias("prefix"))
    entries = entries.withColumn("gram", F.explode("prefix"))
    entries = cut_lineage(entries)
    held = entries.groupBy(*kind, "gram").agg(F.count("*").alias("_held")).where("_held > 1")
    blocks = F.ceil(F.col("_held") / BLOCK_SIZE).cast("int")
    placed = entries.join(held, [*kind, "gram"]).withColumn("_blocks", blocks).withColumn(
        "_b", F.pmod(F.xxhash64("id"), F.col("_blocks").cast("bigint")).cast("int")
    )
    row = ["id", "name", "n", "lengths", "odd", "prefix"]
    left = placed.select(
        *kind, "gram", F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_blocks") - 1)).alias("_j"),
        *[F.col(c).alias(f"_l_{c}") for c in row],
    )
    right = placed.select(
        *kind, "gram", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"),
        *[F.col(c).alias(f"_r_{c}") for c in row],
    )
    # A short condition: the code that Spark makes of a long one is not compiled. The number of odd classes of both names
    # is even or odd as the sum of their lengths is, so the exact bound for it needs no more than this.
    both = F.col("_l_n") + F.col("_r_n")
    cap = F.floor(both * F.lit(1 - t) + EPS)
    most = cap - F.pmod(cap - both, F.lit(2))
    # Entries are few beside the pairs that they make, so tasks are dealt by number, not by the size of the entries.
    on = [*kind, "gram", "_i", "_j"]
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, *on), right.repartition(tasks, *on)
    met = left.join(right.hint("shuffle_hash"), on).where(
        (((F.col("_i") < F.col("_j")) & (F.col("_l_id") != F.col("_r_id"))) | (F.col("_l_id") < F.col("_r_id")))
        & (F.bit_count(F.col("_l_odd").bitwiseXOR(F.col("_r_odd"))) <= cap)
        & F.array_contains("_l_lengths", F.col("_r_n"))
        & (F.levenshtein("_l_name", "_r_name") <= most)
    )
    once = met.where(F.get(F.array_intersect("_l_prefix", "_r_prefix"), F.lit(0)) == F.col("gram"))
    first = F.col("_l_id") < F.col("_r_id")
    return once.select(
        *kind,
        F.least("_l_id", "_r_id").alias("id_a"), F.greatest("_l_id", "_r_id").alias("id_b"),
        F.when(first, F.col("_l_name")).otherwise(F.col("_r_name")).alias("a"),
        F.when(first, F.col("_r_name")).otherwise(F.col("_l_name")).alias("b"),
    )


def _piece_pairs(names: DataFrame, kind: list[str], t: float) -> DataFrame:
    """Pairs of names (id_a < id_b, a, b) of lengths that guarantee no shared gram, each pair once: one of u + 1 pieces of
    the shorter name stands unchanged in the longer one, moved by no more than the u unmatched characters allow."""
    n = F.col("n")
    longest = F.floor(n * (2 - t) / t + EPS).cast("int")
    shortest = F.greatest(F.lit(1), F.ceil(n * t / (2 - t) - EPS).cast("int"))
    la, lb, u = F.col("la"), F.col("lb"), F.col("_u")
    short = (
        names.select(*kind, F.col("id").alias("id_s"), F.col("name").alias("s"), n.alias("la"),
                     F.explode(F.array_intersect(F.sequence(n, longest), "_have")).alias("lb"))
        .where((_least_grams(la, lb, t) < 1) & ~_few_variants(la, lb, t))
        .withColumn("_u", _slack(la, lb, t))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), u)))
    )
    start, size = _pieces(la, u + 1, F.col("piece"))
    short = short.select(
        *kind, "id_s", "s", "la", "lb", "piece", F.substring("s", (start + 1).cast("int"), size.cast("int")).alias("part")
    )
    long = (
        names.select(*kind, F.col("id").alias("id_l"), F.col("name").alias("l"), n.alias("lb"),
                     F.explode(F.array_intersect(F.sequence(shortest, n), "_have")).alias("la"))
        .where((_least_grams(la, lb, t) < 1) & ~_few_variants(la, lb, t))
        .withColumn("_u", _slack(la, lb, t))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), u)))
    )
    extra = lb - la
    low = F.greatest(F.lit(0), start - F.floor((u - extra) / 2))
    high = F.least(lb - size, start + F.floor((u + extra) / 2))
    long = (
        long.where(u >= extra)
        .withColumns({"_low": low, "_high": high, "_size": size.cast("int")})
        .where(F.col("_low") <= F.col("_high"))
        .withColumn("_at", F.explode(F.sequence("_low", "_high")))
        .select(
            *kind, "id_l", "l", "la", "lb", "piece",
            F.substring("l", (F.col("_at") + 1).cast("int"), F.col("_size")).alias("part"),
        )
        .distinct()
    )
    met = short.join(long, [*kind, "la", "lb", "piece", "part"]).where(
        (F.col("id_s") != F.col("id_l")) & (F.levenshtein("s", "l") <= _slack(la, lb, t))
    )
    first = F.col("id_s") < F.col("id_l")
    return met.select(
        *kind,
        F.least("id_s", "id_l").alias("id_a"), F.greatest("id_s", "id_l").alias("id_b"),
        F.when(first, F.col("s")).otherwise(F.col("l")).alias("a"),
        F.when(first, F.col("l")).otherwise(F.col("s")).alias("b"),
    ).distinct()


def similar_entities(
    ents: DataFrame, threshold: float = SIMILARITY, normalize: bool = False, types: list[str] | None = None
) -> DataFrame:
    """Pairs of entities of one investigation and type whose names are at least ``threshold`` alike.

    Candidates come from equi-joins that lose no pair. A ratio of t over lengths la <= lb leaves at most
    u = (1 - t)(la + lb) unmatched characters. Short names meet by what is left when these are taken out; of longer ones
    at least so many grams are shared, and names meet by grams; where lengths and threshold guarantee none, by pieces. Only
    lengths that names of the kind have count. The edit distance bounds the ratio from above, since a replaced
    character counts once there and twice among the unmatched ones: it is compared where names meet, before pairs are
    kept, and few pairs are left for the exact ratio (``operators.matching``).
    """
    text = values.comparison_key(F.col("type"), F.col("value")) if normalize else F.col("value")
    names = (
        ents.where(F.col("type").isin(types or FUZZY_TYPES))
        .select("investigation_id", "type", "id", F.lower(text).alias("name"))
        .where(F.col("name") != "")
        .withColumn("n", F.length("name"))
    )
    # Names are written: the rule that makes one would run again for every gram that is cut out of it.
    names = cut_lineage(names)
    kind = ["investigation_id", "type"]
    names = names.join(names.groupBy(*kind).agg(F.collect_set("n").alias("_have")), kind)
    pairs = _gram_pairs(names, kind, threshold).unionByName(_piece_pairs(names, kind, threshold))
    pairs = pairs.unionByName(_variant_pairs(names, kind, threshold))
    scored = pairs.withColumn("similarity", _ratio("a", "b"))
    return scored.where(F.col("similarity") >= threshold).select(*kind, "id_a", "id_b", "similarity")


def similarity_edges(pairs: DataFrame, seen_at: Column | None = None) -> DataFrame:
    """Similar pairs as co_occurs_with edges."""
    return pairs.select(
        "investigation_id",
        F.lit(None).cast("string").alias("observation_id"),
        (seen_at if seen_at is not None else F.lit(None).cast("timestamp")).alias("seen_at"),
        F.concat_ws(":", F.lit("similarity"), "id_a", "id_b").alias("id"),
        F.col("id_a").alias("source_id"),
        F.col("id_b").alias("target_id"),
        F.lit("co_occurs_with").alias("relationship_type"),
        F.col("similarity").alias("confidence"),
        F.lit("fuzzy_similarity").alias("method"),
    )


# --- repeats in time ---------------------------------------------------------------------------------------------


FINE_SLOTS = 1440


def _next_in_bucket(asks: DataFrame, have: DataFrame, bucket: list[str], place: str, value: str) -> DataFrame:
    """Adds to every ask the ``value`` of the first row of its bucket whose ``place`` is not before the ask's.

    Both sides are sorted backwards together, so the answer is simply the last row seen.
    """
    mixed = asks.withColumn("_ask", F.lit(1)).unionByName(
        have.select(*bucket, place, F.col(value).alias("_hit")).withColumn("_ask", F.lit(0)), allowMissingColumns=True
    )
    backwards = W.partitionBy(*bucket).orderBy(F.desc(place), "_ask").rowsBetween(W.unboundedPreceding, 0)
    return (
        mixed.withColumn("_hit", F.last("_hit", ignorenulls=True).over(backwards)).where(F.col("_ask") == 1).drop("_ask")
    )


def _followers(first: DataFrame, keys: list[str], span: int) -> DataFrame:
    """Every time ``_t`` of a key with ``_to``, the first time that lies ``span`` or more after it.

    Looked up in three steps, so that no task sees more than a fine slot of a key, the fine slots of a slot, or the
    slots of a key: inside the fine slot of the due time, then among later fine slots, then among later slots.
    """
    fine = max(1, span // FINE_SLOTS)
    due = F.col("_t") + span
    asks = first.select(*keys, "_t", due.alias("_at"), F.floor(due / fine).alias("_fine"))
    have = first.select(*keys, F.col("_t").alias("_at"), F.floor(F.col("_t") / fine).alias("_fine"), "_t")
    near = _next_in_bucket(asks, have, [*keys, "_fine"], "_at", "_t")
    slot = F.floor(F.col("_fine") / FINE_SLOTS)
    by_fine = have.groupBy(*keys, "_fine").agg(F.min("_t").alias("_t")).withColumn("_slot", slot)
    open_ = near.where(F.col("_hit").isNull()).select(*keys, (F.col("_fine") + 1).alias("_fine"))
    later = _next_in_bucket(
        open_.distinct().withColumn("_slot", slot), by_fine, [*keys, "_slot"], "_fine", "_t"
    )
    by_slot = by_fine.groupBy(*keys, "_slot").agg(F.min("_t").alias("_t"))
    unmet = later.where(F.col("_hit").isNull()).select(*keys, (F.col("_slot") + 1).alias("_slot"))
    last = _next_in_bucket(unmet.distinct(), by_slot, keys, "_slot", "_t")
    far = last.select(*keys, (F.col("_slot") - 1).alias("_slot"), F.col("_hit").alias("_far"))
    middle = later.join(far, [*keys, "_slot"], "left").select(
        *keys, (F.col("_fine") - 1).alias("_fine"), F.coalesce("_hit", "_far").alias("_later")
    )
    return near.join(middle, [*keys, "_fine"], "left").select(*keys, "_t", F.coalesce("_hit", "_later").alias("_to"))


def dedupe_within(obs: DataFrame, keys: list[str], time_col: str, ttl_seconds: int, id_col: str = "id") -> DataFrame:
    """Keeps an observation only when none kept before it under the same key is younger than the time to live.

    Whether a row stays depends on the row kept before it. So each time points to the first time that is old enough
    to follow it, and the times reached from the first one stay. Following the pointers by doubling takes
    log2(time range / time to live) rounds, and a key that holds a third of all rows never lands in one task.
    """
    micros = F.unix_micros(F.col(time_col).cast("timestamp"))
    span = ttl_seconds * 1_000_000
    # of rows with the same key and time, the one with the lowest id stands for all
    first = cut_lineage(obs.groupBy(*keys, micros.alias("_t")).agg(F.min(id_col).alias("_id")))
    hops = cut_lineage(_followers(first.select(*keys, "_t"), keys, span).where(F.col("_to").isNotNull()))
    kept = first.groupBy(*keys).agg(F.min("_t").alias("_t"))
    spread = first.agg(((F.max("_t") - F.min("_t")) / span + 1).alias("n")).first()["n"] or 1
    for _ in range(max(1, math.ceil(math.log2(spread + 1)))):
        reached = kept.join(hops, [*keys, "_t"]).select(*keys, F.col("_to").alias("_t"))
        kept = cut_lineage(kept.unionByName(reached).distinct())
        step = hops.select(*keys, F.col("_t").alias("_to"), F.col("_to").alias("_far"))
        hops = cut_lineage(hops.join(step, [*keys, "_to"]).select(*keys, "_t", F.col("_far").alias("_to")))
    ids = first.join(kept, [*keys, "_t"]).select(F.col("_id").alias(id_col))
    return obs.join(ids, id_col, "left_semi")
