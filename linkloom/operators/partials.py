"""Mergeable aggregates of what observations say.

Each table holds one row per entity, property or edge of the observations it was made from; tables of different
observations merge into that of all of them, so a stream keeps these instead of its history. Evidence is counted exactly:
an observation belongs to one part only, so its counts add up.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import extract
from linkloom.session import cut_lineage

KEY = ["investigation_id", "id"]
#: How ids of the entities begin that accounts add (``accounts.account_entities``).
ACCOUNT_PREFIXES = ["username", "person", "email", "organization"]
_EDGE = ["source_id", "target_id", "relationship_type"]


@dataclass
class Partials:
    """entities and properties per entity, pairs of entity and observation, edges that payloads state, links that hold
    between known entities, and accounts."""

    entities: DataFrame
    properties: DataFrame
    pairs: DataFrame
    edges: DataFrame
    links: DataFrame
    accounts: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def sightings(mentions: DataFrame) -> DataFrame:
    """One row per entity and observation. Entities are merged from these rows, so a hot entity is spread before that."""
    return mentions.groupBy(*KEY, "observation_id").agg(
        F.min("type").alias("type"),
        F.min("value").alias("value"),
        F.max("confidence").alias("confidence"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )


def _pairs(seen: DataFrame) -> DataFrame:
    return seen.select("investigation_id", F.col("id").alias("entity_id"), "observation_id", F.col("first_seen").alias("created_at"))


def _properties(mentions: DataFrame) -> DataFrame:
    """The first filled value of every property of an entity."""
    filled = mentions.select(*KEY, "seen_at", "observation_id", F.explode("properties").alias("name", "value"))
    first = F.min(F.struct("seen_at", "observation_id", "value")).alias("first")
    return filled.where(F.col("value") != "").groupBy(*KEY, "name").agg(first)


def edge_partials(edges: DataFrame) -> DataFrame:
    """One row per edge: highest confidence, first sighting, number of observations."""
    return edges.groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in _EDGE],
        F.max("confidence").alias("confidence"),
        F.min(F.struct("seen_at", "observation_id", "method")).alias("first"),
        F.count_distinct("observation_id").alias("evidence_count"),
    )


def _edge_sightings(edges: DataFrame, links: DataFrame) -> DataFrame:
    """One row per edge and observation: how the payload states it, and how it links known entities."""

    def told(rows: DataFrame, name: str) -> DataFrame:
        said = F.struct("seen_at", "method", "confidence", *_EDGE).alias(name)
        return rows.select(*KEY, "observation_id", said)

    rows = told(edges, "edge").unionByName(told(links, "link"), allowMissingColumns=True)
    stated = F.struct(
        F.min(F.struct("edge.seen_at", "edge.method")).alias("first"), F.max("edge.confidence").alias("confidence"),
        *[F.min(f"edge.{c}").alias(c) for c in _EDGE],
    )
    return rows.groupBy(*KEY, "observation_id").agg(
        F.when(F.count("edge") > 0, stated).alias("edge"), F.min("link").alias("link")
    )


def _stated(met: DataFrame) -> DataFrame:
    """What ``edge_partials`` gives, from one row per edge and observation."""
    first = F.struct("edge.first.seen_at", "observation_id", "edge.first.method")
    return met.where(F.col("edge").isNotNull()).groupBy(*KEY).agg(
        *[F.min(f"edge.{c}").alias(c) for c in _EDGE],
        F.max("edge.confidence").alias("confidence"),
        F.min(first).alias("first"),
        F.count("observation_id").alias("evidence_count"),
    )


def _links(met: DataFrame) -> DataFrame:
    """One row per link: its first sighting, and whether the payload of that observation also states it as an edge."""
    also = F.col("edge").isNotNull() & F.col("observation_id").isNotNull()
    row = F.struct(
        "link.seen_at", "observation_id", "link.method", "link.confidence", *[f"link.{c}" for c in _EDGE], also.alias("stated")
    )
    return met.where(F.col("link").isNotNull()).groupBy(*KEY).agg(F.min(row).alias("first"))


def partials(said: DataFrame, accounts: DataFrame | None = None) -> Partials:
    """The aggregates of what ``extract.said_in`` has found, and of the mentions that its accounts add, if any.

    What several aggregates are made from, sightings of entities and of edges, is grouped once and written.
    """
    mentions = extract.mentions_of(said)
    every = mentions if accounts is None else mentions.unionByName(accounts)
    seen = cut_lineage(sightings(every))
    met = cut_lineage(_edge_sightings(extract.edges_of(said), extract.edges_of(said, extract.LINKED)))
    return Partials(
        merged_entities(seen.withColumn("evidence_count", _one())),
        _properties(mentions),
        _pairs(seen),
        _stated(met),
        _links(met),
        extract.accounts_of(said),
    )


def _one() -> Column:
    """What a sighting adds to the evidence; one without an observation adds nothing."""
    return F.when(F.col("observation_id").isNotNull(), 1).otherwise(0).cast("bigint")


#: What a row of ``told`` holds.
_MENTION, _EDGE_ROW, _ACCOUNT = "mention", "edge", "account"


def told(said: DataFrame) -> DataFrame:
    """One row per observation and entity, edge or account that ``extract.said_in`` has found in it, by ``kind``.

    In ``extract.said_by_observation`` all that is grouped here lies in one task already, so nothing is shuffled. Evidence needs one row per entity and observation, but no order among entities.
    """
    what = F.col("what")
    is_mention, is_edge = what == extract.MENTIONED, what.isin(extract.STATED, extract.LINKED)
    edge_id = F.coalesce("edge_id", F.concat_ws(":", "own_id", "rel", "target_id"))
    ends = [F.col("own_id").alias("source_id"), F.col("target_id"), F.col("rel").alias("relationship_type")]
    edge = F.struct("seen_at", "method", "confidence", *ends)
    rows = said.select(
        "observation_id",
        F.when(is_mention, _MENTION).when(is_edge, _EDGE_ROW).otherwise(_ACCOUNT).alias("kind"),
        F.when(is_edge, edge_id).otherwise(F.col("own_id")).alias("id"),
        "investigation_id",
        *[F.when(is_mention, F.col(c)).alias(c) for c in ("type", "value", "confidence", "seen_at", "source")],
        F.when(
            (is_mention & (F.size("properties") > 0)) | (what == extract.ACCOUNT),
            F.struct("source", "seen_at", "confidence", "properties"),
        ).alias("item"),
        F.when(what == extract.STATED, edge).alias("edge"),
        F.when(what == extract.LINKED, edge).alias("link"),
    )
    stated = F.struct(
        F.min(F.struct("edge.seen_at", "edge.method")).alias("first"), F.max("edge.confidence").alias("confidence"),
        *[F.min(f"edge.{c}").alias(c) for c in _EDGE],
    )
    return rows.groupBy("observation_id", "kind", "id", "investigation_id").agg(
        F.min("type").alias("type"),
        F.min("value").alias("value"),
        F.max("confidence").alias("confidence"),
        F.min("seen_at").alias("first_seen"),
        F.max("seen_at").alias("last_seen"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.collect_list("item").alias("items"),
        F.when(F.count("edge") > 0, stated).alias("edge"),
        F.min("link").alias("link"),
    )


def told_accounts(rows: DataFrame) -> DataFrame:
    """The accounts among rows of ``told``, as ``extract.accounts_of`` gives them."""
    found = rows.where(F.col("kind") == _ACCOUNT).select("investigation_id", "observation_id", F.inline("items"))
    return extract.accounts_of(found.withColumn("what", F.lit(extract.ACCOUNT)))


def told_edges(rows: DataFrame) -> DataFrame:
    """Edges and links among rows of ``told``, one row per observation, for ``relationship_rows``."""
    met = rows.where(F.col("kind") == _EDGE_ROW)
    there, linked = F.col("edge").isNotNull(), F.col("link").isNotNull()
    also = there & F.col("observation_id").isNotNull()
    link = F.struct(
        "link.seen_at", "observation_id", "link.method", "link.confidence", *[f"link.{c}" for c in _EDGE], also.alias("stated")
    )
    return met.select(
        *KEY, *[F.col(f"edge.{c}").alias(c) for c in _EDGE], F.col("edge.confidence").alias("confidence"),
        F.when(there, F.struct("edge.first.seen_at", "observation_id", "edge.first.method")).alias("first"),
        F.when(there, _one()).otherwise(0).cast("bigint").alias("evidence_count"),
        F.when(linked, link).alias("link"),
    )


def told_entities(rows: DataFrame, accounts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, their properties and pairs of entity and observation, from rows of ``told`` and the mentions that its
    accounts add, if any.

    Only sightings of the kinds that accounts add can be sightings of theirs; these meet by pairs, which tells what is new
    evidence. All others are pairs as they are.
    """
    seen = rows.where(F.col("kind") == _MENTION)
    filled = seen.select(*KEY, "observation_id", F.inline("items"))
    properties = _properties(filled)
    pairs, counted = _pairs(seen), seen.withColumn("evidence_count", _one())
    if accounts is None:
        return merged_entities(counted), properties, pairs
    added = F.substring_index("entity_id", ":", 1).isin(ACCOUNT_PREFIXES)
    theirs = _pairs(accounts.withColumnRenamed("seen_at", "first_seen")).withColumn("_known", F.lit(False))
    met = pairs.where(added).withColumn("_known", F.lit(True)).unionByName(theirs)
    met = met.groupBy("investigation_id", "entity_id", "observation_id").agg(
        F.min("created_at").alias("created_at"), F.max("_known").alias("_known")
    )
    met = cut_lineage(met)
    more = accounts.select(
        *KEY, "type", "value", "confidence", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"),
        F.array("source").alias("sources"), F.lit(0).cast("bigint").alias("evidence_count"),
    )
    columns = more.columns
    entities = counted.select(*columns).unionByName(more).unionByName(_new_evidence(met), allowMissingColumns=True)
    alone = pairs.where(~F.coalesce(added, F.lit(False)))
    return merged_entities(entities), properties, alone.unionByName(met.drop("_known"))


def _new_evidence(pairs: DataFrame) -> DataFrame:
    """What pairs that were not known before add to their entities."""
    return pairs.where(~F.col("_known")).select(
        "investigation_id", F.col("entity_id").alias("id"), F.array().cast("array<string>").alias("sources"),
        _one().alias("evidence_count"),
    )


def merged_entities(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        F.min("type").alias("type"),
        F.min("value").alias("value"),
        F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.sum("evidence_count").alias("evidence_count"),
    )


def merged_edges(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in _EDGE],
        F.max("confidence").alias("confidence"),
        F.min("first").alias("first"),
        F.sum("evidence_count").alias("evidence_count"),
    )


def merged_properties(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY, "name").agg(F.min("first").alias("first"))


def merged_links(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.min("first").alias("first"))


def merged(parts: Partials) -> Partials:
    """Tables of several parts, put one below the other, as one part. Edges stay as they are: relationships are merged
    from any number of rows of an edge."""
    return Partials(
        merged_entities(parts.entities),
        merged_properties(parts.properties),
        parts.pairs,
        parts.edges,
        merged_links(parts.links),
        parts.accounts,
    )


def merged_with(parts: Partials, mentions: DataFrame) -> Partials:
    """``merged``, with mentions that are derived from the parts, of observations that may be among them already.

    Pairs of both kinds meet once: that merges them and tells which sightings are new evidence.
    """
    seen = sightings(mentions)
    rows = parts.pairs.withColumn("_known", F.lit(True)).unionByName(_pairs(seen).withColumn("_known", F.lit(False)))
    pairs = rows.groupBy("investigation_id", "entity_id", "observation_id").agg(
        F.min("created_at").alias("created_at"), F.max("_known").alias("_known")
    )
    pairs = cut_lineage(pairs)
    more = seen.withColumn("evidence_count", F.lit(0).cast("bigint")).drop("observation_id")
    entities = parts.entities.unionByName(more).unionByName(_new_evidence(pairs), allowMissingColumns=True)
    return replace(merged(parts), entities=merged_entities(entities), pairs=pairs.drop("_known"))


def entity_table(entities: DataFrame, properties: DataFrame) -> DataFrame:
    """Merged entities with their merged properties, as ``resolve.resolve_exact`` gives them."""
    entry = F.struct("name", F.col("first.value").alias("value"))
    properties = properties.groupBy(*KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("properties"))
    rows = entities.join(properties, KEY, "left")
    return rows.select(
        "id", "investigation_id", "type", "value", "confidence", "first_seen", "last_seen",
        F.size("sources").alias("source_count"), "sources", "evidence_count",
        F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"),
    )


def edge_rows(edges: DataFrame) -> DataFrame:
    """``edge_partials`` of edges of which each row is a sighting of its own."""
    return edges.select(
        *KEY, *_EDGE, "confidence", F.struct("seen_at", "observation_id", "method").alias("first"), _one().alias("evidence_count")
    )


def edges_with_links(parts: Partials) -> DataFrame:
    """Edges and links of several parts, for ``relationship_rows``."""
    links = parts.links.select(*KEY, F.col("first").alias("link"))
    return parts.edges.unionByName(links, allowMissingColumns=True)


def relationship_rows(tables: list[DataFrame]) -> DataFrame:
    """One row per edge of the given edge partials, of which some have a ``link`` beside or instead of the edge. Method
    and time come from the first table that has the edge."""
    rows = None
    for k, t in enumerate(tables, 1):
        t = t.withColumn("_rank", F.when(F.col("first").isNotNull(), F.struct(F.lit(k).alias("at"), "first")))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    return rows.groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in _EDGE],
        F.max("confidence").alias("confidence"),
        F.sum("evidence_count").alias("evidence_count"),
        F.min("_rank").alias("_rank"),
        F.min("link").alias("link"),
    )


def _with_link(rows: DataFrame, kept: Column) -> DataFrame:
    """Relationships from ``relationship_rows``; where ``kept``, the link counts as well, before all tables. A first
    sighting that is also stated is no evidence of its own."""
    link = F.when(kept, F.col("link"))
    own = F.when(link.isNull() | link["stated"] | link["observation_id"].isNull(), 0).otherwise(1).cast("bigint")
    first = F.col("_rank.first")
    return rows.where(kept | F.col("_rank").isNotNull()).select(
        *KEY, *[F.least(c, link[c]).alias(c) for c in _EDGE],
        F.greatest("confidence", link["confidence"]).alias("confidence"),
        (F.coalesce("evidence_count", F.lit(0).cast("bigint")) + own).alias("evidence_count"),
        F.when(kept, link["seen_at"]).otherwise(first["seen_at"]).alias("discovered_at"),
        F.when(kept, link["method"]).otherwise(first["method"]).alias("method"),
        *[c for c in ("_src", "_tgt") if c in rows.columns],
    )


def relationships(rows: DataFrame, ents: DataFrame) -> DataFrame:
    """Relationships from ``relationship_rows``, with the confidence of their ends as ``_src`` and ``_tgt``, if these are
    entities. A link holds only between known entities.

    The ends are looked up once, for links and for scores. Should an edge and a link of one id have different ends, the
    link's are looked up first.
    """
    linked = F.col("link").isNotNull()
    other = [F.col(c) != F.col(f"link.{c}") for c in ("source_id", "target_id")]
    apart = F.coalesce(linked & (other[0] | other[1]), F.lit(False))
    ends = {c: F.coalesce(F.col(c), F.col(f"link.{c}")) for c in ("source_id", "target_id")}
    known = ents.select("investigation_id", "id", F.struct("confidence").alias("_end"))

    def joined(edges: DataFrame) -> DataFrame:
        for end, name in (("source_id", "_src"), ("target_id", "_tgt")):
            side = known.withColumnsRenamed({"id": f"_{end}", "_end": name})
            edges = edges.withColumn(f"_{end}", ends[end] if "link" in edges.columns else F.col(end))
            edges = edges.join(side, ["investigation_id", f"_{end}"], "left").drop(f"_{end}")
        return edges

    together = joined(rows.where(~apart))
    both = linked & F.col("_src").isNotNull() & F.col("_tgt").isNotNull()
    plain = _with_link(together, both)
    odd = rows.where(apart)
    for end in ("source_id", "target_id"):
        side = known.select("investigation_id", F.col("id").alias(f"_{end}"), F.lit(True).alias(f"_has_{end}"))
        odd = odd.withColumn(f"_{end}", F.col(f"link.{end}"))
        odd = odd.join(side, ["investigation_id", f"_{end}"], "left").drop(f"_{end}")
    has = F.col("_has_source_id").isNotNull() & F.col("_has_target_id").isNotNull()
    found = plain.unionByName(joined(_with_link(odd, has)))
    return found.withColumns({c: F.col(f"{c}.confidence") for c in ("_src", "_tgt")})
