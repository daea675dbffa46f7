"""From observations to scored entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import accounts, extract, link, partials, resolve, score
from linkloom.operators.partials import Partials
from linkloom.session import cut_lineage


def correlate(
    obs: DataFrame, as_of: str, fuzzy: bool = True, co_occurrence: bool = False, link_accounts: bool = True
) -> dict[str, DataFrame]:
    """Entities, relationships and provenance of a table of observations.

    The observations are read and parsed once; all that they say is written, by kind. ``link_accounts`` also links the
    accounts of one user name across platforms and adds the people, emails and organizations behind them.
    ``co_occurrence`` links all entities of one observation: its result grows with the square of what an observation
    holds, so it is off unless asked for.
    """
    said = extract.said_by_observation(obs, extract.present_adapters(obs))
    told = cut_lineage(partials.told(said), by=["kind"])
    met = partials.told_edges(told)
    if not link_accounts:
        return _joined(partials.told_entities(told), met, as_of, fuzzy, co_occurrence)
    # Mentions that accounts add are merged with all others.
    found = partials.told_accounts(told)
    mentions, edges = accounts.account_entities(found, _time(as_of))
    return _joined(partials.told_entities(told, mentions), met, as_of, fuzzy, co_occurrence, (found, edges))


def related(
    parts: Partials, as_of: str, fuzzy: bool = True, co_occurrence: bool = False, link_accounts: bool = True
) -> dict[str, DataFrame]:
    """The steps after extraction, from the tables of several parts, put one below the other."""
    met = partials.edges_with_links(parts)
    if not link_accounts:
        return _joined(_entities_of(partials.merged(parts)), met, as_of, fuzzy, co_occurrence)
    found = cut_lineage(parts.accounts)
    mentions, edges = accounts.account_entities(found, _time(as_of))
    merged = partials.merged_with(parts, mentions)
    return _joined(_entities_of(merged), met, as_of, fuzzy, co_occurrence, (found, edges))


def _entities_of(parts: Partials) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parts.entities, parts.properties, parts.pairs


def _time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _joined(
    merged: tuple[DataFrame, DataFrame, DataFrame],
    met: DataFrame,
    as_of: str,
    fuzzy: bool,
    co_occurrence: bool,
    linked: tuple[DataFrame, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Resolve, link, merge, score. ``merged`` holds entities, properties and pairs, ``met`` edges and links, ``linked``
    accounts and the edges that they add. Entities are written once; every later step joins them."""
    now = _time(as_of)
    entities, properties, pairs = merged
    observed = pairs.where(F.coalesce("observation_id", F.lit("")) != "").drop("created_at")
    ents = cut_lineage(resolve.resolve_normalized(cut_lineage(partials.entity_table(entities, properties)), observed))
    tables = []
    if co_occurrence:
        members = observed.select("investigation_id", "observation_id", "entity_id")
        together = resolve.co_occurrences(members).drop("shared").withColumn("seen_at", now)
        tables.append(partials.edge_rows(link.between_known(together, ents)))
    if fuzzy:
        tables.append(partials.edge_rows(resolve.similarity_edges(resolve.similar_entities(ents), now)))
    if linked is None:
        tables.append(met)
    else:
        found, edges = linked
        tables.append(met.unionByName(partials.edge_partials(edges), allowMissingColumns=True))
        links = accounts.account_links(found).withColumns({"method": F.lit(""), "seen_at": now})
        tables.append(partials.edge_partials(links))
    scored = score.score_entities(ents, as_of)
    rels = score.score_between(partials.relationships(partials.relationship_rows(tables), scored), as_of)
    seen = pairs.withColumnsRenamed({"entity_id": "id", "created_at": "seen_at"})
    provenance = resolve.entity_provenance(seen, once=True)
    return {"entities": scored, "relationships": rels, "entity_provenance": provenance}
