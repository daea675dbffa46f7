"""Joins: edges between known entities, provenance, references, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import values
from linkloom.operators.extract import LINKED, MENTIONED, edges_of, link_candidates, mentions_of, said_in
from linkloom.operators.score import threat_score
from linkloom.session import cut_lineage


#: Adapters whose payloads link known entities.
LINKING = ["dns", "whois", "certificate_transparency", "ip_to_asn", "http", "threat_intel", "github"]


def between_known(edges: DataFrame, ents: DataFrame, inside: str = "") -> DataFrame:
    """Edges whose two ends are entities of the same investigation; ``inside`` names the struct that holds the ends."""
    ids = ents.select(F.col("investigation_id").alias("_inv"), F.col("id").alias("_end")).distinct()
    for end in ("source_id", "target_id"):
        known = (F.col("investigation_id") == F.col("_inv")) & (F.col(inside + end) == F.col("_end"))
        edges = edges.join(ids, known, "left_semi")
    return edges


def first_per_edge(edges: DataFrame) -> DataFrame:
    """The first sighting of every edge."""
    window = W.partitionBy("investigation_id", "id").orderBy("seen_at", "observation_id", "method")
    return edges.withColumn("_n", F.row_number().over(window)).where(F.col("_n") == 1).drop("_n")


def _adapter_links(adapter: str):
    def job(obs: DataFrame, ents: DataFrame) -> DataFrame:
        return between_known(link_candidates(obs, [adapter]), ents)

    return job


link_dns = _adapter_links("dns")
link_whois = _adapter_links("whois")
link_ct = _adapter_links("certificate_transparency")
link_ip_asn = _adapter_links("ip_to_asn")
link_http = _adapter_links("http")
link_threat = _adapter_links("threat_intel")
link_github = _adapter_links("github")


def links_within(obs: DataFrame, adapter: str) -> DataFrame:
    """What ``link_<adapter>`` gives between the entities that the observations themselves mention; payloads are read and
    parsed once for both."""
    said = cut_lineage(said_in(obs.where(F.col("source_adapter") == adapter), (MENTIONED, LINKED), [adapter]), by=["what"])
    links = edges_of(said, LINKED).where(F.col("method") != "target_email_domain")
    return between_known(links, mentions_of(said).select("investigation_id", "id"))


def link_email_domain(obs: DataFrame, ents: DataFrame) -> DataFrame:
    """Email targets to their own domain."""
    links = edges_of(said_in(obs, (LINKED,), []), LINKED)
    return between_known(links.where(F.col("method") == "target_email_domain"), ents)


def known_links(links: DataFrame, ents: DataFrame) -> DataFrame:
    """Of extracted links, those between known entities; the first sighting of an edge counts."""
    return first_per_edge(between_known(links, ents))


def detect_relationships(obs: DataFrame, ents: DataFrame, adapters: list[str] | None = None) -> DataFrame:
    """All structural edges between known entities, from observations."""
    linking = [a for a in LINKING if adapters is None or a in adapters]
    return known_links(edges_of(said_in(obs, (LINKED,), linking), LINKED), ents)


# --- provenance and references -----------------------------------------------------------------------------------


def entity_observations(prov: DataFrame, obs: DataFrame) -> DataFrame:
    """Every entity with the observations it comes from."""
    seen = obs.select(F.col("id").alias("observation_id"), "source_adapter", "collected_at", "method", "target",
                      "normalized_value", "confidence", "status")
    return prov.select("entity_id", "investigation_id", "observation_id").join(seen, "observation_id")


def provenance_trail(prov: DataFrame, obs: DataFrame) -> DataFrame:
    """Provenance in time order, kept even where the observation is gone."""
    seen = obs.select(F.col("id").alias("observation_id"), "source_adapter", "collected_at", "method", "target",
                      "confidence", "status")
    rows = prov.withColumnRenamed("created_at", "discovered_at").join(seen, "observation_id", "left")
    return rows.orderBy("investigation_id", "entity_id", "discovered_at", "observation_id")


def workspace_notes(notes: DataFrame, inv: DataFrame) -> DataFrame:
    """Notes with the name of their investigation, newest first."""
    named = inv.select(F.col("id").alias("investigation_id"), F.col("name").alias("investigation_name"))
    rows = notes.join(named, "investigation_id").select("id", "content", "created_at", "investigation_name")
    return rows.orderBy(F.desc("created_at"), "id")


def validate_references(df: DataFrame, row_key: str, refs_col: str, known: DataFrame, known_id: str) -> DataFrame:
    """Keeps only references that exist, in their order; adds ``unknown_count``.

    References are exploded and joined, then gathered again per row, so a list is never larger than it was.
    """
    refs = df.select(row_key, F.posexplode(refs_col).alias("_at", "_ref"))
    ids = known.select(F.col(known_id).alias("_ref")).distinct().withColumn("_known", F.lit(True))
    checked = refs.join(ids, "_ref", "left")
    good = F.filter(
        F.array_sort(F.collect_list(F.struct("_at", "_ref", "_known"))), lambda r: F.coalesce(r["_known"], F.lit(False))
    )
    back = checked.groupBy(row_key).agg(
        F.transform(good, lambda r: r["_ref"]).alias("_good"),
        F.count_if(F.col("_known").isNull()).alias("unknown_count"),
    )
    empty = F.array().cast("array<string>")
    return (
        df.join(back, row_key, "left")
        .withColumn(refs_col, F.coalesce("_good", empty))
        .withColumn("unknown_count", F.coalesce("unknown_count", F.lit(0)))
        .drop("_good")
    )


def unknown_references(df: DataFrame, row_key: str, refs_col: str, known: DataFrame, known_id: str) -> DataFrame:
    """References that do not exist."""
    refs = df.select(row_key, F.explode(refs_col).alias("reference"))
    return refs.join(known.select(F.col(known_id).alias("reference")), "reference", "left_anti")


# --- enrichment --------------------------------------------------------------------------------------------------


def prefix_bounds(prefixes: DataFrame, prefix_col: str = "prefix") -> DataFrame:
    """Adds ``bits``, ``low`` and ``high`` to IPv4 prefixes written as a.b.c.d/n."""
    base = values.ipv4_number(F.substring_index(prefix_col, "/", 1))
    bits = F.substring_index(prefix_col, "/", -1).try_cast("int")
    size = F.shiftleft(F.lit(1).cast("bigint"), 32)
    width = F.expr(f"shiftleft(1L, 32 - try_cast(substring_index({prefix_col}, '/', -1) AS INT))")
    low = (base - F.pmod(base, width)).cast("bigint")
    return (
        prefixes.withColumn("bits", bits)
        .withColumn("low", low)
        .withColumn("high", F.least(low + width - 1, size - 1))
        .where(F.col("low").isNotNull() & F.col("bits").between(0, 32))
    )


def enrich_asn(ips: DataFrame, prefixes: DataFrame, ip_col: str = "value") -> DataFrame:
    """The longest announced prefix of every IPv4 address; addresses without one keep nulls.

    A prefix of n bits covers an address exactly when the address cut to n bits is the prefix, so every address is
    looked up by equality once per prefix length that occurs (at most 33) instead of by range. Distinct addresses are
    looked up once however often they occur.
    """
    table = prefix_bounds(prefixes).groupBy("bits", "low").agg(
        F.min_by(F.struct("prefix", "asn"), F.struct("prefix", "asn")).alias("_p")
    )
    lengths = table.agg(F.array_sort(F.collect_set("bits")).alias("_lengths"))
    number = values.ipv4_number(F.col(ip_col))
    distinct = ips.select(ip_col).distinct().withColumn("_n", number).where(F.col("_n").isNotNull())
    keyed = distinct.withColumn("bits", F.explode(lengths.scalar()))
    width = F.expr("shiftleft(1L, 32 - bits)")
    keyed = keyed.withColumn("low", (F.col("_n") - F.pmod(F.col("_n"), width)).cast("bigint"))
    found = keyed.join(table, ["bits", "low"])
    longest = found.groupBy(ip_col).agg(F.max_by("_p", F.col("bits")).alias("_p"))
    return ips.join(longest, ip_col, "left").select(
        *[F.col(c) for c in ips.columns], F.col("_p.prefix").alias("prefix"), F.col("_p.asn").alias("asn")
    )


def enrich_threat(ents: DataFrame, feed: DataFrame) -> DataFrame:
    """Highest threat score of an entity's value over all feed rows (value, abuse_score, url_status)."""
    rated = feed.select(
        "value",
        threat_score(F.col("abuse_score"), F.col("url_status"), F.col("url_status").isNotNull()).alias("_score"),
    )
    best = rated.groupBy("value").agg(F.max("_score").alias("threat_score"))
    kinds = ents.where(F.col("type").isin("IP", "URL", "Domain", "Subdomain"))
    return kinds.join(best, "value").select(*[F.col(c) for c in ents.columns], "threat_score")


def not_known(df: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key does not occur in ``known`` (set difference)."""
    return df.join(known.select(*on).distinct(), on, "left_anti")


def as_time(value: str) -> Column:
    return F.lit(value).cast("timestamp")
