"""Counts, overlaps and report sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import values

Tables = dict[str, DataFrame]
MIN_SHOWN_CONFIDENCE = 0.3


def workspace_totals(tables: Tables) -> DataFrame:
    """One row with the size of the four main tables."""
    parts = None
    for name in ("investigations", "entities", "relationships", "observations"):
        part = tables[name].select(F.lit(f"total_{name}").alias("metric"))
        parts = part if parts is None else parts.unionAll(part)
    names = [f"total_{n}" for n in ("investigations", "entities", "relationships", "observations")]
    return parts.agg(*[F.count_if(F.col("metric") == n).alias(n) for n in names])


def entity_distribution(ents: DataFrame) -> DataFrame:
    return ents.groupBy("type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "type")


def collection_coverage(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source_adapter").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "source_adapter")


def shared_values(ents: DataFrame) -> DataFrame:
    """Values that occur in more than one investigation, and in how many.

    The distinct pairs are counted, so a value is spread over its investigations before it is merged.
    """
    pairs = ents.select("type", "value", "investigation_id").distinct()
    found = pairs.groupBy("type", "value").agg(F.count("*").alias("overlap_count"))
    return found.where(F.col("overlap_count") > 1).orderBy(F.desc("overlap_count"), "type", "value")


def shared_value_members(ents: DataFrame, inv: DataFrame) -> DataFrame:
    """Which investigations share a value, one row each: a list per value would have no bound."""
    pairs = ents.select("type", "value", "investigation_id").distinct()
    shared = pairs.groupBy("type", "value").agg(F.count("*").alias("overlap_count")).where(F.col("overlap_count") > 1)
    named = inv.select(F.col("id").alias("investigation_id"), F.col("name").alias("shared_across"))
    return (
        pairs.join(shared, ["type", "value"])
        .join(named, "investigation_id")
        .select("type", "value", "overlap_count", "shared_across")
    )


def value_sketches(mentions: DataFrame, lg_k: int = 12) -> DataFrame:
    """Per type, value and day a sketch of the investigations that have the value, of bounded size.

    Sketches of new days are added without reading old ones. Counts from them are off by about 1.04 / sqrt(2 ** lg_k),
    1.6 % at the default (one standard error), and much less for small counts. ``shared_values`` stays the exact form.
    """
    day = F.to_date("seen_at").alias("day")
    return mentions.groupBy("type", "value", day).agg(F.hll_sketch_agg("investigation_id", lg_k).alias("sketch"))


def shared_values_of(sketches: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """``shared_values`` from merged sketches of the days from ``since`` to ``until``, both included."""
    if since is not None:
        sketches = sketches.where(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        sketches = sketches.where(F.col("day") <= F.lit(until).cast("date"))
    merged = sketches.groupBy("type", "value").agg(F.hll_union_agg("sketch").alias("_s"))
    found = merged.select("type", "value", F.hll_sketch_estimate("_s").alias("overlap_count"))
    return found.where(F.col("overlap_count") > 1).orderBy(F.desc("overlap_count"), "type", "value")


def graph_stats(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """Nodes and edges per investigation."""
    rows = ents.select("investigation_id", F.lit(1).alias("node")).unionAll(
        rels.select("investigation_id", F.lit(0).alias("node"))
    )
    return rows.groupBy("investigation_id").agg(
        F.sum("node").alias("total_nodes"), (F.count("*") - F.sum("node")).alias("total_edges")
    )


def sync_counts(inv: DataFrame, ents: DataFrame, rels: DataFrame, obs: DataFrame) -> DataFrame:
    """Investigations with counters recomputed from the tables, in one aggregate over all three."""
    rows = None
    for name, table in (("entity", ents), ("relationship", rels), ("observation", obs)):
        part = table.select(F.col("investigation_id").alias("id"), F.lit(name).alias("_what"))
        rows = part if rows is None else rows.unionAll(part)
    counts = rows.groupBy("id").agg(
        *[
            F.count_if(F.col("_what") == n).alias(f"{n}_count")
            for n in ("entity", "relationship", "observation")
        ]
    )
    names = ["entity_count", "relationship_count", "observation_count"]
    joined = inv.drop(*names).join(counts, "id", "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in names}).select(*inv.columns)


def round_counts(activity: DataFrame, event_type: str = "pivot_round_completed") -> DataFrame:
    return activity.groupBy("investigation_id").agg(F.count_if(F.col("event_type") == event_type).alias("rounds"))


def sources_used(obs: DataFrame) -> DataFrame:
    return obs.groupBy("investigation_id").agg(F.array_sort(F.collect_set("source_adapter")).alias("sources"))


def provenance_urls(rows: DataFrame) -> DataFrame:
    """Adds ``source_url`` to observations joined to provenance: where the payload of an adapter keeps its link."""
    raw = F.when(F.col("raw_response").startswith("{"), F.col("raw_response"))

    def at(*paths: str):
        return F.coalesce(*[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in paths])

    adapter = F.col("source_adapter")
    url = (
        F.when(adapter == "github", at("$.html_url", "$.profile.html_url"))
        .when(adapter.isin("ddg", "search", "http"), at("$.url", "$.link"))
        .when(
            (adapter == "hackernews") & raw.isNotNull(),
            F.concat(F.lit("https://news.ycombinator.com/user?id="), "target"),
        )
        .when((adapter == "reddit") & raw.isNotNull(), F.concat(F.lit("https://reddit.com/user/"), "target"))
    )
    return rows.withColumn("source_url", url)


def entity_report_rows(ents: DataFrame, prov: DataFrame, obs: DataFrame) -> DataFrame:
    """Entities with their provenance, one row per entity and observation; entities without any keep one row."""
    seen = provenance_urls(
        obs.select(
            F.col("id").alias("observation_id"), "source_adapter", "collected_at", "target", "raw_response"
        )
    ).drop("raw_response")
    links = prov.select(F.col("entity_id").alias("id"), "investigation_id", "observation_id")
    found = links.join(seen, "observation_id")
    rows = ents.select("id", "investigation_id", "type", "value", "confidence", "source_count")
    return rows.join(found, ["investigation_id", "id"], "left")


def investigation_report(tables: Tables) -> DataFrame:
    """Whole reports as lines: investigation, section, sort key and a JSON record.

    Lines sort by (investigation_id, section, sort_key); writing them partitioned by investigation gives one report
    each, however large, without holding a report in memory.
    """

    def lines(section: str, rows: DataFrame, inv_col: str, *order: str) -> DataFrame:
        others = [c for c in rows.columns if c != inv_col]
        return rows.select(
            F.col(inv_col).alias("investigation_id"),
            F.lit(section).alias("section"),
            F.concat_ws("\x1f", *[F.col(o).cast("string") for o in order]).alias("sort_key"),
            F.to_json(F.struct(*others)).alias("record"),
        )

    t = tables
    inv = t["investigations"]
    parts = [
        lines("1_investigation", inv.withColumn("_inv", F.col("id")), "_inv", "id"),
        lines("2_sources", sources_used(t["observations"]), "investigation_id"),
        lines("3_rounds", round_counts(t["activity_log"]), "investigation_id"),
        lines(
            "4_entities",
            entity_report_rows(t["entities"], t["entity_provenance"], t["observations"]),
            "investigation_id", "type", "value", "observation_id",
        ),
        lines("5_observations", t["observations"].drop("raw_response"), "investigation_id", "collected_at", "id"),
        lines("6_activity", t["activity_log"], "investigation_id", "created_at", "id"),
        lines("7_notes", t["notes"], "investigation_id", "created_at", "id"),
        lines("8_relationships", t["relationships"], "investigation_id", "relationship_type", "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def workspace_report(tables: Tables, last: int) -> Tables:
    """Sections over all investigations; every investigation's report is made in the same pass."""
    from linkloom.operators.link import workspace_notes

    return {
        "totals": workspace_totals(tables),
        "entity_distribution": entity_distribution(tables["entities"]),
        "collection_coverage": collection_coverage(tables["observations"]),
        "shared_values": shared_values(tables["entities"]),
        "shared_value_members": shared_value_members(tables["entities"], tables["investigations"]),
        "workspace_notes": workspace_notes(tables["notes"], tables["investigations"]),
        "activity_log": tables["activity_log"].orderBy(F.desc("created_at"), F.desc("id")).limit(last),
        "full_reports": investigation_report(tables),
    }


def report_sections(
    ents: DataFrame, rels: DataFrame, min_confidence: float = MIN_SHOWN_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """What a report shows: entities and edges of enough confidence, best first, by type."""
    shown = ents.where(F.col("confidence") >= min_confidence)
    edges = rels.where(F.col("confidence") >= min_confidence)
    return (
        shown.orderBy("investigation_id", "type", F.desc("confidence"), "id"),
        edges.orderBy("investigation_id", F.desc("confidence"), "id"),
    )


def key_findings(inv: DataFrame, ents: DataFrame, obs: DataFrame) -> DataFrame:
    """The investigation with most entities, the commonest type and the busiest adapter, as one row per finding."""

    def top(rows: DataFrame, finding: str) -> DataFrame:
        best = rows.agg(F.max(F.struct("n", "name")).alias("b"))
        return best.select(F.lit(finding).alias("finding"), F.col("b.name").alias("name"), F.col("b.n").alias("n"))

    by_inv = inv.select(F.col("name"), F.col("entity_count").cast("bigint").alias("n"))
    by_type = ents.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"))
    by_adapter = obs.groupBy(F.col("source_adapter").alias("name")).agg(F.count("*").alias("n"))
    return (
        top(by_inv, "most_entities")
        .unionByName(top(by_type, "commonest_type"))
        .unionByName(top(by_adapter, "busiest_adapter"))
    )


def graph_summary(ents: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compact entity rows, compact edge rows, and their counts per investigation."""
    return (
        ents.select("investigation_id", "id", "type", "value", "confidence", "source_count"),
        rels.select("investigation_id", "source_id", "relationship_type", "target_id", "confidence"),
        graph_stats(ents, rels),
    )


def adapter_success(obs: DataFrame) -> DataFrame:
    """Share of successful observations per adapter."""
    return obs.groupBy("source_adapter").agg(
        F.count("*").alias("observations"), F.avg((F.col("status") == "success").cast("int")).alias("success_rate")
    )


def evidence_share(ents: DataFrame) -> DataFrame:
    """Share of entities with at least one observation behind them, per investigation."""
    return ents.groupBy("investigation_id").agg(F.avg((F.col("evidence_count") > 0).cast("int")).alias("evidence_share"))


def pair_quality(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """Precision and recall of found pairs (id_a, id_b) against labelled ones, whichever way round they are written."""

    def ordered(df: DataFrame, flag: str) -> DataFrame:
        return df.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct().withColumn(
            flag, F.lit(1)
        )

    both = ordered(found, "_f").join(ordered(labelled, "_l"), ["a", "b"], "full_outer")
    hit = F.count_if(F.col("_f").isNotNull() & F.col("_l").isNotNull())
    return both.agg(
        hit.alias("hits"),
        (hit / F.nullif(F.count("_f"), F.lit(0))).alias("precision"),
        (hit / F.nullif(F.count("_l"), F.lit(0))).alias("recall"),
    )


def split_id(df: DataFrame, col: str = "id") -> DataFrame:
    """Adds ``id_type`` and ``id_value``."""
    return df.withColumn("id_type", values.id_type(F.col(col))).withColumn("id_value", values.id_value(F.col(col)))
