"""Lists, pages, searches and the latest rows of something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import values
from linkloom.operators.graph import entity_relationships
from linkloom.operators.ordering import first_rows
from linkloom.operators.report import graph_stats


def _page(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def list_investigations(
    inv: DataFrame, status: str | None, limit: int | None, offset: int = 0
) -> DataFrame:
    rows = inv if status is None else inv.where(F.col("status") == status)
    return _page(rows.orderBy(F.desc("created_at"), "id"), limit, offset)


def evidence_by_value(obs: DataFrame, ents: DataFrame) -> DataFrame:
    """Observations about an entity's value: the target equals it, or the normalized value does but for case.

    Two equi-joins and a distinct instead of one join on a disjunction.
    """
    wanted = ents.select("investigation_id", F.col("id").alias("entity_id"), values.id_value(F.col("id")).alias("_v"))
    seen = obs.select("investigation_id", F.col("id").alias("observation_id"), "source_adapter", "collected_at",
                      "target", "normalized_value", "confidence", "status")
    exact = seen.join(wanted, (seen.target == wanted._v) & (seen.investigation_id == wanted.investigation_id))
    folded = seen.join(
        wanted,
        (F.lower(seen.normalized_value) == F.lower(wanted._v)) & (seen.investigation_id == wanted.investigation_id),
    )
    cols = [wanted.entity_id, *[seen[c] for c in seen.columns]]
    return exact.select(*cols).unionByName(folded.select(*cols)).distinct()


def entity_evidence(ents: DataFrame, prov: DataFrame, obs: DataFrame, newest: int | None) -> DataFrame:
    """The newest observations behind each entity.

    Own provenance comes first; an entity without any falls back to provenance of the same id in other
    investigations, then to observations of its own investigation that name its value.
    """
    keys = ["investigation_id", "entity_id"]
    cols = ["observation_id", "source_adapter", "collected_at", "method", "target", "normalized_value", "confidence",
            "status"]
    wanted = ents.select("investigation_id", F.col("id").alias("entity_id"))
    seen = obs.withColumnRenamed("id", "observation_id").select("investigation_id", *cols)
    details = seen.drop("investigation_id")
    own = prov.select(*keys, "observation_id").distinct().join(wanted, keys, "left_semi")
    with_own = own.select(*keys).distinct()
    rest = wanted.join(with_own, keys, "left_anti")
    order = [F.desc("collected_at"), F.col("observation_id")]
    # All investigations that fall back to an id get the same newest rows, so these are found once per id.
    by_id = prov.select("entity_id", "observation_id").distinct().join(
        rest.select("entity_id").distinct(), "entity_id", "left_semi"
    )
    other = rest.join(first_rows(by_id.join(details, "observation_id"), ["entity_id"], order, newest), "entity_id")
    by_provenance = own.join(details, "observation_id").unionByName(other, allowMissingColumns=True)
    last = rest.join(by_id.select("entity_id").distinct(), "entity_id", "left_anti").withColumn(
        "_v", values.id_value(F.col("entity_id"))
    )
    by_target = last.join(seen.withColumn("_v", F.col("target")), ["investigation_id", "_v"])
    by_normal = last.join(seen.withColumn("_v", F.col("normalized_value")), ["investigation_id", "_v"])
    by_value = by_target.unionByName(by_normal).drop("_v").distinct()
    every = by_provenance.select(*keys, *cols).unionByName(by_value.select(*keys, *cols))
    return first_rows(every, keys, order, newest)


def entity_context(
    ents: DataFrame, rels: DataFrame, prov: DataFrame, obs: DataFrame, ids: DataFrame, newest: int | None = None
) -> dict[str, DataFrame]:
    """All there is to know about entities (investigation_id, id): themselves, evidence (all of it, or the ``newest`` of
    each), edges, neighbours."""
    chosen = ents.join(ids.select("investigation_id", "id").distinct(), ["investigation_id", "id"], "left_semi")
    seeds = chosen.select("investigation_id", F.col("id").alias("seed"))
    edges = entity_relationships(rels, seeds, incident_only=True)
    other = F.when(F.col("source_id") == F.col("seed"), F.col("target_id")).otherwise(F.col("source_id"))
    near = edges.select("investigation_id", "seed", other.alias("id")).distinct()
    return {
        "entities": chosen,
        "evidence": entity_evidence(chosen, prov, obs, newest),
        "relationships": edges,
        "related": near.join(ents, ["investigation_id", "id"]),
    }


def activity_page(activity: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    return _page(activity.orderBy(F.desc("created_at"), F.desc("id")), limit, offset)


def observation_page(obs: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    return _page(obs.orderBy(F.desc("collected_at"), F.desc("id")), limit, offset)


def list_notes(notes: DataFrame, investigation: str | None = None, entity: str | None = None) -> DataFrame:
    rows = notes if investigation is None else notes.where(F.col("investigation_id") == investigation)
    if entity is not None:
        rows = rows.where(F.col("entity_id") == entity)
    return rows.orderBy(F.desc("created_at"), "id")


def list_reports(reports: DataFrame, investigation: str | None = None) -> DataFrame:
    rows = reports if investigation is None else reports.where(F.col("investigation_id") == investigation)
    return rows.orderBy(F.desc("created_at"), "id")


def search_entities(
    ents: DataFrame,
    types: list[str] | None = None,
    min_confidence: float = 0.0,
    text: str = "",
    sort: str = "confidence",
) -> DataFrame:
    """Entities by type, confidence and a piece of their value or type."""
    rows = ents.where(F.col("confidence") >= min_confidence)
    if types:
        rows = rows.where(F.col("type").isin(types))
    wanted = text.strip().lower()
    if wanted:
        rows = rows.where(F.contains(F.lower("value"), F.lit(wanted)) | F.contains(F.lower("type"), F.lit(wanted)))
    order = {
        "value": [F.col("value")],
        "type": [F.col("type")],
        "source_count": [F.desc("source_count")],
    }.get(sort, [F.desc("confidence")])
    return rows.orderBy(*order, "id")


def search_investigations(inv: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    rows = inv if status is None else inv.where(F.col("status") == status)
    wanted = text.strip().lower()
    if wanted:
        rows = rows.where(F.contains(F.lower("target"), F.lit(wanted)) | F.contains(F.lower("name"), F.lit(wanted)))
    return rows.orderBy(F.desc("created_at"), "id")


def timeline(activity: DataFrame, obs: DataFrame, n: int | None) -> DataFrame:
    """The last ``n`` activities and the last ``n`` observations in one list, newest first."""

    def part(path: str, before: str = "", after: str = ""):
        found = F.get_json_object("details", f"$.{path}")
        return F.when(found.isNotNull(), F.concat(F.lit(before), found, F.lit(after)))

    detail = F.concat_ws(
        " · ",
        part("target", "target: "),
        part("stop_reason", "reason: "),
        part("error", "error: "),
        part("pivots_dispatched", after=" pivots"),
        part("observations_collected", after=" observations"),
    )
    done = activity_page(activity, n).select(
        F.concat(F.lit("a-"), F.col("id").cast("string")).alias("id"),
        F.lit("activity").alias("kind"),
        F.col("created_at").alias("at"),
        F.regexp_replace("event_type", "_", " ").alias("title"),
        F.nullif(detail, F.lit("")).alias("detail"),
        F.col("event_type").alias("badge"),
    )
    seen = observation_page(obs, n).select(
        F.concat(F.lit("o-"), F.col("id").cast("string")).alias("id"),
        F.lit("observation").alias("kind"),
        F.col("collected_at").alias("at"),
        F.concat("source_adapter", F.lit(" → "), "target").alias("title"),
        F.nullif("method", F.lit("")).alias("detail"),
        F.col("source_adapter").alias("badge"),
    )
    return done.unionByName(seen).orderBy(F.desc("at"), "id")


def cap_graph(ents: DataFrame, rels: DataFrame, nodes: int, edges: int) -> tuple[DataFrame, DataFrame]:
    """As much of a graph as a screen shows: the first nodes and edges by id."""
    return (
        ents.orderBy("investigation_id", "id").limit(nodes),
        rels.orderBy("investigation_id", "id").limit(edges),
    )


def stop_reasons(activity: DataFrame) -> DataFrame:
    """The last recorded reason why an investigation ended."""
    ends = activity.where(F.col("event_type").isin("investigation_completed", "investigation_stopped"))
    last = ends.groupBy("investigation_id").agg(F.max_by("details", F.struct("created_at", "id")).alias("_d"))
    return last.select("investigation_id", F.get_json_object("_d", "$.stop_reason").alias("stop_reason"))


def recent_dispatches(activity: DataFrame, n: int, event_type: str = "pivot_dispatched") -> DataFrame:
    """The newest ``n`` dispatches of every investigation."""
    rows = activity.where((F.col("event_type") == event_type) & F.try_parse_json("details").isNotNull())
    newest = first_rows(rows, ["investigation_id"], [F.desc("created_at"), F.desc("id")], n)
    return newest.select(
        "investigation_id",
        "id",
        F.coalesce(F.get_json_object("details", "$.target"), F.lit("")).alias("target"),
        F.coalesce(F.get_json_object("details", "$.action"), F.lit("")).alias("action"),
        "created_at",
    )


def investigation_status(inv: DataFrame, ents: DataFrame, rels: DataFrame, activity: DataFrame) -> DataFrame:
    """Status, budget, counts and stop reason per investigation."""
    stats = graph_stats(ents, rels).withColumnRenamed("investigation_id", "id")
    reasons = stop_reasons(activity).withColumnRenamed("investigation_id", "id")
    rows = inv.select("id", "status", "api_calls_used", "api_budget").join(stats, "id", "left").join(reasons, "id", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_nodes", "total_edges")})
