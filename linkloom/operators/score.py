"""Confidence of entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed


#: Own weights of sources: by name, or a table (source, weight) of which the highest weight of a source counts.
Overrides = dict[str, float] | DataFrame | None


def _lookup(weights: dict[str, float], key: Column, own: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    found = F.coalesce(F.try_element_at(table, key), F.lit(fixed.DEFAULT_RELIABILITY))
    return found if own is None else F.coalesce(F.try_element_at(own, key), found)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def own_weights(overrides: DataFrame) -> Column:
    """A table (source, weight) as one map for all rows; there are no more sources than collectors."""
    each = overrides.groupBy("source").agg(F.max(F.col("weight").cast("double")).alias("weight"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("source", "weight")))).scalar()


def reliability(sources: Column, overrides: dict[str, float] | None = None, own: Column | None = None) -> Column:
    """Mean trust in the sources; a map ``own`` of weights comes before all others."""
    weights = {**fixed.SOURCE_RELIABILITY, **(overrides or {})}
    total = F.aggregate(sources, F.lit(0.0), lambda acc, s: acc + _lookup(weights, s, own))
    return F.when(F.size(sources) > 0, total / F.size(sources)).otherwise(F.lit(fixed.DEFAULT_RELIABILITY))


def quality(source_count: Column, evidence_count: Column, property_count: Column) -> Column:
    """How complete an entity is."""
    by_sources = (
        F.when(source_count >= 3, 0.15).when(source_count == 2, 0.10).when(source_count == 1, 0.05).otherwise(0.0)
    )
    by_evidence = F.when(evidence_count >= 2, 0.10).when(evidence_count == 1, 0.05).otherwise(0.0)
    by_properties = F.least(F.lit(0.05), property_count * 0.01)
    return F.least(F.lit(1.0), F.lit(0.7) + by_sources + by_evidence + by_properties)


def corroboration(distinct: Column) -> Column:
    return F.when(distinct >= 3, 1.15).when(distinct == 2, 1.08).otherwise(1.0)


def recency(seen: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of) - F.unix_micros(seen.cast("timestamp"))) / F.lit(86_400_000_000)
    factor = F.when(seen.isNull(), fixed.RECENCY_UNKNOWN)
    for limit, value in fixed.RECENCY_STEPS:
        factor = factor.when(days <= limit, value)
    return factor.otherwise(fixed.RECENCY_OLDEST)


def _time(as_of: str | Column) -> Column:
    return F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of


def score_entities(ents: DataFrame, as_of: str | Column, overrides: Overrides = None) -> DataFrame:
    """Replaces ``confidence`` by reliability x quality x corroboration x recency."""
    rows, trust = ents, None
    if isinstance(overrides, DataFrame):
        rows = ents.withColumn("_own", own_weights(overrides))
        trust = reliability(F.col("sources"), own=F.col("_own"))
    score = (
        (trust if trust is not None else reliability(F.col("sources"), overrides))
        * quality(F.size("sources"), F.col("evidence_count"), F.size(F.map_keys("properties")))
        * corroboration(F.size(F.array_distinct("sources")))
        * recency(F.col("last_seen"), _time(as_of))
    )
    return rows.withColumn("confidence", clamp(score)).select(*ents.columns)


def score_relationships(rels: DataFrame, ents: DataFrame | None, as_of: str | Column) -> DataFrame:
    """Replaces ``confidence`` of edges; two known end points lift it by their mean confidence."""
    keys = ["investigation_id"]
    rows = rels.withColumns({c: F.lit(None).cast("double") for c in ("_src", "_tgt")})
    if ents is not None:
        trust = ents.select(*keys, "id", "confidence")
        src = trust.select(*keys, F.col("id").alias("source_id"), F.col("confidence").alias("_src"))
        tgt = trust.select(*keys, F.col("id").alias("target_id"), F.col("confidence").alias("_tgt"))
        rows = rels.join(src, [*keys, "source_id"], "left").join(tgt, [*keys, "target_id"], "left")
    return score_between(rows, as_of).select(*rels.columns)


def score_between(rows: DataFrame, as_of: str | Column) -> DataFrame:
    """``score_relationships`` of edges that have the confidence of their ends beside them, as ``_src`` and ``_tgt``."""
    mean = (F.col("_src") + F.col("_tgt")) / 2
    boost = F.when(mean.isNotNull(), F.lit(0.8) + mean * 0.2).otherwise(1.0)
    score = (
        _lookup(fixed.METHOD_RELIABILITY, F.coalesce("method", F.lit("")))
        * corroboration(F.col("evidence_count"))
        * boost
        * recency(F.col("discovered_at"), _time(as_of))
    )
    return rows.withColumn("confidence", clamp(score)).drop("_src", "_tgt")


def score_all(
    ents: DataFrame, rels: DataFrame, as_of: str | Column, overrides: Overrides = None
) -> tuple[DataFrame, DataFrame]:
    """Entities first: edges are lifted by the new entity scores."""
    scored = score_entities(ents, as_of, overrides)
    return scored, score_relationships(rels, scored, as_of)


def apply_overrides(ents: DataFrame, overrides: DataFrame) -> DataFrame:
    """The latest manual override of an entity replaces its confidence."""
    latest = overrides.groupBy("investigation_id", F.col("entity_id").alias("id")).agg(
        F.max_by("override_confidence", F.struct("created_at", F.col("id"))).alias("_override")
    )
    joined = ents.join(latest, ["investigation_id", "id"], "left")
    return joined.withColumn("confidence", F.coalesce("_override", "confidence")).select(*ents.columns)


def override_rows(ents: DataFrame, wanted: DataFrame, created_at: Column) -> DataFrame:
    """Override log rows for (investigation_id, entity_id, override_confidence, reason); out-of-range ones are dropped."""
    current = ents.select("investigation_id", F.col("id").alias("entity_id"), F.col("confidence").alias("original_confidence"))
    valid = wanted.where(F.col("override_confidence").between(0.0, 1.0))
    return valid.join(current, ["investigation_id", "entity_id"]).select(
        F.uuid().alias("id"),
        "entity_id",
        "investigation_id",
        "original_confidence",
        "override_confidence",
        "reason",
        created_at.alias("created_at"),
    )


def threat_score(abuse: Column, url_status: Column, has_url: Column) -> Column:
    """Highest of the abuse score and the rating of the URL status."""
    rated = F.when(url_status == "online", 0.9).when(url_status == "offline", 0.5).otherwise(0.7)
    return F.coalesce(F.greatest(abuse / 100.0, F.when(has_url, rated)), F.lit(0.0))
