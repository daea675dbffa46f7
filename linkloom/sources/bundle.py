"""Whole investigations as bundles of JSON lines, and back into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import values
from linkloom.operators.ordering import first_rows

SECTIONS = ["investigation", "observations", "entities", "activity_log", "relationships"]

_OBSERVATION = (
    "source_adapter STRING, source_version STRING, collected_at TIMESTAMP, method STRING, target STRING, "
    "raw_response STRING, normalized_value STRING, confidence DOUBLE, status STRING, error_message STRING"
)
_ENTITY = (
    "type STRING, value STRING, confidence DOUBLE, first_seen TIMESTAMP, last_seen TIMESTAMP, source_count INT, "
    "properties MAP<STRING,STRING>"
)
_ACTIVITY = "event_type STRING, details STRING, created_at TIMESTAMP"
_INVESTIGATION = "id STRING, name STRING, target STRING, target_type STRING, depth STRING, api_budget INT"
_EDGE = (
    "id STRING, source STRING, target STRING, relationship_type STRING, confidence DOUBLE, discovered_at TIMESTAMP, "
    "method STRING"
)
DOCUMENT = (
    f"investigation STRUCT<{_INVESTIGATION}>, observations ARRAY<STRUCT<{_OBSERVATION}>>, "
    f"entities ARRAY<STRUCT<{_ENTITY}>>, activity_log ARRAY<STRUCT<{_ACTIVITY}>>, "
    f"graph STRUCT<edges ARRAY<STRUCT<data STRUCT<{_EDGE}>>>>"
)


def export_bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """Every record of every investigation as one line: investigation_id, section, record (JSON).

    Written partitioned by investigation, these are one bundle each; no bundle is ever gathered in one place.
    """
    out = None
    for section in SECTIONS:
        table = tables["investigations" if section == "investigation" else section]
        key = F.col("id") if section == "investigation" else F.col("investigation_id")
        rows = table.select(
            key.alias("investigation_id"), F.lit(section).alias("section"), F.to_json(F.struct("*")).alias("record")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def write_bundle(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").partitionBy("investigation_id", "section").text(path)


def _new_id(old: Column, salt: str) -> Column:
    """A new id that is the same for every table and every retry of one import."""
    h = F.sha1(F.concat_ws(":", F.lit(salt), old))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def _tables(
    inv: DataFrame, obs: DataFrame, ents: DataFrame, acts: DataFrame, rels: DataFrame, salt: str, now: Column
) -> dict[str, DataFrame]:
    """Re-keyed tables: new ids, status 'created', counters as imported, entity ids from type and value."""
    key = "investigation_id"

    def again(df: DataFrame) -> DataFrame:
        return df.withColumn(key, _new_id(F.col(key), salt))

    observations = again(obs).withColumn("id", F.uuid())
    kind, value = F.coalesce("type", F.lit("unknown")), F.coalesce("value", F.lit(""))
    # Of entities with one type and value the most certain one counts, then the first by its other fields.
    rest = F.to_json(F.struct("value", "first_seen", "last_seen", "source_count", "properties"))
    named = again(ents).withColumn("id", values.entity_id(kind, value))
    entities = first_rows(named, [key, "id"], [F.desc_nulls_last("confidence"), rest])
    relationships = again(rels).select(
        key,
        F.coalesce("id", F.concat_ws(":", "source", "relationship_type", "target")).alias("id"),
        F.coalesce("source", F.lit("")).alias("source_id"),
        F.coalesce("target", F.lit("")).alias("target_id"),
        F.lower(F.coalesce("relationship_type", F.lit("co_occurs_with"))).alias("relationship_type"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("discovered_at", now).alias("discovered_at"),
        F.coalesce("method", F.lit("import")).alias("method"),
    )
    counts = (
        obs.select(key, F.lit(1).alias("o"), F.lit(0).alias("e"))
        .unionAll(ents.select(key, F.lit(0), F.lit(1)))
        .groupBy(key)
        .agg(F.sum("o").alias("observation_count"), F.sum("e").alias("entity_count"))
    )
    investigations = (
        inv.join(counts, key, "left")
        .select(
            _new_id(F.col(key), salt).alias("id"),
            F.coalesce("name", F.lit("Imported Investigation")).alias("name"),
            F.coalesce("target", F.lit("")).alias("target"),
            F.coalesce("target_type", F.lit("unknown")).alias("target_type"),
            F.lit("created").alias("status"),
            F.coalesce("depth", F.lit("standard")).alias("depth"),
            F.lit(0).alias("api_calls_used"),
            F.coalesce("api_budget", F.lit(100)).alias("api_budget"),
            F.coalesce("entity_count", F.lit(0)).alias("entity_count"),
            F.lit(0).cast("bigint").alias("relationship_count"),
            F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
            now.alias("created_at"),
            now.alias("updated_at"),
        )
    )
    return {
        "investigations": investigations,
        "observations": observations.withColumn("status", F.coalesce("status", F.lit("success"))),
        "entities": entities.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))),
        "activity_log": again(acts).withColumn("created_at", F.coalesce("created_at", now)),
        "relationships": relationships,
    }


def import_bundle(spark: SparkSession, path: str, salt: str, now: Column | None = None) -> dict[str, DataFrame]:
    """Tables from exported documents, one JSON document per investigation; ``salt`` names the import."""
    now = now if now is not None else F.current_timestamp()
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    docs = docs.withColumn("investigation_id", F.coalesce("investigation.id", F.input_file_name()))
    key = "investigation_id"
    return _tables(
        docs.select(key, "investigation.*").drop("id"),
        docs.select(key, F.inline("observations")),
        docs.select(key, F.inline("entities")),
        docs.select(key, F.inline("activity_log")),
        docs.select(key, F.explode("graph.edges").alias("e")).select(key, "e.data.*"),
        salt,
        now,
    )


def import_lines(lines: DataFrame, salt: str, now: Column | None = None) -> dict[str, DataFrame]:
    """Tables from bundle lines as export_bundle makes them."""
    now = now if now is not None else F.current_timestamp()
    key = "investigation_id"

    def section(name: str, schema: str) -> DataFrame:
        rows = lines.where(F.col("section") == name)
        return rows.select(key, F.from_json("record", schema).alias("r")).select(key, "r.*")

    edges = section(
        "relationships",
        _EDGE.replace("source STRING", "source_id STRING").replace("target STRING", "target_id STRING"),
    ).withColumnsRenamed({"source_id": "source", "target_id": "target"})
    return _tables(
        section("investigation", _INVESTIGATION).drop("id"),
        section("observations", _OBSERVATION),
        section("entities", _ENTITY),
        section("activity_log", _ACTIVITY),
        edges,
        salt,
        now,
    )
