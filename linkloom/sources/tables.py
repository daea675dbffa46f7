"""Keeping the stored tables up to date: upserts, manual rows, deletes, idempotent writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import values

KEY = ["investigation_id", "id"]


def _latest(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables; where a key is in both, the incoming row stays."""
    names = current.columns
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.select(*names).withColumn("_new", F.lit(1)))
    others = [c for c in names if c not in keys]
    rows = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("_new")).alias("_r"))
    return rows.select(*keys, "_r.*").select(*names)


def upsert_entities(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merges entity tables by (investigation, id): incoming values win, but the time span only grows."""
    merged = _latest(current, incoming, KEY)
    span = (
        current.select(*KEY, "first_seen", "last_seen")
        .unionByName(incoming.select(*KEY, "first_seen", "last_seen"))
        .groupBy(*KEY)
        .agg(F.min("first_seen").alias("_first"), F.max("last_seen").alias("_last"))
    )
    return (
        merged.join(span, KEY)
        .withColumn("first_seen", F.col("_first"))
        .withColumn("last_seen", F.col("_last"))
        .select(*current.columns)
    )


def upsert_relationships(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merges edge tables by (investigation, id); the incoming confidence, evidence and method stay."""
    return _latest(current, incoming, KEY)


def upsert_notes(current: DataFrame, incoming: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Notes with created, changed and deleted rows applied; a changed note keeps its creation time."""
    created = current.select("id", F.col("created_at").alias("_created"))
    rows = _latest(current, incoming, ["id"]).join(created, "id", "left")
    rows = rows.withColumn("created_at", F.coalesce("_created", "created_at")).select(*current.columns)
    return rows if deleted is None else rows.join(deleted.select("id"), "id", "left_anti")


def new_provenance(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Provenance rows that are not stored yet."""
    return found.join(existing.select("entity_id", "observation_id"), ["entity_id", "observation_id"], "left_anti")


def add_entities(rows: DataFrame, now: Column) -> DataFrame:
    """Entities written by hand (investigation_id, type, value, confidence, properties); out-of-range ones are dropped."""
    valid = rows.where(F.col("confidence").between(0.0, 1.0) & (F.coalesce("value", F.lit("")) != ""))
    return valid.select(
        values.entity_id(F.col("type"), F.col("value")).alias("id"),
        "investigation_id",
        "type",
        "value",
        "confidence",
        now.alias("first_seen"),
        now.alias("last_seen"),
        F.lit(1).alias("source_count"),
        F.array(F.lit("manual")).alias("sources"),
        F.lit(0).cast("bigint").alias("evidence_count"),
        "properties",
    )


def add_relationships(rows: DataFrame, now: Column) -> DataFrame:
    """Edges written by hand (investigation_id, source_id, target_id, relationship_type, confidence)."""
    valid = rows.where(
        F.col("confidence").between(0.0, 1.0)
        & (F.coalesce("source_id", F.lit("")) != "")
        & (F.coalesce("target_id", F.lit("")) != "")
    )
    return valid.select(
        F.concat_ws(":", "source_id", F.lower("relationship_type"), "target_id").alias("id"),
        "investigation_id",
        "source_id",
        "target_id",
        F.lower("relationship_type").alias("relationship_type"),
        "confidence",
        F.lit(0).cast("bigint").alias("evidence_count"),
        now.alias("discovered_at"),
        F.lit("manual").alias("method"),
    )


def delete_investigation(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given investigations (column ``id``); running ones are not deleted."""
    running = tables["investigations"].where(F.col("status") == "running").select("id")
    gone = ids.select("id").distinct().join(running, "id", "left_anti")
    by_reference = gone.withColumnRenamed("id", "investigation_id")
    return {
        name: table.join(gone, "id", "left_anti")
        if name == "investigations"
        else table.join(by_reference, "investigation_id", "left_anti").select(*table.columns)
        for name, table in tables.items()
    }


def bucket_of(column: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets).cast("bigint")).cast("int")


def write_bucketed(df: DataFrame, path: str, buckets: int, by: str = "investigation_id") -> None:
    """Replaces only the partitions whose buckets occur in the rows, so a repeated write changes nothing.

    A bucket is written by as many tasks as its rows need; one investigation may hold most of them.
    """
    rows = df.withColumn("bucket", bucket_of(by, buckets))
    rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(path)
