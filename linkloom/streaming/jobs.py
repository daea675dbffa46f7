"""Streaming forms of the activity feed, correlation, deduplication and counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from linkloom import schemas
from linkloom.operators import extract, partials
from linkloom.plans.correlate import related
from linkloom.session import cut_lineage, scratch
from linkloom.sources.tables import bucket_of
from linkloom.streaming.store import BatchStore


def stream_activity(spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """New rows of the activity log as they are written."""
    reader = spark.readStream.schema(schemas.ACTIVITY).option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


def stream_observations(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int = 100
) -> DataFrame:
    reader = spark.readStream.schema(schemas.OBSERVATIONS).option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(path)


RESULTS = {
    "entities": schemas.ENTITIES,
    "relationships": schemas.RELATIONSHIPS,
    "entity_provenance": schemas.PROVENANCE,
}


def stream_correlate(
    observations: DataFrame,
    out: str,
    checkpoint: str,
    as_of: str,
    buckets: int = 64,
    fuzzy: bool = True,
    co_occurrence: bool = False,
    link_accounts: bool = True,
) -> StreamingQuery:
    """Correlates observations batch by batch; the result is that of one large batch.

    A batch parses its own observations only and adds their mergeable aggregates (``operators.partials``) to the store.
    Then the investigations that it touched are resolved, linked and scored anew from their aggregates, in which an
    entity is one row however often it was seen, and no payload is read again. An observation counts the first time
    that it comes. A batch that runs twice leaves the same tables; ``correlated`` reads them, ``compact_correlated`` folds
    old batches together.
    """
    spark = observations.sparkSession
    store = BatchStore(spark, out, buckets)

    def merge(batch_rows: DataFrame, batch: int) -> None:
        batch_rows.persist()
        try:
            if batch_rows.isEmpty():
                return
            # at most ``buckets`` numbers
            found = batch_rows.select(bucket_of("investigation_id", buckets).alias("b")).distinct().collect()
            with scratch(spark):
                _add_batch(store, batch_rows, batch, [r.b for r in found], as_of, fuzzy, co_occurrence, link_accounts)
        finally:
            batch_rows.unpersist()

    return (
        observations.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _add_batch(
    store: BatchStore, rows: DataFrame, batch: int, touched: list[int], as_of: str, fuzzy: bool, co_occurrence: bool,
    link_accounts: bool,
) -> None:
    ids = rows.select("investigation_id", "id").distinct()
    if batch > 0:
        before = store.rows("observations", ids.schema, batch - 1, touched).drop("batch")
        rows = rows.join(before, ["investigation_id", "id"], "left_anti")
        ids = rows.select("investigation_id", "id").distinct()
    adapters = extract.present_adapters(rows)
    said = cut_lineage(extract.said_in(rows, adapters=adapters), by=["what"])
    own = partials.partials(said).tables()
    for name, table in own.items():
        store.save(table, f"partial_{name}", batch)
    store.save(ids, "observations", batch)
    # Investigations of this batch, which a table of ids tells, not a list on the driver.
    investigations = ids.select("investigation_id").distinct()
    store.save(investigations, "touched", batch)
    mine = store.rows("touched", investigations.schema).where(F.col("batch") == batch).drop("batch")

    def stored(name: str) -> DataFrame:
        whole = store.rows(f"partial_{name}", own[name].schema, batch, touched).drop("batch")
        return whole.join(mine, "investigation_id", "left_semi").select(*own[name].columns)

    parts = partials.Partials(**{name: stored(name) for name in own})
    result = related(parts, as_of, fuzzy, co_occurrence, link_accounts)
    for name in RESULTS:
        store.save(result[name], name, batch)


def _struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _latest(store: BatchStore, name: str, schema: StructType) -> DataFrame:
    """Each investigation's rows of the batch that touched it last."""
    last = store.rows("touched", _struct("investigation_id STRING")).groupBy("investigation_id").agg(F.max("batch").alias("batch"))
    return store.rows(name, schema).join(last, ["investigation_id", "batch"]).select(*[f.name for f in schema.fields])


def correlated(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table that ``stream_correlate`` keeps: entities, relationships or entity_provenance."""
    return _latest(BatchStore(spark, out, 0), name, _struct(RESULTS[name]))


def compact_correlated(spark: SparkSession, out: str, upto: int, buckets: int = 64) -> None:
    """Folds the batches up to ``upto`` of a streamed correlation into one. No batch may be running."""
    store = BatchStore(spark, out, buckets)
    nothing = spark.createDataFrame([], schemas.OBSERVATIONS)
    kinds = partials.partials(extract.said_in(nothing, adapters=["dns"])).tables()

    def same(rows: DataFrame) -> DataFrame:
        return rows

    merges = {
        "entities": partials.merged_entities,
        "properties": partials.merged_properties,
        "edges": partials.merged_edges,
        "links": partials.merged_links,
    }
    tables = {f"partial_{name}": (rows.schema, merges.get(name, same)) for name, rows in kinds.items()}
    tables["observations"] = (_struct("investigation_id STRING, id STRING"), same)
    seen = _struct("investigation_id STRING")
    last = store.rows("touched", seen, upto).groupBy("investigation_id").agg(F.max("batch").alias("batch"))
    for name, ddl in RESULTS.items():
        tables[name] = (_struct(ddl), lambda rows: rows.join(last, ["investigation_id", "batch"], "left_semi"))
    tables["touched"] = (seen, lambda rows: rows.select("investigation_id").distinct())
    store.compact(tables, upto)


def stream_dedupe(
    observations: DataFrame, keys: list[str], time_col: str, ttl_seconds: int, exact: bool = True
) -> DataFrame:
    """Drops repeats of a key within the time to live of the row kept last.

    The exact form remembers when a key was last kept and forgets it once the watermark has passed the time to live.
    ``exact=False`` uses Spark's own deduplication, which stays in the JVM but may drop rows up to twice the time to
    live after the first one, because its state lives until the watermark reaches it.
    """
    rows = observations.withWatermark(time_col, f"{ttl_seconds} seconds")
    if not exact:
        return rows.dropDuplicatesWithinWatermark(keys)
    span = ttl_seconds * 1000

    def step(_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(time_col, kind="stable")
        keep = []
        for at in rows[time_col].astype("datetime64[ms]").astype("int64"):
            ok = last is None or at >= last + span
            last = at if ok else last
            keep.append(ok)
        yield rows[keep]
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) + span, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy(*keys).applyInPandasWithState(
        step, observations.schema, "last BIGINT", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_rates(
    observations: DataFrame, key: str, time_col: str, window: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Calls per collector and time window; a window is final once the watermark has passed it."""
    span = F.window(time_col, window, slide) if slide else F.window(time_col, window)
    counted = observations.withWatermark(time_col, late).groupBy(span, key).agg(F.count("*").alias("calls"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "calls")


def activity_sessions(activity: DataFrame, gap: str, key: str = "investigation_id", time_col: str = "created_at",
                      late: str | None = None) -> DataFrame:
    """Spans of activity with no gap longer than ``gap``; works on tables and, with ``late``, on streams."""
    rows = activity.withWatermark(time_col, late) if late else activity
    found = rows.groupBy(F.session_window(time_col, gap), key).agg(F.count("*").alias("events"))
    return found.select(
        key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events"
    )


def call_budget(activity: DataFrame, budgets: DataFrame, calls_col: str = "calls") -> DataFrame:
    """Calls used and left per investigation; on a stream, running totals in update mode."""
    used = activity.groupBy("investigation_id").agg(F.sum(calls_col).alias("calls_used"))
    joined = used.join(budgets, "investigation_id")
    return joined.withColumn("budget_left", F.greatest(F.lit(0), F.col("api_budget") - F.col("calls_used")))


ORPHAN_DETAILS = '{"stop_reason": "inactive", "message": "No activity within the time limit."}'


def reconcile_orphans(inv: DataFrame, activity: DataFrame, as_of: str, timeout: str) -> tuple[DataFrame, DataFrame]:
    """Running investigations without recent activity become stopped; returns investigations and new activity rows."""
    now = F.lit(as_of).cast("timestamp")
    last = activity.groupBy(F.col("investigation_id").alias("id")).agg(F.max("created_at").alias("_last"))
    seen = inv.join(last, "id", "left").withColumn("_last", F.coalesce("_last", "created_at"))
    orphan = (F.col("status") == "running") & (F.col("_last") < now - F.expr(f"INTERVAL {timeout}"))
    marked = seen.withColumn("_orphan", F.coalesce(orphan, F.lit(False)))
    updated = (
        marked.withColumn("status", F.when(F.col("_orphan"), "stopped").otherwise(F.col("status")))
        .withColumn("updated_at", F.when(F.col("_orphan"), now).otherwise(F.col("updated_at")))
        .select(*inv.columns)
    )
    rows = marked.where("_orphan").select(
        F.col("id").alias("investigation_id"),
        F.lit("investigation_reconciled").alias("event_type"),
        F.lit(ORPHAN_DETAILS).alias("details"),
        now.alias("created_at"),
    )
    return updated, rows


def stream_orphans(activity: DataFrame, timeout_ms: int, late: str = "1 minute") -> DataFrame:
    """Emits an investigation once when no activity came for the time limit in event time."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"investigation_id": [key[0]], "last_activity_ms": [last]})
            return
        newest = max(int(batch["at_ms"].max()) for batch in rows)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        if newest + timeout_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(newest + timeout_ms)
        else:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)

    rows = activity.withWatermark("created_at", late).withColumn("at_ms", F.unix_millis("created_at"))
    return (
        rows.select("investigation_id", "created_at", "at_ms")
        .groupBy("investigation_id")
        .applyInPandasWithState(
            step,
            "investigation_id STRING, last_activity_ms BIGINT",
            "last BIGINT",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def stream_reconcile(
    activity: DataFrame, investigations: DataFrame, out: str, checkpoint: str, timeout_ms: int, late: str = "1 minute",
    buckets: int = 16,
) -> StreamingQuery:
    """Stops running investigations when event-time timers find them without activity for the time limit.

    A batch appends the investigations that it stops and their activity rows, both under its number, so a batch that runs
    twice changes nothing; ``reconciled`` reads both.
    """
    store = BatchStore(activity.sparkSession, out, buckets)

    def add(found: DataFrame, batch: int) -> None:
        running = investigations.where(F.col("status") == "running").select(F.col("id").alias("investigation_id"))
        at = F.timestamp_millis(F.col("last_activity_ms") + timeout_ms)
        stopped = found.join(running, "investigation_id").select("investigation_id", at.alias("stopped_at"))
        stopped = stopped.persist()
        try:
            store.save(stopped, "stopped", batch)
            rows = stopped.select(
                "investigation_id", F.lit("investigation_reconciled").alias("event_type"),
                F.lit(ORPHAN_DETAILS).alias("details"), F.col("stopped_at").alias("created_at"),
            )
            store.save(rows, "activity", batch)
        finally:
            stopped.unpersist()

    orphans = stream_orphans(activity, timeout_ms, late)
    run = orphans.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return run.trigger(availableNow=True).start()


def reconciled(spark: SparkSession, investigations: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Investigations with those stopped that ``stream_reconcile`` has stopped, and the activity rows that say so; one
    that was found again in a later batch counts once, the first time."""
    store = BatchStore(spark, out, 0)
    first = ["investigation_id"]
    stopped = store.rows("stopped", _struct("investigation_id STRING, stopped_at TIMESTAMP")).groupBy(*first)
    stopped = stopped.agg(F.min("stopped_at").alias("_at")).withColumnRenamed("investigation_id", "id")
    updated = investigations.join(stopped, "id", "left")
    gone = F.col("_at").isNotNull()
    updated = updated.withColumns(
        {
            "status": F.when(gone, "stopped").otherwise(F.col("status")),
            "updated_at": F.coalesce("_at", "updated_at"),
        }
    ).select(*investigations.columns)
    ddl = "investigation_id STRING, event_type STRING, details STRING, created_at TIMESTAMP"
    rows = store.rows("activity", _struct(ddl)).groupBy("investigation_id", "event_type", "details")
    return updated, rows.agg(F.min("created_at").alias("created_at"))


BUDGETS = "investigation_id STRING, calls_used BIGINT, api_budget INT, budget_left BIGINT"


def stream_budgets(
    activity: DataFrame, budgets: DataFrame, out: str, checkpoint: str, calls_col: str = "calls", buckets: int = 16
) -> StreamingQuery:
    """Running totals against budgets: each batch writes the rows of the investigations that it changed, joined to the
    budgets as they are then, under its number. ``budgets_now`` reads the newest row of each."""
    store = BatchStore(activity.sparkSession, out, buckets)
    names = [x.split()[0] for x in BUDGETS.split(", ")]

    def add(rows: DataFrame, batch: int) -> None:
        joined = rows.join(budgets.select("investigation_id", F.col("api_budget").cast("int").alias("api_budget")), "investigation_id")
        left = F.greatest(F.lit(0), F.col("api_budget") - F.col("calls_used")).cast("bigint")
        store.save(joined.withColumn("budget_left", left).select(*names), "budgets", batch)

    used = activity.groupBy("investigation_id").agg(F.sum(calls_col).cast("bigint").alias("calls_used"))
    run = used.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint)
    return run.trigger(availableNow=True).start()


def budgets_now(spark: SparkSession, out: str) -> DataFrame:
    rows = BatchStore(spark, out, 0).rows("budgets", _struct(BUDGETS))
    names = [x.split()[0] for x in BUDGETS.split(", ")][1:]
    newest = rows.groupBy("investigation_id").agg(F.max_by(F.struct(*names), "batch").alias("_r"))
    return newest.select("investigation_id", "_r.*")
