"""Streams give what the batch jobs give."""

import datetime as dt
import json

from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.plans.correlate import correlate
from linkloom.streaming import jobs
from linkloom.streaming.store import BatchStore

T = dt.datetime(2024, 1, 1)


def run(df, spark, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def write(spark, rows, schema, path, part):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/p={part}")


def activity(spark, path, rows):
    """One file per row, in order."""
    for n, (inv, minutes) in enumerate(rows):
        df = spark.createDataFrame([(n, inv, "e", "{}", T + dt.timedelta(minutes=minutes))], schemas.ACTIVITY)
        df.coalesce(1).write.mode("append").parquet(path)


def observation(i, target, ip):
    payload = json.dumps({"A": [ip], "NS": ["ns.example.net"]})
    return (f"00000000-0000-4000-8000-{i:012d}", f"inv{i % 3}", "dns", "1", T + dt.timedelta(minutes=i), "api", target,
            payload, None, 0.5, "success", None, T)


def profile(i, platform, handle, **fields):
    payload = json.dumps({"found": True, "profile": {"username": handle, "name": handle, **fields}})
    return (f"00000000-0000-4000-9000-{i:012d}", f"inv{i % 2}", platform, "1", T + dt.timedelta(minutes=i), "api", handle,
            payload, None, 0.6, "success", None, T)


def same_tables(spark, out, batch):
    for name, table in batch.items():
        want = sorted(map(str, table.collect()))
        got = sorted(map(str, jobs.correlated(spark, out, name).select(table.columns).collect()))
        assert got == want, name


def test_incremental_correlation_equals_one_batch(spark, tmp_path):
    """DNS, profiles of one person on two platforms in different batches, and a file that repeats observations."""
    rows = [observation(i, f"d{i % 4}.example.com", f"198.51.100.{i % 5}") for i in range(12)]
    about = {"full_name": "Ann Lee", "email": "ann@example.org", "organization": "Acme"}
    people = [profile(k, p, "AnnLee", **about) for k, p in ((0, "gitlab"), (2, "keybase"), (1, "gitlab"), (4, "reddit"))]
    files = [rows[:5] + people[:1], rows[5:9] + people[1:3], rows[:3] + people[:2], rows[9:] + people[3:]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in files:
        spark.createDataFrame(part, schemas.OBSERVATIONS).coalesce(1).write.mode("append").parquet(source)
    state, now = str(tmp_path / "state"), "2024-02-01 00:00:00"

    def run():
        stream = jobs.stream_observations(spark, source, files_per_trigger=1)
        jobs.stream_correlate(stream, out, state, now, buckets=4, fuzzy=False, co_occurrence=True).awaitTermination()

    run()
    batch = correlate(spark.createDataFrame(rows + people, schemas.OBSERVATIONS), now, fuzzy=False, co_occurrence=True)
    same_tables(spark, out, batch)
    methods = {r.method for r in batch["relationships"].select("method").distinct().collect()}
    assert {"co_occurrence", "dns_a_record", ""} <= methods
    kinds = {r.relationship_type for r in batch["relationships"].select("relationship_type").distinct().collect()}
    assert "same_person" in kinds
    # Old batches become a base; what comes later merges with it.
    jobs.compact_correlated(spark, out, 2, buckets=4)
    same_tables(spark, out, batch)
    late = [observation(20, "d1.example.com", "198.51.100.9"), profile(6, "hackernews", "AnnLee", **about)]
    spark.createDataFrame(late, schemas.OBSERVATIONS).coalesce(1).write.mode("append").parquet(source)
    run()
    same_tables(spark, out, correlate(spark.createDataFrame(rows + people + late, schemas.OBSERVATIONS), now, fuzzy=False, co_occurrence=True))


def test_a_batch_that_runs_twice(spark, tmp_path):
    rows = [observation(i, "d.example.com", f"198.51.100.{i}") for i in range(6)]
    first, second = (spark.createDataFrame(r, schemas.OBSERVATIONS) for r in (rows[:4], rows[4:]))
    store = BatchStore(spark, str(tmp_path), 4)
    now = "2024-02-01 00:00:00"
    for batch, df in ((0, first), (1, second), (1, second)):
        jobs._add_batch(store, df, batch, [0, 1, 2, 3], now, False, False, True)
    same_tables(spark, str(tmp_path), correlate(first.unionByName(second), now, fuzzy=False))


def test_stream_dedupe_and_rates(spark, tmp_path):
    path = str(tmp_path / "act")
    activity(spark, path, [("a", 0), ("a", 10), ("b", 20), ("a", 200), ("a", 205)])
    feed = jobs.stream_activity(spark, path, files_per_trigger=1)
    kept = run(jobs.stream_dedupe(feed, ["investigation_id"], "created_at", 3600), spark, "kept")
    assert sorted((r.investigation_id, r.created_at.hour) for r in kept.collect()) == [("a", 0), ("a", 3), ("b", 0)]
    rates = run(jobs.stream_rates(feed, "investigation_id", "created_at", "1 hour"), spark, "rates")
    assert {(r.investigation_id, r.start.hour, r.calls) for r in rates.collect()} == {("a", 0, 2), ("b", 0, 1)}


def test_stream_orphans_and_sessions(spark, tmp_path):
    path = str(tmp_path / "act")
    activity(spark, path, [("a", 0), ("b", 5), ("b", 50), ("c", 300), ("c", 301)])
    feed = jobs.stream_activity(spark, path, files_per_trigger=1)
    gone = run(jobs.stream_orphans(feed, 60 * 60 * 1000), spark, "gone")
    assert sorted(r.investigation_id for r in gone.collect()) == ["a", "b"]
    sessions = run(jobs.activity_sessions(feed, "30 minutes", late="1 minute"), spark, "sessions")
    assert sorted((r.investigation_id, r.events) for r in sessions.collect()) == [("a", 1), ("b", 1), ("b", 1)]
    budgets = spark.createDataFrame([("a", 3), ("b", 1), ("c", 9)], "investigation_id string, api_budget int")
    used = run(jobs.call_budget(feed.withColumn("calls", F.lit(1)), budgets, "calls"), spark, "used", "complete")
    assert {(r.investigation_id, r.calls_used, r.budget_left) for r in used.collect()} == {("a", 1, 2), ("b", 2, 0), ("c", 2, 7)}


def test_orphans_in_a_table(spark):
    inv = spark.createDataFrame(
        [(k, k, "", "domain", s, "deep", 0, 1, 0, 0, 0, T, T) for k, s in (("a", "running"), ("b", "running"), ("c", "paused"))],
        schemas.INVESTIGATIONS,
    )
    acts = spark.createDataFrame([(1, "b", "e", "{}", T + dt.timedelta(hours=5))], schemas.ACTIVITY)
    updated, rows = jobs.reconcile_orphans(inv, acts, "2024-01-01 06:00:00", "2 HOURS")
    assert {r.id: r.status for r in updated.collect()} == {"a": "stopped", "b": "running", "c": "paused"}
    assert [r.investigation_id for r in rows.collect()] == ["a"]
