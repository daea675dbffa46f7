"""What is read or grouped once stays so."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from linkloom.catalog.derive import observations
from linkloom.catalog.resolving import _accounts
from linkloom.operators import accounts, extract, partials, resolve
from linkloom.streaming.store import BatchStore


def test_entity_context_reads_stored_tables(spark, sf_dir):
    """The joins read entities and relationships, not the events that both are made from, time and again."""
    found = entry.queries()["q4_entity_context_rows"](spark, sf_dir)
    assert found.inputFiles() and not [f for f in found.inputFiles() if "events" in f]


def test_only_stating_adapters_are_read_for_edges(spark, sf_dir):
    edges = extract.extract_all(observations(spark, sf_dir, "dns", "github"))[1]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter .*source_adapter#\d+ IN \(", plan)


def test_sightings_are_grouped_once(spark, sf_dir):
    """Pairs are columns of the sightings that entities are made from, those of accounts among them."""
    obs = observations(spark, sf_dir, "gitlab", "reddit")
    said = extract.said_in(obs, adapters=["gitlab", "reddit"])
    now = F.lit("2024-02-01").cast("timestamp")
    mentions, _ = accounts.account_entities(extract.accounts_of(said), now)
    parts = partials.partials(said, mentions)
    assert "Aggregate" not in parts.pairs._jdf.queryExecution().optimizedPlan().toString()
    known = mentions.unionByName(extract.mentions_of(said)).select("investigation_id", "id", "observation_id").distinct()
    assert parts.pairs.count() == known.count()
    assert parts.entities.agg(F.sum("evidence_count")).first()[0] == known.count()


def test_a_batch_is_saved_without_a_shuffle(spark, tmp_path):
    rows = spark.range(100).selectExpr("'inv' || id % 7 AS investigation_id", "id").repartition(3)
    store = BatchStore(spark, str(tmp_path), 4)
    store.save(rows, "rows", 0)
    files = list(tmp_path.glob("rows/batch=0/bucket=*/*.parquet"))
    tasks = {f.name.split("-")[1] for f in files}
    assert len(tasks) == 3
    kept = store.rows("rows", rows.schema).drop("batch")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect()))


def test_accounts_of_one_row_group_are_dealt_to_all_tasks(spark, sf_dir):
    held = _accounts(spark, sf_dir).select(F.spark_partition_id().alias("task"), "observation_id").groupBy("task").count()
    assert held.count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_key_of_one_member_is_left_out_before_pairs_are_joined(spark):
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "g string, m string")
    pairs = resolve.member_pairs(members, ["g"], "m")
    assert re.search(r"_n#\d+L > 1", pairs._jdf.queryExecution().optimizedPlan().toString())
    assert [tuple(r) for r in pairs.collect()] == [("g", "a", "b")]
