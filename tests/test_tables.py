"""Bundles, STIX, reports, platform rules, upserts and deletes."""

import datetime as dt
import json
import uuid

from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.functions import fixed
from linkloom.operators import pages, report
from linkloom.sources import bundle, observations, reports, stix, tables

T = dt.datetime(2024, 1, 1)
def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def model(spark):
    return {
        "investigations": spark.createDataFrame(
            [("a", "A", "a.com", "domain", "completed", "deep", 5, 10, 0, 0, 0, T, T),
             ("b", "B", "b.com", "domain", "running", "deep", 5, 10, 0, 0, 0, T, T)], schemas.INVESTIGATIONS),
        "observations": spark.createDataFrame(
            [(f"o{i}", k, "dns", "1", T, "api", f"{k}.com", "{}", None, 0.5, "success", None, T)
             for i, k in enumerate("aab")], schemas.OBSERVATIONS),
        "entities": spark.createDataFrame(
            [("domain:a.com", "a", "Domain", "a.com", 0.9, T, T, 1, ["dns"], 1, {}),
             ("asn:AS5", "a", "ASN", "AS5", 0.29, T, T, 1, ["dns"], 1, {}),
             ("person:Ann", "b", "Person", "Ann", 0.5, T, T, 1, ["dns"], 1, {})], schemas.ENTITIES),
        "relationships": spark.createDataFrame(
            [("domain:a.com:belongs_to_asn:asn:AS5", "a", "domain:a.com", "asn:AS5", "BELONGS_TO_ASN", 0.8, 1, T, "m")],
            schemas.RELATIONSHIPS),
        "activity_log": spark.createDataFrame([(1, "a", "started", "{}", T)], schemas.ACTIVITY),
    }


def test_bundle_lines_come_back(spark):
    m = model(spark)
    back = bundle.import_lines(bundle.export_bundle(m), "run1", now())
    inv = {r.name: r for r in back["investigations"].collect()}
    assert inv["A"].status == inv["B"].status == "created" and inv["A"].api_calls_used == 0
    assert (inv["A"].entity_count, inv["A"].observation_count) == (2, 2)
    assert inv["A"].id != "a"
    assert {r.investigation_id for r in back["entities"].where("type = 'ASN'").collect()} == {inv["A"].id}
    assert back["relationships"].first().relationship_type == "belongs_to_asn"
    assert back["observations"].count() == 3


def test_bundle_documents(spark, tmp_path):
    doc = {
        "investigation": {"id": "x", "name": "X", "target": "x.com"},
        "observations": [{"source_adapter": "dns", "target": "x.com", "raw_response": {"A": ["1.1.1.1"]}}],
        "entities": [{"type": "Domain", "value": "x.com", "confidence": 0.5}, {"type": "Domain", "value": "x.com"}],
        "activity_log": [{"event_type": "started", "details": {"a": 1}}],
        "graph": {"edges": [{"data": {"source": "domain:x.com", "target": "ip:1.1.1.1", "relationship_type": "HOSTED_ON"}}]},
    }
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=1))
    back = bundle.import_bundle(spark, str(tmp_path), "run2", now())
    assert [r.id for r in back["entities"].collect()] == ["domain:x.com"]
    row = back["investigations"].first()
    assert (row.target_type, row.depth, row.entity_count, row.status) == ("unknown", "standard", 2, "created")
    assert json.loads(back["observations"].first().raw_response) == {"A": ["1.1.1.1"]}
    edge = back["relationships"].first()
    assert edge.id == "domain:x.com:HOSTED_ON:ip:1.1.1.1" and edge.method == "import"


def test_stix_ids_and_fields(spark):
    m = model(spark)
    rows = stix.to_stix(m["entities"], m["relationships"], now()).collect()
    space = uuid.UUID(fixed.STIX_NAMESPACE)
    objects = {r.id: json.loads(r.object) for r in rows}
    domain = "domain-name--" + str(uuid.uuid5(space, "domain-name:a:a.com"))
    asn = "autonomous-system--" + str(uuid.uuid5(space, "autonomous-system:a:AS5"))
    assert objects[domain]["value"] == "a.com" and objects[domain]["confidence"] == 90
    assert objects[asn]["number"] == 5 and objects[asn]["confidence"] == 29
    edge = [o for o in objects.values() if o["type"] == "relationship"][0]
    assert (edge["source_ref"], edge["target_ref"], edge["relationship_type"]) == (domain, asn, "located-at")
    assert {r.bundle_id for r in rows if r.investigation_id == "a"} == {f"bundle--{uuid.uuid5(space, 'bundle:a')}"}
    assert all("number" not in o for o in objects.values() if o["type"] == "domain-name")


def test_running_investigations_are_not_deleted(spark):
    m = model(spark)
    left = tables.delete_investigation(m, m["investigations"])
    assert [r.id for r in left["investigations"].collect()] == ["b"]
    assert {r.investigation_id for r in left["observations"].collect()} == {"b"}
    assert left["relationships"].count() == 0


def test_upsert_grows_the_time_span(spark):
    old = model(spark)["entities"]
    new = old.where("type = 'Domain'").withColumns(
        {"confidence": F.lit(0.1), "first_seen": F.lit("2024-03-01").cast("timestamp"), "last_seen": F.lit("2024-03-02").cast("timestamp")}
    )
    row = tables.upsert_entities(old, new).where("id = 'domain:a.com'").first()
    assert (row.confidence, row.first_seen, row.last_seen) == (0.1, T, dt.datetime(2024, 3, 2))
    assert tables.upsert_entities(old, old).count() == old.count()


def test_bucketed_writes_can_be_repeated(spark, tmp_path):
    ents = model(spark)["entities"]
    path = str(tmp_path / "ents")
    tables.write_bucketed(ents, path, 4)
    tables.write_bucketed(ents.where("investigation_id = 'a'"), path, 4)
    assert spark.read.parquet(path).where("investigation_id = 'a'").count() == 2
    # the bucket of the other investigation is only replaced when it is written
    same = tables.bucket_of("investigation_id", 4)
    buckets = {r.investigation_id: r.b for r in ents.select("investigation_id", same.alias("b")).collect()}
    assert spark.read.parquet(path).count() == (3 if buckets["a"] != buckets["b"] else 2)


def test_reports_are_written_and_logged(spark, tmp_path):
    m = model(spark) | {
        "entity_provenance": spark.createDataFrame([("domain:a.com", "o0", "a", T)], schemas.PROVENANCE),
        "notes": spark.createDataFrame([], schemas.NOTES),
    }
    lines = report.investigation_report(m)
    log = str(tmp_path / "log")
    for fmt in ("json", "csv"):
        reports.write_report(lines, str(tmp_path / fmt), fmt, log)
    meta = spark.read.parquet(log)
    assert meta.count() == 4 and meta.where("file_size > 0").count() == 4
    assert spark.read.json(str(tmp_path / "json")).count() == lines.count()


def test_platform_rules(spark, tmp_path):
    rules = {
        "b": {"name": "Beta", "url_pattern": "https://b/{u}", "success_indicators": {"body_contains": ["<title>"]}},
        "a": {"name": "Alpha", "url_pattern": "https://a/{u}", "failure_indicators": {"status_codes": [404]}, "enabled": True},
        "off": {"name": "Off", "url_pattern": "x", "enabled": False},
        "bad": {"name": "No URL"},
    }
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    df = observations.read_platforms(spark, str(path))
    assert [r.key for r in df.collect()] == ["a", "b"]
    page = spark.createDataFrame(
        [(1, "a", 404, "x"), (2, "a", 200, "x"), (3, "b", 200, "no"), (4, "b", 500, "<TITLE>"), (5, "b", 200, "<TITLE>" + "x" * 20000)],
        "id int, platform_key string, status_code int, html string",
    )
    got = {r.id: (r.found, round(r.confidence, 2)) for r in pages.classify_pages(page, df).collect()}
    assert got == {1: (False, 0.0), 2: (True, 0.8), 3: (False, 0.3), 4: (False, 0.0), 5: (True, 0.85)}
