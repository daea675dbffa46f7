"""What the whole plan shuffles and writes."""

import datetime as dt
import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.operators import accounts, extract, partials, resolve, score
from linkloom.plans.correlate import correlate

T = dt.datetime(2024, 1, 1)
NOW = "2024-02-01 00:00:00"


def observation(oid, inv, adapter, target, payload):
    return (oid, inv, adapter, "1", T, "api", target, json.dumps(payload), None, 0.5, "success", None, T)


def stored(spark):
    def person(name, **more):
        return {"found": True, "profile": {"username": name, **more}}

    ann = {"full_name": "Ann Lee", "email": "Ann@Example.org", "organization": "Acme"}
    rows = [
        observation("00000000-0000-4000-8000-000000000001", "i", "dns", "a.example.com", {"A": ["192.0.2.1", "192.0.2.1"]}),
        observation("00000000-0000-4000-8000-000000000001", "i", "dns", "a.example.com", {"A": ["192.0.2.1"]}),
        observation("00000000-0000-4000-8000-000000000001", "j", "dns", "a.example.com", {"A": ["192.0.2.1"]}),
        observation("00000000-0000-4000-8000-000000000002", "i", "gitlab", "annlee", person("annlee", **ann)),
        observation("00000000-0000-4000-8000-000000000003", "i", "keybase", "annlee", person("AnnLee", **ann)),
        observation(None, "i", "dns", "b.example.com", {"A": ["192.0.2.2"]}),
        observation(None, "i", "dns", "b.example.com", {"A": ["192.0.2.2"]}),
    ]
    return spark.createDataFrame(rows, schemas.OBSERVATIONS)


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION_BY_NUM" not in line]


def test_what_an_observation_says_is_grouped_where_it_is_found(spark):
    def own(obs):
        rows = obs.select(
            "investigation_id", F.col("id").alias("observation_id"), F.lit("own").alias("source"),
            F.col("collected_at").alias("seen_at"), F.lit("domain:x").alias("id"), F.lit("Domain").alias("type"),
            F.lit("x").alias("value"), F.lit(0.5).alias("confidence"), F.create_map().cast("map<string,string>").alias("properties"),
        )
        edge = rows.select("investigation_id", "observation_id", "seen_at", "id", F.col("id").alias("source_id"),
                           F.col("id").alias("target_id"), F.lit("r").alias("relationship_type"), "confidence", F.lit("").alias("method"))
        return rows, edge

    extract.register_extractor("feed", own)
    try:
        told = partials.told(extract.said_by_observation(stored(spark), ["dns", "gitlab", "keybase"]))
        assert not _exchanges(told)
    finally:
        extract.unregister_extractor("feed")


def test_told_agrees_with_grouping_by_shuffle(spark):
    """Repeated observations, one in two investigations, some without an id, and what accounts add."""
    obs, now = stored(spark), F.lit(NOW).cast("timestamp")
    said = extract.said_in(obs, adapters=["dns", "gitlab", "keybase"])
    mentions, _ = accounts.account_entities(extract.accounts_of(said), now)
    want = partials.partials(said, mentions)
    told = partials.told(extract.said_by_observation(obs, ["dns", "gitlab", "keybase"]))
    more, _ = accounts.account_entities(partials.told_accounts(told), now)
    entities, properties, pairs = partials.told_entities(told, more)

    def rows(df, like):
        return sorted(map(str, df.select(*like.columns).collect()))

    assert rows(entities, want.entities) == rows(want.entities, want.entities)
    assert rows(properties, want.properties) == rows(want.properties, want.properties)
    assert rows(pairs, want.pairs) == rows(want.pairs, want.pairs)
    assert rows(partials.told_accounts(told), want.accounts) == rows(want.accounts, want.accounts)


def test_kinds_that_accounts_add_are_known(spark):
    rows = extract.said_in(stored(spark), adapters=["dns", "gitlab", "keybase"])
    mentions, _ = accounts.account_entities(extract.accounts_of(rows), F.lit(NOW).cast("timestamp"))
    found = {r[0] for r in mentions.select(F.substring_index("id", ":", 1)).distinct().collect()}
    assert found == set(partials.ACCOUNT_PREFIXES)


def test_provenance_groups_only_observations_of_several_investigations(spark):
    obs = stored(spark)
    said = extract.said_in(obs, adapters=["dns", "gitlab", "keybase"])
    pairs = partials.partials(said).pairs.withColumnsRenamed({"entity_id": "id", "created_at": "seen_at"})
    want = resolve.entity_provenance(pairs)
    got = resolve.entity_provenance(pairs, once=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    found = correlate(obs, NOW)["entity_provenance"].where("entity_id = 'ip:192.0.2.1'").collect()
    assert [(r.observation_id[-1], r.investigation_id) for r in found] == [("1", "i")]


EDGE = "investigation_id string, id string, source_id string, target_id string, relationship_type string, confidence double, " \
    "first struct<seen_at:timestamp,observation_id:string,method:string>, evidence_count bigint, link struct<seen_at:timestamp," \
    "observation_id:string,method:string,confidence:double,source_id:string,target_id:string,relationship_type:string,stated:boolean>"


def test_ends_are_looked_up_once_for_links_and_scores(spark):
    """Edges, links, both, and an edge and a link of one id with other ends, of which one link is not known."""

    def row(eid, edge=None, link=None, stated=False):
        ends = (*edge, "r") if edge else (None,) * 3
        first = (T, "o", "m") if edge else None
        near = (T, "p", "n", 0.9, *link, "r", stated) if link else None
        return ("i", eid, *ends, 0.4 if edge else None, first, 1 if edge else 0, near)

    rows = [
        row("edge", ("a", "x")), row("link", None, ("a", "b")), row("lost", None, ("a", "x")),
        row("both", ("a", "b"), ("a", "b"), True), row("kept", ("x", "b"), ("a", "b")), row("gone", ("a", "b"), ("y", "b")),
    ]
    ents = spark.createDataFrame([("i", "a", 0.5), ("i", "b", 0.7)], "investigation_id string, id string, confidence double")
    met = partials.relationship_rows([spark.createDataFrame(rows, EDGE)])
    found = {r.id: r for r in partials.relationships(met, ents).collect()}
    assert {k: (r.source_id, r.target_id, r._src, r._tgt, r.evidence_count, r.method) for k, r in found.items()} == {
        "edge": ("a", "x", 0.5, None, 1, "m"),
        "link": ("a", "b", 0.5, 0.7, 1, "n"),
        "both": ("a", "b", 0.5, 0.7, 1, "n"),
        "kept": ("a", "b", 0.5, 0.7, 2, "n"),
        "gone": ("a", "b", 0.5, 0.7, 1, "m"),
    }
    assert score.score_between(partials.relationships(met, ents), NOW).count() == 5


def test_a_cell_is_sent_names_once_and_returns_pairs_in_their_order():
    """Memberships are places among the names of a block; pairs come sorted, so that what is written of them is small."""
    import pyarrow as pa

    names = {0: ["a", "c", "e"], 1: ["b", "d"]}
    holds = [(0, "o1", [0, 1, 2]), (1, "o1", [0, 1]), (0, "o2", [2]), (1, "o2", [0])]
    rows = [
        {"investigation_id": "i", "_i": 0, "_j": 1, "_b": b, "observation_id": None, "_members": None,
         "_names": [{"entity_id": n, "_n": 2} for n in names[b]]} for b in names
    ] + [
        {"investigation_id": "i", "_i": 0, "_j": 1, "_b": b, "observation_id": o, "_members": places, "_names": None}
        for b, o, places in holds
    ]
    of = pa.schema([("investigation_id", pa.string()), ("_i", pa.int32()), ("_j", pa.int32()), ("_b", pa.int32()),
                    ("observation_id", pa.string()), ("_members", pa.list_(pa.int32())),
                    ("_names", pa.list_(pa.struct([("entity_id", pa.string()), ("_n", pa.int64())])))])
    got = resolve._cell_pairs(pa.Table.from_pylist(rows, of)).to_pylist()
    found = [(r["id_a"], r["id_b"], r["shared"], r["observation_id"]) for r in got]
    assert found == [("a", "b", 1, "o1"), ("a", "d", 1, "o1"), ("b", "c", 1, "o1"), ("b", "e", 2, "o1"),
                     ("c", "d", 1, "o1"), ("d", "e", 1, "o1")]


def test_numbered_names_do_not_meet_by_grams(spark):
    """Short names all share their grams; they meet by variants, of which each has few, and no pair is lost."""
    names = [f"user{i:05d}" for i in range(0, 3000, 7)] + ["usr00007", "User000077", "user7", "name1 family2", "name1 famly2"]
    rows = spark.createDataFrame([("i", "Username", f"u:{n}", n) for n in names], "investigation_id string, type string, id string, value string")
    sized = rows.select("investigation_id", "type", "id", F.lower("value").alias("name")).withColumn("n", F.length("name"))
    sized = sized.withColumn("_have", F.array(*[F.lit(k) for k in sorted({len(n) for n in names})]))
    kind = ["investigation_id", "type"]
    assert resolve._gram_pairs(sized, kind, 0.85).where("length(a) < 12").count() == 0
    want = {
        (f"u:{a}", f"u:{b}") for a in names for b in names
        if f"u:{a}" < f"u:{b}" and SequenceMatcher(None, a.lower(), b.lower()).ratio() >= 0.85
    }
    got = [(r.id_a, r.id_b) for r in resolve.similar_entities(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("u:name1 family2", "u:name1 famly2") in want
