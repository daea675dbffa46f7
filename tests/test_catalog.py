"""A sample of the registered queries agrees with its SQL twin on the smallest tables; `tools/check.py` runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from linkloom.catalog import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "p2_standardize_targets",
    "p7_redact_documents",
    "e1_text_entities",
    "e5_whois_entities",
    "e6_certificates_edges",
    "r1_resolved_entities",
    "r3_co_occurring_users",
    "r7_linked_accounts",
    "r12_events_without_repeats",
    "c3_scored_graph",
    "j6_announced_prefixes",
    "a4_values_shared_between_investigations",
    "w2_interleaved_hits",
    "q3_entity_evidence",
    "v5_selected_candidates",
    "g4_paths",
    "a4_shared_values_by_sketches",
    "q5_activity_pages_by_key",
    "q8_search_by_index",
    "q9_search_by_index",
    "s4_stix_objects",
    "s4_stix_relationships",
    "c1a_own_source_weights",
    "e18_own_extractor_edges",
    "x7_streamed_call_budgets",
    "s10_platform_rules",
    "s11_stored_report",
    "r4_similar_names",
    "r8_leet_variants",
    "plan_linked_accounts",
    "e1_text_entities_conversations",
    "p13_unparked_pages",
    "c8_evidence_tiers",
]


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _text(value):
    return repr(round(value, 7)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, sf_dir, sql, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    result = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    want = sorted([_text(r[names.index(c)]) for c in cols] for r in result.fetchall())
    assert sorted([_text(r[c]) for c in cols] for r in df.collect()) == want


def test_registry_is_complete():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLES) == set(QUERIES) <= set(entry.queries())


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0
