"""Outer schemas of the stored tables. Payload columns stay JSON text."""

OBSERVATIONS = """
    id STRING, investigation_id STRING, source_adapter STRING, source_version STRING, collected_at TIMESTAMP,
    method STRING, target STRING, raw_response STRING, normalized_value STRING, confidence DOUBLE,
    status STRING, error_message STRING, created_at TIMESTAMP
"""

# One row per sighting of a value in an observation; entities are an aggregate of these.
MENTIONS = """
    investigation_id STRING, observation_id STRING, source STRING, seen_at TIMESTAMP, id STRING, type STRING,
    value STRING, confidence DOUBLE, properties MAP<STRING,STRING>
"""

ENTITIES = """
    id STRING, investigation_id STRING, type STRING, value STRING, confidence DOUBLE, first_seen TIMESTAMP,
    last_seen TIMESTAMP, source_count INT, sources ARRAY<STRING>, evidence_count BIGINT,
    properties MAP<STRING,STRING>
"""

# One row per sighting of an edge; relationships are an aggregate of these.
EDGE_MENTIONS = """
    investigation_id STRING, observation_id STRING, seen_at TIMESTAMP, id STRING, source_id STRING, target_id STRING,
    relationship_type STRING, confidence DOUBLE, method STRING
"""

RELATIONSHIPS = """
    id STRING, investigation_id STRING, source_id STRING, target_id STRING, relationship_type STRING,
    confidence DOUBLE, evidence_count BIGINT, discovered_at TIMESTAMP, method STRING
"""

PROVENANCE = "entity_id STRING, observation_id STRING, investigation_id STRING, created_at TIMESTAMP"

ACTIVITY = "id BIGINT, investigation_id STRING, event_type STRING, details STRING, created_at TIMESTAMP"

INVESTIGATIONS = """
    id STRING, name STRING, target STRING, target_type STRING, status STRING, depth STRING, api_calls_used INT,
    api_budget INT, entity_count BIGINT, relationship_count BIGINT, observation_count BIGINT, created_at TIMESTAMP,
    updated_at TIMESTAMP
"""

NOTES = """
    id STRING, investigation_id STRING, entity_id STRING, content STRING, created_at TIMESTAMP, updated_at TIMESTAMP
"""

OVERRIDES = """
    id STRING, entity_id STRING, investigation_id STRING, original_confidence DOUBLE, override_confidence DOUBLE,
    reason STRING, created_at TIMESTAMP
"""

REPORTS = """
    id STRING, investigation_id STRING, format STRING, file_path STRING, file_size BIGINT, created_at TIMESTAMP
"""
