"""Stand-ins for the model tables, derived by Spark from the shared test tables.

Every row of a source table becomes one observation, activity or candidate, so the work of a query grows with the data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.catalog.registry import table, texts
from linkloom.operators.text import text_mentions
from linkloom.schemas import OBSERVATIONS
from linkloom.session import checkpoint_dir, cut_lineage

AS_OF = "2024-02-15 00:00:00"
DOC_TIME = "2024-02-10 00:00:00"

_OBS = """
    '{adapter}-' || {key} AS id, {inv} AS investigation_id, '{adapter}' AS source_adapter, '1.0' AS source_version,
    timestamp_seconds(1704067200 + {key} % 2592000) AS collected_at, 'api' AS method, {target} AS target,
    {payload} AS raw_response, lower({target}) AS normalized_value, 0.8D AS confidence, 'success' AS status,
    CAST(NULL AS STRING) AS error_message, timestamp_seconds(1704067200 + {key} % 2592000) AS created_at
"""

# adapter: (source table, key, investigation, target, payload)
_PAYLOADS = {
    "dns": (
        "supplier",
        "s_suppkey",
        "'inv-' || s_nationkey",
        "CASE WHEN s_suppkey % 10 = 9 THEN 'Admin@S' || s_suppkey || '.Example.COM' "
        "ELSE 'S' || s_suppkey || '.example.com' END",
        """concat('{"A":["198.51.', s_nationkey, '.', s_suppkey % 256, '",{"value":"203.0.113.', s_suppkey % 256,
        '"}],"AAAA":["2001:0DB8:0:0:0:0:0:', hex(s_suppkey % 65536), '"],"MX":[{"exchange":"MX', s_nationkey,
        '.Example.org","priority":10},"20 mxb', s_nationkey, '.example.org."],"NS":[{"data":"NS', s_nationkey,
        '.Example.net."}],"SOA":{"mname":"soa', s_nationkey, '.example.net","rname":"host.s', s_suppkey,
        '.example.com"},"TXT":["v=spf1 ip4:192.0.2.', s_suppkey % 256, ' ~all"],"PTR":["ptr', s_suppkey,
        '.example.net"]}')""",
    ),
    "whois": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'c' || c_custkey || '.example.com'",
        """concat('{"registrar":"Registrar ', c_nationkey, ' Inc.","registrant_email":"',
        CASE WHEN c_custkey % 3 = 0 THEN 'REDACTED FOR PRIVACY'
             ELSE 'Owner' || c_custkey || '@C' || c_custkey || '.Example.com' END,
        '","registrant_name":"',
        CASE WHEN c_custkey % 2 = 0 THEN 'Holding ' || c_mktsegment ELSE 'Privacy Protected' END,
        '","name_servers":["ns1.c', c_custkey, '.example.com",{"name":"NS', c_nationkey,
        '.example.net.","ipv4":"198.18.', c_nationkey, '.1"}],"creation_date":"2020-01-',
        lpad(c_custkey % 28 + 1, 2, '0'), 'T00:00:00Z","expiration_date":"', lpad(c_custkey % 28 + 1, 2, '0'),
        '-Aug-2026","domain_status":["ok"]}')""",
    ),
    "certificate_transparency": (
        "orders",
        "o_orderkey",
        "'inv-' || o_custkey % 25",
        "'c' || o_custkey || '.example.com'",
        r"""concat('{"certificates":[{"id":', o_orderkey, ',"issuer_name":"C=US, O=Issuer ',
        substr(o_orderpriority, 1, 1), ', CN=R3","name_value":"c', o_custkey, '.example.com\\nwww.C', o_custkey,
        '.example.com\\nalt', o_custkey % 100, '.example.org\\n192.0.2.', o_custkey % 256, '"}]}')""",
    ),
    "http": (
        "part",
        "p_partkey",
        "'inv-' || p_partkey % 25",
        "'shop' || p_partkey || '.example.com'",
        """concat('{"headers":{"Server":"nginx/1.', p_size, '","X-Powered-By":"PHP/8.', p_size % 4,
        '"},"title":"Contact sales', p_partkey, '@shop', p_partkey,
        '.example.com","technologies":[{"name":"Nginx 1.', p_size, '"}],"redirects":[{"url":"https://shop',
        p_partkey, '.example.com/home"}]}')""",
    ),
    "ip_to_asn": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'198.51.' || c_nationkey || '.' || c_custkey % 256",
        """concat('{"asn":" as', 64500 + c_nationkey, '","organization":"Net ', c_nationkey, '"}')""",
    ),
    "threat_intel": (
        "supplier",
        "s_suppkey",
        "'inv-' || s_nationkey",
        "CASE WHEN s_suppkey % 2 = 0 THEN '203.0.113.' || s_suppkey % 256 ELSE 'S' || s_suppkey || '.example.com' END",
        """concat('{"abuseipdb":{"abuse_confidence_score":', s_suppkey % 101, '},"urlhaus":{',
        CASE WHEN s_suppkey % 3 = 0 THEN '"threat":"malware_' || s_nationkey || '"' ELSE '' END, '}}')""",
    ),
    "github": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'user' || c_custkey",
        """concat('{"found":true,"profile":{"login":"User', c_custkey, '","email":"User', c_custkey,
        '@Example.org","blog":"WWW.c', c_custkey, '.example.com/blog/"},"repositories":[{"name":"repo',
        c_custkey % 7, '","html_url":"https://github.com/User', c_custkey, '/repo', c_custkey % 7, '"},"tool',
        c_custkey % 5, '"],"organizations":["Org ', c_nationkey, '",{"login":"team', c_custkey % 11, '"}]}')""",
    ),
    "gitlab": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'user' || c_custkey",
        """concat('{"found":true,"profile":{"username":"user', c_custkey, '","email":"User', c_custkey,
        '@Example.org","organization":"Org ', c_nationkey, '","profile_url":"https://gitlab.com/user', c_custkey,
        '"},"projects":[{"path":"proj', c_custkey % 9, '"}],"groups":[{"path":"grp', c_nationkey, '"}]}')""",
    ),
    "keybase": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'user' || c_custkey",
        """concat('{"found":', CASE WHEN c_custkey % 4 = 0 THEN 'false' ELSE 'true' END,
        ',"profile":{"username":"user', c_custkey, '","full_name":"Name', c_custkey % 50, ' Family', c_nationkey,
        '","website":"https://c', c_custkey, '.example.com","profile_url":"https://keybase.io/user', c_custkey,
        '","social_proofs":[{"service":"twitter","username":"tw', c_custkey, '"},{"service":"","username":"x"}]}}')""",
    ),
    "reddit": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'user' || c_custkey",
        """concat('{"found":true,"profile":{"name":"user', c_custkey, '","profile_url":"https://reddit.com/user/user',
        c_custkey, '"}}')""",
    ),
    "hackernews": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'user' || c_custkey",
        """concat('{"found":true,"profile":{"username":"user', c_custkey, '"}}')""",
    ),
    "search": (
        "pages",
        "page_id",
        "'inv-' || page_id % 25",
        "regexp_extract(url, '//([^/?#]+)', 1)",
        """concat('{"query":"', regexp_extract(url, '//([^/?#]+)', 1),
        '","result_count":1,"extracted_entities":{"domains":["', upper(regexp_extract(url, '//([^/?#]+)', 1)),
        '"],"emails":["Web', page_id, '@Example.com"],"ips":["203.0.113.', page_id % 256, '"]}}')""",
    ),
    "username_probe": (
        "customer",
        "c_custkey",
        "'inv-' || c_nationkey",
        "'user' || c_custkey",
        """concat('{"found":true,"platform":"',
        CASE c_custkey % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Personal Website' ELSE 'GitHub' END,
        '","platform_key":"k', c_custkey % 3, '","username":"user', c_custkey, '","url":"https://p', c_custkey % 3,
        '.example.net/user', c_custkey, '","evidence":{"title":"T","snippet":"S"}}')""",
    ),
    "newsfeed": (
        "documents",
        "doc_id",
        "source",
        "'doc' || doc_id",
        "to_json(named_struct('text', text))",
    ),
}


#: Where the observations of (application, folder, adapter) lie.
_STORED: dict[tuple[str, str, str], str] = {}
#: A test table is often one row group, which one task reads; stored observations come in files of so many rows.
_ROWS_PER_FILE = 4_000


def observations(spark: SparkSession, d: str, *adapters: str) -> DataFrame:
    """Observations of the given adapters, or of all. Observations are a stored table: the first query that asks for an
    adapter writes its rows, in several files; queries then read those."""
    app = spark.sparkContext.applicationId
    for adapter in adapters or _PAYLOADS:
        if (app, d, adapter) not in _STORED:
            source, key, inv, target, payload = _PAYLOADS[adapter]
            rows = table(spark, d, source).selectExpr(
                *_columns(_OBS.format(adapter=adapter, key=key, inv=inv, target=target, payload=payload))
            )
            path = f"{checkpoint_dir(spark)}/{app}/observations-{adapter}-{uuid.uuid4().hex}"
            rows.write.option("maxRecordsPerFile", _ROWS_PER_FILE).option("compression", "zstd").parquet(path)
            _STORED[app, d, adapter] = path
    paths = [_STORED[app, d, adapter] for adapter in adapters or _PAYLOADS]
    return spark.read.schema(OBSERVATIONS).parquet(*paths)


def _columns(text: str) -> list[str]:
    """Splits a select list at its top-level commas."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            depth -= 1
        elif not quoted and depth == 0 and c == ",":
            parts.append(text[start:i].strip())
            start = i + 1
    parts.append(text[start:].strip())
    return parts


# --- events as activity, observations and mentions ---------------------------------------------------------------

_EVENT_KIND = """CASE event_type WHEN 'click' THEN 'Domain' WHEN 'view' THEN 'IP' WHEN 'signup' THEN 'Email'
    WHEN 'purchase' THEN 'Organization' ELSE 'Username' END"""
_EVENT_NAME = """CASE event_type WHEN 'click' THEN 'pivot_dispatched' WHEN 'view' THEN 'pivot_round_completed'
    WHEN 'signup' THEN 'investigation_completed' WHEN 'purchase' THEN 'observation_collected'
    ELSE 'investigation_stopped' END"""

# The same stand-ins in the SQL of the check tool, as common table expressions.
EVENTS_SQL = f"""
ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
em AS (SELECT 'inv-' || user_id AS investigation_id, 'o' || event_id AS observation_id, event_type AS source,
    ts AS seen_at, {_EVENT_KIND} AS type, 'v' || k AS value, least(1.0, round(value / 100, 4)) AS confidence, event_id, k
    FROM ev),
men AS (SELECT *, lower(type) || ':' || value AS id FROM em),
ents AS (SELECT id, investigation_id, min(type) AS type, min(value) AS value, max(confidence) AS confidence,
    min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(DISTINCT source) AS source_count,
    list_sort(list(DISTINCT source)) AS sources, count(DISTINCT observation_id) AS evidence_count
    FROM men GROUP BY investigation_id, id),
act AS (SELECT event_id AS id, 'inv-' || user_id AS investigation_id, {_EVENT_NAME} AS event_type,
    '{{"target": "t' || event_id % 50 || '", "action": "a' || event_id % 4 || '", "stop_reason": "r' || event_id % 3
    || '"}}' AS details, ts AS created_at FROM ev),
obs AS (SELECT 'o' || event_id AS id, 'inv-' || user_id AS investigation_id, event_type AS source_adapter,
    ts AS collected_at, 'm' || event_id % 2 AS method, 'v' || k AS target, 'V' || event_id % 100 AS normalized_value,
    round(value / 100, 4) AS confidence,
    CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status FROM ev),
inv AS (SELECT 'inv-' || user_id AS id, 'User ' || user_id AS name, 'u' || user_id || '.example.com' AS target,
    'domain' AS target_type,
    CASE user_id % 6 WHEN 0 THEN 'created' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'completed'
        WHEN 4 THEN 'stopped' ELSE 'error' END AS status,
    CASE user_id % 3 WHEN 0 THEN 'shallow' WHEN 1 THEN 'standard' ELSE 'deep' END AS depth,
    count(*) AS api_calls_used, 60 + user_id % 20 AS api_budget, min(ts) AS created_at, max(ts) AS updated_at
    FROM ev GROUP BY user_id)
"""


def event_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.selectExpr(
        "'inv-' || user_id AS investigation_id",
        "'o' || event_id AS observation_id",
        "event_type AS source",
        "ts AS seen_at",
        f"lower({_EVENT_KIND}) || ':v' || k AS id",
        f"{_EVENT_KIND} AS type",
        "'v' || k AS value",
        "least(1.0D, round(value / 100, 4)) AS confidence",
        "CASE WHEN event_id % 3 = 0 THEN map('k', '' || k, 'first', CASE WHEN event_id % 2 = 0 THEN '' "
        "ELSE '' || event_id END) ELSE CAST(map() AS MAP<STRING,STRING>) END AS properties",
    )


def event_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id AS id",
        "'inv-' || user_id AS investigation_id",
        f"{_EVENT_NAME} AS event_type",
        "concat('{\"target\": \"t', event_id % 50, '\", \"action\": \"a', event_id % 4, '\", \"stop_reason\": \"r', "
        "event_id % 3, '\"}') AS details",
        "ts AS created_at",
    )


def event_observations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.selectExpr(
        "'o' || event_id AS id",
        "'inv-' || user_id AS investigation_id",
        "event_type AS source_adapter",
        "'1.0' AS source_version",
        "ts AS collected_at",
        "'m' || event_id % 2 AS method",
        "'v' || k AS target",
        "props AS raw_response",
        "'V' || event_id % 100 AS normalized_value",
        "round(value / 100, 4) AS confidence",
        "CASE WHEN event_id % 7 = 0 THEN 'error' ELSE 'success' END AS status",
        "CAST(NULL AS STRING) AS error_message",
        "ts AS created_at",
    )


def event_investigations(spark: SparkSession, d: str) -> DataFrame:
    per_user = table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").cast("int").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")
    )
    return per_user.selectExpr(
        "'inv-' || user_id AS id",
        "'User ' || user_id AS name",
        "'u' || user_id || '.example.com' AS target",
        "'domain' AS target_type",
        "element_at(array('created', 'running', 'paused', 'completed', 'stopped', 'error'), "
        "CAST(user_id % 6 + 1 AS INT)) AS status",
        "element_at(array('shallow', 'standard', 'deep'), CAST(user_id % 3 + 1 AS INT)) AS depth",
        "n AS api_calls_used",
        "CAST(60 + user_id % 20 AS INT) AS api_budget",
        "0L AS entity_count",
        "0L AS relationship_count",
        "0L AS observation_count",
        "first AS created_at",
        "last AS updated_at",
    )


def document_mentions(spark: SparkSession, d: str) -> DataFrame:
    return text_mentions(
        texts(spark, d, "documents", "doc_id", "source", "lang", "text"),
        "text",
        F.col("source"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")),
        F.col("lang"),
        F.lit(DOC_TIME).cast("timestamp"),
    )


# --- a graph of regions, nations, suppliers and brands -----------------------------------------------------------

GRAPH_SQL = """
rel AS (
    SELECT 'nation:' || n_nationkey AS source_id, 'region:' || n_regionkey AS target_id, 'lies_in' AS kind FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in' FROM supplier
    UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'brand:' || p_brand, 'sells' FROM lineitem
        JOIN part ON l_partkey = p_partkey),
ent AS (SELECT DISTINCT id, split_part(id, ':', 1) AS type FROM
    (SELECT source_id AS id FROM rel UNION ALL SELECT target_id FROM rel)),
bidi AS (SELECT DISTINCT source_id AS from_id, target_id AS to_id FROM rel
    UNION SELECT target_id, source_id FROM rel)
"""


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of one investigation."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    sells = (
        table(spark, d, "lineitem")
        .select("l_suppkey", F.col("l_partkey").alias("p_partkey"))
        .distinct()
        .join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
        .select("l_suppkey", "p_brand")
        .distinct()
    )
    rows = (
        nation.selectExpr("'nation:' || n_nationkey AS source_id", "'region:' || n_regionkey AS target_id",
                          "'lies_in' AS relationship_type")
        .unionAll(supplier.selectExpr("'supplier:' || s_suppkey", "'nation:' || s_nationkey", "'based_in'"))
        .unionAll(sells.selectExpr("'supplier:' || l_suppkey", "'brand:' || p_brand", "'sells'"))
    )
    rels = rows.selectExpr(
        "concat_ws(':', source_id, relationship_type, target_id) AS id",
        "'g' AS investigation_id",
        "source_id",
        "target_id",
        "relationship_type",
        "0.5D AS confidence",
        "1L AS evidence_count",
        f"TIMESTAMP '{DOC_TIME}' AS discovered_at",
        "'manual' AS method",
    )
    # A graph is a stored table; several joins read it.
    rels = cut_lineage(rels)
    ids = rels.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    ents = ids.selectExpr(
        "id",
        "'g' AS investigation_id",
        "substring_index(id, ':', 1) AS type",
        "regexp_extract(id, '^[^:]*:(.*)$', 1) AS value",
        "0.5D AS confidence",
        f"TIMESTAMP '{DOC_TIME}' AS first_seen",
        f"TIMESTAMP '{DOC_TIME}' AS last_seen",
        "1 AS source_count",
        "array('manual') AS sources",
        "1L AS evidence_count",
        "CAST(map() AS MAP<STRING,STRING>) AS properties",
    )
    return ents, rels
