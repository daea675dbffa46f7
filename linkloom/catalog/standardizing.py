"""Queries for the standardization operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.derive import observations
from linkloom.catalog.registry import query, table, texts
from linkloom.operators import pages, report
from linkloom.operators import standardize as st

# Eight written forms of a target per customer, and every page URL.
_TARGETS_SQL = """
t AS (SELECT 'c' || c_custkey AS key, c_custkey AS k, c_custkey % 8 AS form, CASE c_custkey % 8
    WHEN 0 THEN '  C' || c_custkey || '.Example.COM. ' WHEN 1 THEN 'User' || c_custkey || '@Example.COM'
    WHEN 2 THEN '198.051.' || c_nationkey || '.' || c_custkey % 256
    WHEN 3 THEN '2001:DB8:0:0:0::' || printf('%x', c_custkey % 65535 + 1)
    WHEN 4 THEN 'HTTPS://Host' || c_custkey || '.Example.com:443/Path/' || c_custkey || '/?q=1#F'
    WHEN 5 THEN c_name WHEN 6 THEN '   ' ELSE 'Bücher' || c_custkey || '.example' END AS target, c_nationkey AS n
    FROM customer
    UNION ALL SELECT 'p' || page_id, page_id, 9, url, 0 FROM pages)"""


def targets(spark, d):
    forms = """CASE c_custkey % 8
        WHEN 0 THEN '  C' || c_custkey || '.Example.COM. ' WHEN 1 THEN 'User' || c_custkey || '@Example.COM'
        WHEN 2 THEN '198.051.' || c_nationkey || '.' || c_custkey % 256
        WHEN 3 THEN '2001:DB8:0:0:0::' || lower(hex(c_custkey % 65535 + 1))
        WHEN 4 THEN 'HTTPS://Host' || c_custkey || '.Example.com:443/Path/' || c_custkey || '/?q=1#F'
        WHEN 5 THEN c_name WHEN 6 THEN '   ' ELSE 'Bücher' || c_custkey || '.example' END AS target"""
    own = table(spark, d, "customer").selectExpr("'c' || c_custkey AS key", forms)
    return own.unionAll(table(spark, d, "pages").selectExpr("'p' || page_id", "url"))


@query(
    "p1_classify_targets",
    rf"""WITH {_TARGETS_SQL}, s AS (SELECT key, trim(target, ' ' || chr(9) || chr(10)) AS x FROM t)
    SELECT key, CASE WHEN x = '' THEN 'unknown'
      WHEN regexp_matches(x, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}$') THEN 'email'
      WHEN regexp_matches(lower(x), '^https?://(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{{2,}}(?::\d{{1,5}})?(?:/[^\s]*)?$')
        THEN 'url'
      WHEN regexp_matches(x, '^\d{{1,3}}(?:\.\d{{1,3}}){{3}}$') THEN 'ip'
      WHEN regexp_matches(x, '^[0-9a-fA-F:]*::[0-9a-fA-F:]*$') THEN 'ip'
      WHEN regexp_matches(x, '^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{{2,}}\.?$') THEN 'domain'
      ELSE 'username' END AS target_type FROM s""",
)
def _(spark, d):
    return st.classify_targets(targets(spark, d)).select("key", "target_type")


@query(
    "p2_standardize_targets",
    rf"""WITH {_TARGETS_SQL} SELECT key, CASE form WHEN 0 THEN 'c' || k || '.example.com'
      WHEN 1 THEN 'user' || k || '@example.com' WHEN 2 THEN '198.51.' || n || '.' || k % 256
      WHEN 3 THEN '2001:db8::' || printf('%x', k % 65535 + 1)
      WHEN 4 THEN 'https://host' || k || '.example.com/Path/' || k || '?q=1#F' WHEN 5 THEN lower(target)
      WHEN 6 THEN '' WHEN 7 THEN lower(target)
      ELSE regexp_replace(target, '/+(\?|#|$)', '\1') END AS normalized_value,
      CASE form WHEN 2 THEN 4 WHEN 3 THEN 6 END AS ip_version FROM t""",
)
def _(spark, d):
    return st.standardize_targets(targets(spark, d)).select("key", "normalized_value", "ip_version")


@query(
    "p2_international_domains",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'xn--bcher-kva.c' || c_custkey || '.example'
      ELSE 'plain.c' || c_custkey || '.example' END AS name FROM customer""",
)
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey", "if(c_custkey % 2 = 0, 'BÜCHER.c', 'Plain.c') || c_custkey || '.example.' AS raw"
    )
    from linkloom.functions.values import domain

    return rows.select("c_custkey", domain(F.col("raw")).alias("name"))


@query(
    "p3_timestamps",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 9 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS parsed_at
    FROM orders""",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        """CASE o_orderkey % 10
        WHEN 0 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        WHEN 1 THEN date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        WHEN 2 THEN date_format(o_orderdate + INTERVAL 2 HOURS, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
        WHEN 3 THEN date_format(o_orderdate, "'Mon, 'd MMM yyyy HH:mm:ss' +0000'")
        WHEN 4 THEN date_format(o_orderdate, 'MMM d, yyyy')
        WHEN 5 THEN date_format(o_orderdate, 'd-MMM-yyyy')
        WHEN 6 THEN lpad(CAST(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) AS STRING), 10, '0')
        WHEN 7 THEN lpad(CAST(unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS STRING), 13, '0')
        WHEN 8 THEN date_format(o_orderdate, 'dd/MM/yyyy')
        ELSE date_format(o_orderdate, 'MMM d yyyy') END AS raw""",
    )
    return st.standardize_timestamps(rows, "raw").select("o_orderkey", "parsed_at")


_ADDRESS = "(o_orderkey * 7) % 224 {c} '.' {c} (o_orderkey * 11) % 256 {c} '.' {c} o_orderkey % 256 {c} '.' {c} o_custkey % 256"


@query(
    "p5_flag_internal",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN true ELSE
      (a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a = 127 OR (a = 169 AND b = 254)
        OR a + b + o_orderkey % 256 + o_custkey % 256 = 0) END AS is_internal
    FROM (SELECT *, (o_orderkey * 7) % 224 AS a, (o_orderkey * 11) % 256 AS b FROM orders)""",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "if(o_orderkey % 50 = 0, if(o_orderkey % 100 = 0, 'LOCALHOST', 'FE80::1'), "
        + "''||" + _ADDRESS.format(c="||") + ") AS host",
    )
    return st.flag_internal(rows, "host").select("o_orderkey", "is_internal")


@query(
    "p6_validate_targets",
    """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'internal' WHEN 2 THEN 'scheme'
      WHEN 3 THEN 'credentials' WHEN 4 THEN 'characters' END AS reject_reason,
      CASE c_custkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN '10.0.0.' || c_custkey % 256
      WHEN 2 THEN 'ftp://h' || c_custkey || '.example.com/' WHEN 3 THEN 'http://u:p@h' || c_custkey || '.example.com/'
      WHEN 4 THEN 'h' || c_custkey || '.example.com;x' WHEN 5 THEN 'https://h' || c_custkey || '.example.com/a'
      ELSE 'h' || c_custkey || '.example.com' END AS cleaned FROM customer""",
)
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey",
        """CASE c_custkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN '10.0.0.' || c_custkey % 256
        WHEN 2 THEN 'ftp://h' || c_custkey || '.example.com/' WHEN 3 THEN 'http://u:p@h' || c_custkey || '.example.com/'
        WHEN 4 THEN 'h' || c_custkey || '.example.com;x' WHEN 5 THEN 'https://h' || c_custkey || '.example.com/a'
        ELSE 'h' || char(1) || c_custkey || '.example.com' END AS target""",
        "CASE c_custkey % 7 WHEN 2 THEN 'url' WHEN 3 THEN 'url' WHEN 5 THEN 'url' ELSE 'domain' END AS target_type",
    )
    return st.validate_targets(rows).select("c_custkey", "reject_reason", "cleaned")


def _redact_sql(text: str) -> str:
    steps = [
        (r"(?i)(api[_-]?key|token|secret|password|authorization|bearer|credential)\s*[=:]\s*\S+(?:\s+\S+)?",
         r"\1=[REDACTED]"),
        (r"[A-Za-z]:\\[^\s\"'']+", "[path]"),
        (r"/(?:usr|etc|var|home|tmp|opt|proc|sys)/[^\s\"'']+", "[path]"),
        (r"\b(?:10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.)[^\s\"'']+", "[internal]"),
        (r"postgresql://[^\s\"'']+", "[db]"),
        (r"bolt://[^\s\"'']+", "[neo4j]"),
    ]
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


@query(
    "p7_redact_documents",
    f"SELECT doc_id, md5({_redact_sql('text')}) AS redacted FROM documents",
)
def _(spark, d):
    rows = st.redact_text(texts(spark, d, "documents", "doc_id", "text"), "text", None)
    return rows.select("doc_id", F.md5("text").alias("redacted"))


@query(
    "p7_redact_messages",
    f"SELECT conv_id, turn, {_redact_sql('text')} AS redacted FROM conversations",
)
def _(spark, d):
    rows = st.redact_text(texts(spark, d, "conversations", "conv_id", "turn", "text"), "text", out="redacted")
    return rows.select("conv_id", "turn", "redacted")


@query(
    "p8_availability",
    """SELECT a AS availability, count(*) AS n FROM (SELECT CASE o_orderkey % 10 WHEN 0 THEN 'available'
      WHEN 1 THEN 'redirected' WHEN 2 THEN 'access_denied' WHEN 3 THEN 'not_found' WHEN 4 THEN 'auth_required'
      WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'temporarily_unavailable' WHEN 7 THEN 'unknown' WHEN 8 THEN 'available'
      ELSE 'unknown' END AS a FROM orders) GROUP BY a""",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "element_at(array(200, 302, 403, 404, 401, 429, 503, 418, 204, 303), CAST(o_orderkey % 10 + 1 AS INT)) AS code"
    )
    return st.availability_states(rows, "code").groupBy("availability").agg(F.count("*").alias("n"))


def _linked(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey",
        "element_at(array('Username', 'Repository', 'Domain', 'URL', 'Email'), CAST(c_custkey % 5 + 1 AS INT)) AS type",
        "'v' || c_custkey AS value",
        "array(element_at(array('GitHub', 'reddit', 'dns'), CAST(c_custkey % 3 + 1 AS INT))) AS sources",
        "CASE c_custkey % 4 WHEN 0 THEN map('profile_url', 'https://p/' || c_custkey) "
        "WHEN 1 THEN map('profile_url', 'p/' || c_custkey, 'url', 'http://u/' || c_custkey) "
        "ELSE CAST(map() AS MAP<STRING,STRING>) END AS properties",
    )


@query(
    "p9_source_urls",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://p/' || c_custkey WHEN 1 THEN 'http://u/' || c_custkey
      END AS source_url FROM customer""",
)
def _(spark, d):
    return st.source_urls(_linked(spark, d)).select("c_custkey", "source_url")


@query(
    "p9_display_urls",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'https://p/' || c_custkey
      WHEN c_custkey % 4 = 1 THEN 'p/' || c_custkey WHEN c_custkey % 5 IN (2, 3) THEN 'https://v' || c_custkey
      WHEN c_custkey % 5 IN (0, 1) AND c_custkey % 3 = 0 THEN 'https://github.com/v' || c_custkey
      WHEN c_custkey % 5 = 0 AND c_custkey % 3 = 1 THEN 'https://www.reddit.com/user/v' || c_custkey END AS display_url
    FROM customer""",
)
def _(spark, d):
    return st.display_urls(_linked(spark, d)).select("c_custkey", "display_url")


@query(
    "p10_provenance_urls",
    """SELECT 'reddit-' || c_custkey AS id, 'https://reddit.com/user/user' || c_custkey AS source_url FROM customer
    UNION ALL SELECT 'hackernews-' || c_custkey, 'https://news.ycombinator.com/user?id=user' || c_custkey FROM customer
    UNION ALL SELECT 'github-' || c_custkey, NULL FROM customer
    UNION ALL SELECT 'http-' || p_partkey, NULL FROM part""",
)
def _(spark, d):
    rows = observations(spark, d, "reddit", "hackernews", "github", "http")
    return report.provenance_urls(rows).select("id", "source_url")


@query(
    "p11_known_platforms",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'GitHub' WHEN 1 THEN 'Twitter/X' WHEN 2 THEN 'HackerNews'
      WHEN 3 THEN 'Google Scholar' END AS platform FROM customer""",
)
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "element_at(array('https://www.GitHub.com/u', 'http://x.com/u', 'https://news.ycombinator.com/user?id=u', "
        "'https://scholar.google.com:443/u', 'https://sub.github.com/u'), CAST(c_custkey % 5 + 1 AS INT)) AS url",
    )
    return st.tag_platform(rows).select("c_custkey", "platform")


@query(
    "p11_page_platforms",
    r"""WITH h AS (SELECT page_id, regexp_extract(url, '//([^/?#:]+)', 1) AS host FROM pages),
      k AS (SELECT DISTINCT host FROM h WHERE NOT starts_with(host, 'www.')),
      a AS (SELECT host, 'Site ' || host AS platform FROM k UNION ALL SELECT 'www.' || host, 'Site ' || host FROM k)
    SELECT page_id, platform FROM h LEFT JOIN a USING (host)""",
)
def _(spark, d):
    rows = table(spark, d, "pages")
    host = F.regexp_extract("url", "//([^/?#:]+)", 1)
    known = rows.select(host.alias("host")).where(~F.col("host").startswith("www.")).distinct()
    known = known.withColumn("platform", F.concat(F.lit("Site "), "host"))
    return st.tag_platform(rows, "url", known).select("page_id", "platform")


@query(
    "p12_page_metadata",
    r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)</title\s*>', 1), ' ' || chr(10) || chr(9))
      AS title, length(html) AS content_length FROM pages""",
)
def _(spark, d):
    return pages.page_metadata(table(spark, d, "pages")).select("page_id", "title", "content_length")


@query(
    "p13_unparked_pages",
    r"""SELECT page_id, url FROM (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN html || ' Buy this Domain' WHEN 1
      THEN left(html, 300) ELSE html END AS html FROM pages) WHERE length(html) > 500 AND NOT regexp_matches(lower(html),
      'domain for sale|buy this domain|parked|coming soon|under construction|godaddy|namecheap|hover\.com')""",
)
def _(spark, d):
    html = "CASE page_id % 4 WHEN 0 THEN html || ' Buy this Domain' WHEN 1 THEN left(html, 300) ELSE html END AS html"
    return pages.filter_parked(table(spark, d, "pages").selectExpr("page_id", "url", html)).select("page_id", "url")


@query(
    "p14_safe_json",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"_raw":"k=' || event_id || '"}' WHEN 1 THEN '{}'
      ELSE replace(props, ' ', '') END AS parsed FROM events""",
)
def _(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN 'k=' || event_id WHEN 1 THEN NULL ELSE props END AS raw"
    )
    return st.safe_json(rows, "raw").select("event_id", F.to_json("parsed").alias("parsed"))


@query(
    "p15_split_ids",
    """SELECT page_id, 'url' AS id_type, url AS id_value FROM pages""",
)
def _(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", "'url:' || url AS id")
    return report.split_id(rows).select("page_id", "id_type", "id_value")


@query(
    "p19_comparison_keys",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'acme ' || lower(c_mktsegment) WHEN 1 THEN 'johndoe' || c_custkey
      WHEN 2 THEN 'john.doe' || c_custkey ELSE 'john doe' END AS name FROM customer""",
)
def _(spark, d):
    from linkloom.functions.values import comparison_key

    rows = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "element_at(array('Organization', 'Username', 'Email', 'Person'), CAST(c_custkey % 4 + 1 AS INT)) AS type",
        "element_at(array(\"Ac'me \" || c_mktsegment || ' Co Inc', 'John_Doe' || c_custkey, "
        "'John.Doe' || c_custkey || '@x.org', ' John Doe '), CAST(c_custkey % 4 + 1 AS INT)) AS value",
    )
    return rows.select("c_custkey", comparison_key(F.col("type"), F.col("value")).alias("name"))
