"""Queries for the extraction operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.catalog.derive import observations
from linkloom.catalog.registry import query, table, texts
from linkloom.operators import extract, text

# Same scans for the check tool; its word edges know ASCII letters only, which the test texts do not tell apart.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
_IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
_EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
_DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
_VALID = r"^(?:\*\.)?(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,18}$"


def text_scan_sql(source: str, keys: str, text_col: str = "text") -> str:
    """Distinct (type, value) per row of a text table, as a query."""
    last = f"regexp_extract(trim(split_part({text_col}, '@', -1), ' \t\n\r'), '^\\S+')"
    return f"""
    SELECT DISTINCT {keys}, type, value, lower(type) || ':' || value AS id FROM (
      SELECT {keys}, 'IP' AS type, unnest(regexp_extract_all({text_col}, '{_IPV4}')) AS value FROM {source}
      UNION ALL
      SELECT {keys}, 'Email', lower(unnest(regexp_extract_all({text_col}, '{_EMAIL}'))) FROM {source}
      UNION ALL
      SELECT {keys}, 'ASN', 'AS' || unnest(regexp_extract_all({text_col}, '(?i)\\bAS(\\d{{1,6}})\\b', 1)) FROM {source}
      UNION ALL
      SELECT {keys}, 'Domain', lower(value) FROM (
        SELECT {keys}, {text_col}, unnest(regexp_extract_all({text_col}, '{_DOMAIN}')) AS value FROM {source})
      WHERE NOT (contains({text_col}, '@') AND value = {last}) AND regexp_matches(lower(value), '{_VALID}')
    )"""


@query(
    "e1_text_entities",
    f"""SELECT doc_id, source, id, type, value, CAST(0.85 AS DOUBLE) AS confidence
    FROM ({text_scan_sql('documents', 'doc_id, source')})""",
)
def _(spark, d):
    return text.extract_from_text(
        texts(spark, d, "documents", "doc_id", "source", "text"), "text", ["doc_id", "source"]
    )


@query(
    "e1_text_entities_conversations",
    """WITH v AS (SELECT conv_id, turn, unnest([
        {'type': 'IP', 'value': '93.184.' || conv_id % 250 || '.' || turn},
        {'type': 'IP', 'value': '2001:db8::' || (1000 + conv_id % 9000)},
        {'type': 'Email', 'value': 'user' || conv_id || '@mail' || turn || '.example.org'},
        {'type': 'ASN', 'value': 'AS' || (64000 + turn)},
        {'type': 'URL', 'value': 'https://site' || conv_id % 97 || '.example.com/p/' || turn},
        {'type': 'Domain', 'value': 'site' || conv_id % 97 || '.example.com'},
        {'type': 'Domain', 'value': 'host' || turn || '.example.net'}]) AS e FROM conversations)
    SELECT conv_id, turn, lower(e.type) || ':' || e.value AS id, e.type AS type, e.value AS value FROM v""",
)
def _(spark, d):
    """Messages that name one value of each kind, and two domains."""
    said = (
        "coalesce(text, '') || ' from User' || conv_id || '@Mail' || turn || '.example.org at 93.184.' || conv_id % 250 || '.' "
        "|| turn || ' and 2001:0DB8:0::' || (1000 + conv_id % 9000) || ' in as' || (64000 + turn) || ', see https://site' "
        "|| conv_id % 97 || '.example.com/p/' || turn || ' or Host' || turn || '.Example.net'"
    )
    rows = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{said} AS text")
    return text.extract_from_text(rows, "text", ["conv_id", "turn"]).select("conv_id", "turn", "id", "type", "value")


# --- adapters ----------------------------------------------------------------------------------------------------
# Expected mentions and edges per source row: (type, value, confidence, properties) and (from, rel, to, confidence,
# method). Properties are written as sorted k=v pairs.

_MENTIONS = {
    "dns": (
        "SELECT *, s_suppkey AS k, 'inv-' || s_nationkey AS inv, 's' || s_suppkey || '.example.com' AS dom, "
        "s_suppkey % 256 AS x FROM supplier",
        """('Domain', dom, 0.95, ''),
        ('Email', CASE WHEN k % 10 = 9 THEN 'admin@' || dom END, 0.95, ''),
        ('IP', '198.51.' || s_nationkey || '.' || x, 0.9, ''), ('IP', '203.0.113.' || x, 0.9, ''),
        ('IP', '2001:db8::' || CASE WHEN k % 65536 = 0 THEN '' ELSE printf('%x', k % 65536) END, 0.9, ''),
        ('Domain', 'mx' || s_nationkey || '.example.org', 0.9, 'mx_priority=10'),
        ('Domain', 'mxb' || s_nationkey || '.example.org', 0.9, 'mx_priority=20'),
        ('Domain', 'ns' || s_nationkey || '.example.net', 0.9, ''),
        ('Domain', 'soa' || s_nationkey || '.example.net', 0.9, ''),
        ('Email', 'host@' || dom, 0.9, ''), ('IP', '192.0.2.' || x, 0.85, ''),
        ('Domain', 'ptr' || k || '.example.net', 0.9, '')""",
    ),
    "whois": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv, 'c' || c_custkey || '.example.com' AS dom, "
        "lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS dd FROM customer",
        """('Domain', dom, 0.9, 'creation_date=2020-01-' || dd || 'T00:00:00;expiry_date=2026-08-' || dd
            || 'T00:00:00;whois_status=["ok"]'),
        ('Organization', 'Registrar ' || c_nationkey || ' Inc.', 0.8, ''),
        ('Email', CASE WHEN k % 3 <> 0 THEN 'owner' || k || '@' || dom END, 0.75, ''),
        ('Organization', CASE WHEN k % 2 = 0 THEN 'Holding ' || c_mktsegment END, 0.7, ''),
        ('Domain', 'ns1.' || dom, 0.9, ''), ('Domain', 'ns' || c_nationkey || '.example.net', 0.9, ''),
        ('IP', '198.18.' || c_nationkey || '.1', 0.9, '')""",
    ),
    "certificate_transparency": (
        "SELECT *, o_orderkey AS k, 'inv-' || o_custkey % 25 AS inv, 'c' || o_custkey || '.example.com' AS dom "
        "FROM orders",
        """('Domain', dom, 0.95, '_ct_processed_certs=1;_ct_total_certs=1;_ct_truncated=false'),
        ('Certificate', '' || k, 0.9, ''), ('Organization', 'Issuer ' || o_orderpriority[1], 0.85, ''),
        ('Subdomain', 'www.' || dom, 0.9, ''), ('Domain', 'alt' || o_custkey % 100 || '.example.org', 0.75, ''),
        ('IP', '192.0.2.' || o_custkey % 256, 0.9, '')""",
    ),
    "http": (
        "SELECT *, p_partkey AS k, 'inv-' || p_partkey % 25 AS inv FROM part",
        """('Technology', 'nginx 1.' || p_size, 0.9, ''), ('Technology', 'PHP/8.' || p_size % 4, 0.95, ''),
        ('Email', 'sales' || k || '@shop' || k || '.example.com', 0.85, '')""",
    ),
    "ip_to_asn": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv FROM customer",
        """('IP', '198.51.' || c_nationkey || '.' || k % 256, 0.9, ''), ('ASN', 'AS' || 64500 + c_nationkey, 0.88, ''),
        ('Organization', 'Net ' || c_nationkey, 0.8, '')""",
    ),
    "threat_intel": (
        "SELECT *, s_suppkey AS k, 'inv-' || s_nationkey AS inv, 's' || s_suppkey || '.example.com' AS dom "
        "FROM supplier",
        """('IP', CASE WHEN k % 2 = 0 THEN '203.0.113.' || k % 256 END, 0.85, ''),
        ('Domain', CASE WHEN k % 2 = 1 THEN dom END, 0.85, 'profile_url=https://' || dom),
        ('ThreatIndicator', CASE WHEN k % 101 > 50 THEN 'AbuseIPDB score: ' || k % 101 || '/100' END, 0.85, ''),
        ('ThreatIndicator', CASE WHEN k % 3 = 0 THEN 'URLhaus: malware_' || s_nationkey END, 0.8, '')""",
    ),
    "github": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv FROM customer",
        """('Username', 'User' || k, 0.9, 'profile_url=https://github.com/User' || k),
        ('Email', 'user' || k || '@example.org', 0.8, ''),
        ('URL', 'https://www.c' || k || '.example.com/blog', 0.75, 'source=github_blog'),
        ('Domain', 'c' || k || '.example.com', 0.7, ''), ('Organization', 'Org ' || c_nationkey, 0.75, ''),
        ('Organization', 'team' || k % 11, 0.75, ''),
        ('Repository', 'repo' || k % 7, 0.85, 'profile_url=https://github.com/User' || k || '/repo' || k % 7),
        ('Repository', 'tool' || k % 5, 0.85, '')""",
    ),
    "gitlab": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv FROM customer",
        """('Username', 'user' || k, 0.9, 'profile_url=https://gitlab.com/user' || k),
        ('Email', 'user' || k || '@example.org', 0.8, ''), ('Organization', 'Org ' || c_nationkey, 0.75, ''),
        ('Repository', 'proj' || k % 9, 0.85, ''), ('Organization', 'grp' || c_nationkey, 0.7, '')""",
    ),
    "keybase": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv FROM customer WHERE c_custkey % 4 <> 0",
        """('Username', 'user' || k, 0.9, 'profile_url=https://keybase.io/user' || k),
        ('Person', 'Name' || k % 50 || ' Family' || c_nationkey, 0.7, ''), ('Username', 'tw' || k, 0.85, ''),
        ('URL', 'https://c' || k || '.example.com', 0.6, '')""",
    ),
    "reddit": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv FROM customer",
        "('Username', 'user' || k, 0.9, 'profile_url=https://reddit.com/user/user' || k)",
    ),
    "hackernews": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv FROM customer",
        "('Username', 'user' || k, 0.9, '')",
    ),
    "search": (
        "SELECT *, page_id AS k, 'inv-' || page_id % 25 AS inv, regexp_extract(url, '//([^/?#]+)', 1) AS h FROM pages",
        """('Domain', h, 0.7, 'profile_url=https://' || h), ('Email', 'web' || k || '@example.com', 0.6, ''),
        ('IP', '203.0.113.' || k % 256, 0.6, ''), ('Domain', 'Search results for: ' || h, 0.5, '')""",
    ),
    "username_probe": (
        "SELECT *, c_custkey AS k, 'inv-' || c_nationkey AS inv, "
        "'https://p' || c_custkey % 3 || '.example.net/user' || c_custkey AS u, "
        "CASE c_custkey % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Personal Website' ELSE 'GitHub' END AS pf "
        "FROM customer",
        """('Username', 'user' || k, 0.7, 'platform=' || pf || ';platform_key=k' || k % 3 || ';profile_url=' || u
            || ';snippet=S;source_type=platform_probe;title=T'),
        ('Person', CASE WHEN k % 3 = 0 THEN 'user' || k END, 0.7, 'platform=' || pf || ';profile_url=' || u || ';title=T'),
        ('URL', CASE WHEN k % 3 = 1 THEN u END, 0.75, 'platform=Personal Website;title=T'),
        ('URL', CASE WHEN k % 3 <> 1 THEN u END, 0.7, 'platform=' || pf)""",
    ),
}
_EDGES = {
    "dns": (
        """('domain:' || dom, 'associated_with_email', CASE WHEN k % 10 = 9 THEN 'email:admin@' || dom END, 1.0,
            'email_domain'),
        ('domain:' || dom, 'hosted_on', 'ip:198.51.' || s_nationkey || '.' || x, 0.9, 'dns_a_record'),
        ('domain:' || dom, 'hosted_on', 'ip:203.0.113.' || x, 0.9, 'dns_a_record'),
        ('domain:' || dom, 'hosted_on', 'ip:2001:db8::' || CASE WHEN k % 65536 = 0 THEN ''
            ELSE printf('%x', k % 65536) END, 0.9, 'dns_aaaa_record'),
        ('domain:' || dom, 'sends_mail_via', 'domain:mx' || s_nationkey || '.example.org', 0.9, 'dns_mx_record'),
        ('domain:' || dom, 'sends_mail_via', 'domain:mxb' || s_nationkey || '.example.org', 0.9, 'dns_mx_record'),
        ('domain:' || dom, 'uses_nameserver', 'domain:ns' || s_nationkey || '.example.net', 0.9, 'dns_ns_record'),
        ('domain:' || dom, 'uses_nameserver', 'domain:soa' || s_nationkey || '.example.net', 0.9, 'dns_soa_mname'),
        ('domain:' || dom, 'registered_by', 'email:host@' || dom, 0.7, 'dns_soa_rname'),
        ('domain:' || dom, 'has_ptr', 'domain:ptr' || k || '.example.net', 0.9, 'dns_ptr_record')"""
    ),
    "whois": (
        """('domain:' || dom, 'registered_with', 'organization:Registrar ' || c_nationkey || ' Inc.', 0.85,
            'whois_registrar'),
        ('domain:' || dom, 'registered_by', CASE WHEN k % 3 <> 0 THEN 'email:owner' || k || '@' || dom END, 0.85,
            'whois_registrant_email'),
        ('domain:' || dom, 'registered_by', CASE WHEN k % 2 = 0 THEN 'organization:Holding ' || c_mktsegment END, 0.7,
            'whois_registrant_name'),
        ('domain:' || dom, 'uses_nameserver', 'domain:ns1.' || dom, 0.85, 'whois_nameserver'),
        ('domain:' || dom, 'uses_nameserver', 'domain:ns' || c_nationkey || '.example.net', 0.85, 'whois_nameserver'),
        ('domain:ns' || c_nationkey || '.example.net', 'hosted_on', 'ip:198.18.' || c_nationkey || '.1', 0.85,
            'whois_nameserver_ip')"""
    ),
    "certificate_transparency": (
        """('domain:' || dom, 'covered_by_certificate', 'certificate:' || k, 0.9, 'ct_certificate'),
        ('certificate:' || k, 'issued_by', 'organization:Issuer ' || o_orderpriority[1], 0.9, 'ct_issuer'),
        ('domain:' || dom, 'has_subdomain', 'subdomain:www.' || dom, 0.9, 'ct_san'),
        ('domain:alt' || o_custkey % 100 || '.example.org', 'covered_by_certificate', 'certificate:' || k, 0.8, 'ct_san'),
        ('domain:' || dom, 'hosted_on', 'ip:192.0.2.' || o_custkey % 256, 0.8, 'ct_san_ip')"""
    ),
    "username_probe": (
        """('username:user' || k, 'has_account_on', CASE WHEN k % 3 <> 1 THEN 'url:' || u END, 0.7, 'username_probe')"""
    ),
}
# Edges between known entities.
_LINKS = {
    "dns": (
        """('domain:' || dom, 'hosted_on', 'ip:198.51.' || s_nationkey || '.' || x, 0.95, 'dns_a_record'),
        ('domain:' || dom, 'hosted_on', 'ip:203.0.113.' || x, 0.95, 'dns_a_record'),
        ('domain:' || dom, 'hosted_on', 'ip:2001:db8::' || CASE WHEN k % 65536 = 0 THEN ''
            ELSE printf('%x', k % 65536) END, 0.95, 'dns_aaaa_record'),
        ('domain:' || dom, 'uses_nameserver', 'domain:ns' || s_nationkey || '.example.net', 0.95, 'dns_ns_record'),
        ('domain:' || dom, 'sends_mail_via', 'domain:mx' || s_nationkey || '.example.org', 0.9, 'dns_mx_record'),
        ('domain:' || dom, 'sends_mail_via', 'domain:mxb' || s_nationkey || '.example.org', 0.9, 'dns_mx_record')"""
    ),
    "whois": (
        """('domain:' || dom, 'registered_by', CASE WHEN k % 3 <> 0 THEN 'email:owner' || k || '@' || dom END, 0.8,
            'whois_registrant_email'),
        ('domain:' || dom, 'registered_with', 'organization:Registrar ' || c_nationkey || ' Inc.', 0.85,
            'whois_registrar'),
        ('domain:' || dom, 'uses_nameserver', 'domain:ns1.' || dom, 0.9, 'whois_nameserver'),
        ('domain:' || dom, 'uses_nameserver', 'domain:ns' || c_nationkey || '.example.net', 0.9, 'whois_nameserver')"""
    ),
    "certificate_transparency": (
        """('domain:' || dom, 'covered_by_certificate', 'certificate:' || k, 0.9, 'ct_certificate'),
        ('certificate:' || k, 'issued_by', 'organization:Issuer ' || o_orderpriority[1], 0.85, 'ct_issuer'),
        ('domain:' || dom, 'has_subdomain', 'subdomain:www.' || dom, 0.9, 'ct_san')"""
    ),
    "ip_to_asn": (
        """('ip:198.51.' || c_nationkey || '.' || k % 256, 'belongs_to_asn', 'asn:AS' || 64500 + c_nationkey, 0.9,
            'ip_to_asn'),
        ('ip:198.51.' || c_nationkey || '.' || k % 256, 'operated_by', 'organization:Net ' || c_nationkey, 0.8,
            'ip_to_asn')"""
    ),
    "threat_intel": (
        """(CASE WHEN k % 2 = 0 THEN 'ip:203.0.113.' || k % 256 ELSE 'domain:' || dom END, 'associated_with_threat',
            CASE WHEN k % 101 > 50 THEN 'threatindicator:abuse_score_' || k % 101 END, 0.85, 'threat_intel_abuseipdb'),
        (CASE WHEN k % 2 = 0 THEN 'ip:203.0.113.' || k % 256 ELSE 'domain:' || dom END, 'associated_with_threat',
            CASE WHEN k % 3 = 0 THEN 'threatindicator:urlhaus_malware_' || s_nationkey END, 0.8,
            'threat_intel_urlhaus')"""
    ),
    "github": (
        """('username:User' || k, 'associated_with_email', 'email:user' || k || '@example.org', 0.8, 'github_profile'),
        ('username:User' || k, 'member_of', 'organization:Org ' || c_nationkey, 0.75, 'github_profile'),
        ('username:User' || k, 'member_of', 'organization:team' || k % 11, 0.75, 'github_profile'),
        ('username:User' || k, 'owns_repository', 'repository:repo' || k % 7, 0.85, 'github_repos'),
        ('username:User' || k, 'owns_repository', 'repository:tool' || k % 5, 0.85, 'github_repos')"""
    ),
}


def _structs(rows: str, names: list[str]) -> str:
    """Tuples as a list of structs."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(rows):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
            if depth == 1:
                start = i + 1
                fields = []
        elif not quoted and c in ")]":
            depth -= 1
            if depth == 0:
                fields.append(rows[start:i])
                parts.append(fields)
        elif not quoted and depth == 1 and c == ",":
            fields.append(rows[start:i])
            start = i + 1
    made = []
    for fields in parts:
        named = []
        for name, text_ in zip(names, fields):
            cast = "DOUBLE" if name == "confidence" else "VARCHAR"
            named.append(f"'{name}': CAST({text_.strip()} AS {cast})")
        made.append("{" + ", ".join(named) + "}")
    return "[" + ", ".join(made) + "]"


def mentions_sql(*adapters: str) -> str:
    parts = []
    for a in adapters:
        base, rows = _MENTIONS[a]
        structs = _structs(rows, ["type", "value", "confidence", "properties"])
        # three kinds of ids are not simply type:value
        entity = """CASE WHEN m.type = 'Technology' THEN 'technology:' || lower(m.value)
            WHEN m.value LIKE 'AbuseIPDB score: %' THEN 'threatindicator:abuse_score_'
                || regexp_extract(m.value, '(\\d+)/100', 1)
            WHEN m.value LIKE 'URLhaus: %' THEN 'threatindicator:urlhaus_' || m.value[10:]
            WHEN m.value LIKE 'Search results for: %' THEN 'search_result:' || m.value[21:] || ':' || m.value[21:]
            ELSE lower(m.type) || ':' || m.value END"""
        parts.append(
            f"""SELECT inv AS investigation_id, '{a}-' || k AS observation_id, '{a}' AS source, {entity} AS id,
            m.type AS type, m.value AS value, m.confidence AS confidence, m.properties AS properties
            FROM (SELECT *, unnest({structs}) AS m FROM ({base})) WHERE m.value IS NOT NULL"""
        )
    return " UNION ALL ".join(parts)


def edges_sql(expected: dict[str, str], *adapters: str) -> str:
    parts = []
    for a in adapters:
        structs = _structs(expected[a], ["source_id", "rel", "target_id", "confidence", "method"])
        parts.append(
            f"""SELECT inv AS investigation_id, '{a}-' || k AS observation_id,
            m.source_id || ':' || m.rel || ':' || m.target_id AS id, m.source_id AS source_id,
            m.target_id AS target_id, m.rel AS relationship_type, m.confidence AS confidence, m.method AS method
            FROM (SELECT *, unnest({structs}) AS m FROM ({_MENTIONS[a][0]})) WHERE m.target_id IS NOT NULL"""
        )
    return " UNION ALL ".join(parts)


def links_sql(*adapters: str) -> str:
    return edges_sql(_LINKS, *adapters)


def shown(mentions: DataFrame) -> DataFrame:
    """Mentions with their properties as text."""
    pairs = F.array_sort(
        F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    )
    return mentions.drop("seen_at").withColumn("properties", F.array_join(pairs, ";"))


_JOBS = {
    "e4_dns": (extract.extract_dns, ["dns"]),
    "e5_whois": (extract.extract_whois, ["whois"]),
    "e6_certificates": (extract.extract_ct, ["certificate_transparency"]),
    "e7_http": (extract.extract_http, ["http"]),
    "e8_github": (extract.extract_github, ["github"]),
    "e9_gitlab": (extract.extract_gitlab, ["gitlab"]),
    "e10_keybase": (extract.extract_keybase, ["keybase"]),
    "e11_profiles": (extract.extract_profiles, ["reddit", "hackernews"]),
    "e12_ip_asn": (extract.extract_ip_asn, ["ip_to_asn"]),
    "e13_threat": (extract.extract_threat, ["threat_intel"]),
    "e14_search": (extract.extract_search, ["search"]),
    "e16_accounts": (extract.extract_accounts, ["username_probe"]),
}


def _register() -> None:
    for name, (job, adapters) in _JOBS.items():

        @query(f"{name}_entities", mentions_sql(*adapters))
        def _(spark, d, job=job, adapters=adapters):
            return shown(job(observations(spark, d, *adapters))[0])

        if adapters[0] in _EDGES:

            @query(f"{name}_edges", edges_sql(_EDGES, *adapters))
            def _(spark, d, job=job, adapters=adapters):
                return job(observations(spark, d, *adapters))[1].drop("seen_at")


_register()

_KNOWN = [a for a in _MENTIONS]
_JSON_TEXT = (
    r"""(SELECT doc_id, source AS inv, '{"text":"' || replace(replace(replace(replace(replace(text, '\', '\\'), '"',"""
    r""" '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"}' AS text FROM documents)"""
)
_GENERIC = f"""SELECT inv AS investigation_id, 'newsfeed-' || doc_id AS observation_id, 'generic' AS source, id, type,
    value, CAST(0.85 AS DOUBLE) AS confidence, '' AS properties
    FROM ({text_scan_sql(_JSON_TEXT, 'doc_id, inv')})"""


@query("e17_unknown_adapter_entities", _GENERIC)
def _(spark, d):
    return shown(extract.extract_generic(observations(spark, d, "newsfeed")))


@query("e18_all_adapters_entities", mentions_sql(*_KNOWN) + " UNION ALL " + _GENERIC)
def _(spark, d):
    return shown(extract.extract_all(observations(spark, d))[0])


@query("e18_all_adapters_edges", edges_sql(_EDGES, *_EDGES))
def _(spark, d):
    return extract.extract_all(observations(spark, d))[1].drop("seen_at")


def _sensor(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An adapter of the caller's own: a host and the sensor that saw it."""
    p = F.from_json("raw_response", "host STRING, sensor STRING")
    rows = obs.select(
        "investigation_id", F.col("id").alias("observation_id"), F.col("source_adapter").alias("source"),
        F.col("collected_at").alias("seen_at"), p.alias("p"),
    )
    host, sensor = F.lower("p.host"), F.col("p.sensor")
    keys = ["investigation_id", "observation_id", "source", "seen_at"]
    none = F.create_map().cast("map<string,string>")
    mentions = rows.select(
        *keys, F.concat(F.lit("domain:"), host).alias("id"), F.lit("Domain").alias("type"), host.alias("value"),
        F.lit(0.8).alias("confidence"), none.alias("properties"),
    )
    ends = rows.select(*keys, F.concat(F.lit("domain:"), host).alias("source_id"), F.concat(F.lit("sensor:"), sensor).alias("target_id"))
    edges = ends.select(
        "investigation_id", "observation_id", "seen_at", F.concat_ws(":", "source_id", F.lit("seen_by"), "target_id").alias("id"),
        "source_id", "target_id", F.lit("seen_by").alias("relationship_type"), F.lit(0.6).alias("confidence"),
        F.lit("sensor").alias("method"),
    )
    return mentions, edges


def _sensed(spark, d):
    """Mentions and edges of customers seen by sensors, beside those of a built-in adapter."""
    rows = observations(spark, d, "reddit").unionByName(
        observations(spark, d, "whois").withColumns(
            {
                "source_adapter": F.lit("sensor"),
                "id": F.concat(F.lit("sensor-"), "id"),
                "raw_response": F.to_json(F.struct(F.upper("target").alias("host"), F.col("investigation_id").alias("sensor"))),
            }
        )
    )
    extract.register_extractor("sensor", _sensor)
    try:
        return extract.extract_all(rows, adapters=["reddit"])
    finally:
        extract.unregister_extractor("sensor")


@query(
    "e18_own_extractor_entities",
    mentions_sql("reddit")
    + """ UNION ALL SELECT 'inv-' || c_nationkey, 'sensor-whois-' || c_custkey, 'sensor',
      'domain:c' || c_custkey || '.example.com', 'Domain', 'c' || c_custkey || '.example.com', 0.8::DOUBLE, '' FROM customer""",
)
def _(spark, d):
    return shown(_sensed(spark, d)[0])


@query(
    "e18_own_extractor_edges",
    """SELECT 'inv-' || c_nationkey AS investigation_id, 'sensor-whois-' || c_custkey AS observation_id,
      'domain:c' || c_custkey || '.example.com:seen_by:sensor:inv-' || c_nationkey AS id,
      'domain:c' || c_custkey || '.example.com' AS source_id, 'sensor:inv-' || c_nationkey AS target_id,
      'seen_by' AS relationship_type, 0.6::DOUBLE AS confidence, 'sensor' AS method FROM customer""",
)
def _(spark, d):
    return _sensed(spark, d)[1].drop("seen_at")


@query(
    "e6_large_certificate_payloads",
    """SELECT 'inv-' || n AS investigation_id, 'certificate:' || n || '-' || unnest(range(150)) AS id FROM
      (SELECT n_nationkey AS n FROM nation) UNION ALL SELECT 'inv-' || n_nationkey, 'domain:n' || n_nationkey
      || '.example.com' FROM nation UNION ALL SELECT 'inv-' || n, 'subdomain:h' || unnest(range(150)) || '.n' || n
      || '.example.com' FROM (SELECT n_nationkey AS n FROM nation) UNION ALL SELECT 'inv-' || n_nationkey,
      'organization:CA' FROM nation""",
)
def _(spark, d):
    """Payloads of 150 certificates: none is left out."""
    cert = """named_struct('id', n_nationkey || '-' || k, 'issuer_name', 'O=CA', 'name_value',
      'h' || k || '.n' || n_nationkey || '.example.com')"""
    rows = table(spark, d, "nation").selectExpr(
        "'o' || n_nationkey AS id", "'inv-' || n_nationkey AS investigation_id", "'certificate_transparency' AS source_adapter",
        "timestamp'2024-01-01' AS collected_at", "'n' || n_nationkey || '.example.com' AS target",
        f"to_json(named_struct('certificates', transform(sequence(0, 149), k -> {cert}))) AS raw_response",
    )
    return extract.extract_ct(rows)[0].select("investigation_id", "id").distinct()


@query(
    "e2_header_technologies",
    """SELECT p_partkey, unnest(['technology:nginx 1.' || p_size, 'technology:php/8.' || p_size % 4]) AS technology_id,
    unnest(['nginx 1.' || p_size, 'PHP/8.' || p_size % 4]) AS technology,
    unnest([CAST(0.9 AS DOUBLE), 0.95]) AS confidence FROM part""",
)
def _(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", "map('server', 'nginx/1.' || p_size, 'x-powered-by', 'PHP/8.' || p_size % 4) AS headers"
    )
    return extract.extract_header_tech(rows)


@query(
    "e3_detected_technologies",
    """SELECT p_partkey, t.name AS name, t.source AS source, t.version AS version FROM (
    SELECT p_partkey, unnest([
      {'name': 'Nginx', 'source': 'header:server', 'version': '1.' || p_size, 'ok': p_type = 'SMALL'},
      {'name': 'Apache', 'source': 'header:server', 'version': '2.' || p_size || '.1', 'ok': p_type <> 'SMALL'},
      {'name': 'PHP', 'source': 'cookie', 'version': '', 'ok': p_size % 2 = 0},
      {'name': 'Java', 'source': 'cookie', 'version': '', 'ok': p_size % 2 = 1},
      {'name': 'Express.js', 'source': 'header:x-powered-by', 'version': '', 'ok': p_size % 3 = 0}]) AS t
    FROM part) WHERE t.ok""",
)
def _(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_partkey",
        "map('Server', if(p_type = 'SMALL', 'NGINX/1.' || p_size, 'Apache/2.' || p_size || '.1 (Unix)'), "
        "'X-Powered-By', if(p_size % 3 = 0, 'Express', 'none')) AS headers",
        "array(if(p_size % 2 = 0, 'PHPSESSID', 'JSESSIONID'), 'other') AS cookies",
    )
    return extract.detect_technologies(rows, ["p_partkey"], "headers", "cookies")


@query(
    "e6a_first_certificate_entries",
    """SELECT c AS custkey, id, o_orderkey AS entry FROM (SELECT o_custkey AS c, o_orderkey // 4 AS id, o_orderkey,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey // 4 ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""",
)
def _(spark, d):
    rows = table(spark, d, "orders").selectExpr("o_custkey AS custkey", "o_orderkey div 4 AS id", "o_orderkey AS entry")
    return extract.ct_first_entries(rows, ["custkey"], ["entry"])


@query(
    "e6b_certificate_subdomains",
    """SELECT DISTINCT 'inv-' || o_custkey % 25 AS investigation_id, 'c' || o_custkey || '.example.com' AS target,
    unnest(['c' || o_custkey || '.example.com', 'www.c' || o_custkey || '.example.com']) AS subdomain FROM orders""",
)
def _(spark, d):
    return extract.ct_subdomains(observations(spark, d, "certificate_transparency"))


@query(
    "e15_search_hit_entities",
    """SELECT page_id, regexp_extract(lower(url), '//([^/?#:]+)', 1) || ',' || 'site' || page_id % 9 || '.example.org'
      AS domains, 'info' || page_id || '@site' || page_id % 9 || '.example.org' AS emails, url AS urls,
      '010.0.0.' || page_id % 256 AS ips FROM (SELECT *, url LIKE '%.html%' AS h FROM pages)""",
)
def _(spark, d):
    hits = table(spark, d, "pages").selectExpr(
        "page_id",
        "'Logo.png main.css' AS title",
        "concat('mail Info', page_id, '@Site', page_id % 9, '.Example.org from 010.0.0.', page_id % 256) AS snippet",
        "url",
    )
    found = text.extract_search_hits(hits)
    # page names such as 825.html look like domains; they are left to the address rule of each list
    names = F.filter("domains", lambda n: ~n.rlike(r"\.html$"))
    ordered = F.array_sort(names, lambda a, b: F.when(a.startswith("site"), 1).when(b.startswith("site"), -1).otherwise(0))
    return found.select(
        "page_id",
        F.array_join(ordered, ",").alias("domains"),
        *[F.array_join(c, ",").alias(c) for c in ("emails", "urls", "ips")],
    )


@query(
    "e_rejected_payloads",
    """SELECT 'o' || event_id AS id FROM events WHERE event_id % 7 = 0""",
)
def _(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "'o' || event_id AS id", "if(event_id % 7 = 0, left(props, length(props) - 1), props) AS raw_response"
    )
    return extract.rejected_observations(rows).select("id")
