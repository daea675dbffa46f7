"""Extraction from payloads and text."""

import json

from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.operators import extract, link, resolve, text


def observations(spark, *rows):
    """rows: (adapter, target, payload)"""
    data = [
        (f"o{i}", "inv", adapter, target, payload if isinstance(payload, (str, type(None))) else json.dumps(payload))
        for i, (adapter, target, payload) in enumerate(rows)
    ]
    df = spark.createDataFrame(
        data, "id string, investigation_id string, source_adapter string, target string, raw_response string"
    )
    empty = spark.createDataFrame([], schemas.OBSERVATIONS)
    return df.withColumn("collected_at", F.lit("2024-01-01").cast("timestamp")).unionByName(
        empty, allowMissingColumns=True
    )


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def texts(spark, *rows):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    return {
        i: sorted(r.id for r in text.extract_from_text(df, "text", ["i"]).where(F.col("i") == i).collect())
        for i in range(len(rows))
    }


def test_text_scan(spark):
    found = texts(
        spark,
        "Contact admin@Example.com from 8.8.8.8, AS13335 and https://Example.com/x/.",
        "nothing here",
        "std::x and 2001:db8:0:0:0:0:0:1 in one line",
        "twice 1.1.1.1 and 1.1.1.1; a.com and A.com",
        "mails x@one.org and y@two.org end",
        "éa.com has no word edge before a.com but b.com has",
        None,
    )
    assert found[0] == [
        "asn:AS13335",
        # the URL's host is also the word behind the last '@'
        "email:admin@example.com",
        "ip:8.8.8.8",
        "url:https://example.com/x/.",
    ]
    assert found[1] == []
    # a scan takes what looks like the start of an address
    assert found[2] == ["ip:2001:db8::1", "ip:d::"]
    assert found[3] == ["domain:a.com", "ip:1.1.1.1"]
    # only the word behind the last '@' is known to belong to an address
    assert found[4] == ["domain:one.org", "email:x@one.org", "email:y@two.org"]
    assert "domain:b.com" in found[5] and "domain:a.com" in found[5]
    assert found[6] == []


def test_text_scan_without_email_domains(spark):
    df = spark.createDataFrame([(0, "mails x@one.org and y@two.org, see three.org")], "i int, text string")
    rows = text.extract_from_text(df, "text", ["i"], exclude_email_domains=True)
    assert ids(rows) == ["domain:three.org", "email:x@one.org", "email:y@two.org"]


DNS = {
    "A": [{"type": "A", "value": "185.220.100.252"}],
    "NS": ["ns1.malicious-example.com.", "ns2.malicious-example.com"],
    "MX": [{"exchange": "10 mail.example.org"}, "20 mx.example.net"],
    "SOA": {"mname": "ns1.malicious-example.com", "rname": "admin.example.com"},
}


def test_seed_domain(spark):
    obs = observations(spark, ("dns", "malicious-example.com", DNS))
    mentions, edges = extract.extract_dns(obs)
    found = {r.id: r for r in resolve.resolve_exact(mentions).collect()}
    assert set(found) == {
        "domain:malicious-example.com",
        "ip:185.220.100.252",
        "domain:ns1.malicious-example.com",
        "domain:ns2.malicious-example.com",
        "domain:mail.example.org",
        "domain:mx.example.net",
        "email:admin@example.com",
    }
    assert found["domain:mail.example.org"].properties == {"mx_priority": "10"}
    assert found["domain:mx.example.net"].properties == {"mx_priority": "20"}
    kinds = {(r.relationship_type, r.target_id) for r in edges.collect()}
    assert ("hosted_on", "ip:185.220.100.252") in kinds
    assert ("uses_nameserver", "domain:ns1.malicious-example.com") in kinds
    assert ("registered_by", "email:admin@example.com") in kinds


def test_seed_ip(spark):
    obs = observations(spark, ("ip_to_asn", "185.220.100.252", {"asn": "209103", "organization": "Zwiebelfreunde"}))
    mentions, _ = extract.extract_ip_asn(obs)
    assert ids(mentions) == ["asn:AS209103", "ip:185.220.100.252", "organization:Zwiebelfreunde"]
    edges = link.detect_relationships(obs, resolve.resolve_exact(mentions))
    assert {r.relationship_type for r in edges.collect()} == {"belongs_to_asn", "operated_by"}


def test_reverse_dns_keeps_the_ip_as_anchor(spark):
    obs = observations(spark, ("dns", "8.8.8.8", {"PTR": ["dns.google."]}))
    mentions, edges = extract.extract_dns(obs)
    assert ids(mentions) == ["domain:dns.google", "ip:8.8.8.8"]
    assert ids(edges) == ["ip:8.8.8.8:has_ptr:domain:dns.google"]


def test_whois_hides_redacted_registrants_and_reads_both_nameserver_fields(spark):
    payload = {
        "registrar": "Example Registrar",
        "registrant_email": "redacted for privacy",
        "registrant_name": "WhoisGuard",
        "name_servers": ["ns1.example.com", "1.1.1.1", "REDACTED", {"name": "ns2.example.com", "ipv6": "2001:db8::2"}],
        "creation_date": "30-Aug-2020",
    }
    mentions, edges = extract.extract_whois(observations(spark, ("whois", "Example.com", payload)))
    assert ids(mentions) == [
        "domain:example.com",
        "domain:ns1.example.com",
        "domain:ns2.example.com",
        "ip:1.1.1.1",
        "ip:2001:db8::2",
        "organization:Example Registrar",
    ]
    assert "domain:ns2.example.com:hosted_on:ip:2001:db8::2" in ids(edges)
    anchor = [r for r in mentions.collect() if r.id == "domain:example.com"][0]
    assert anchor.properties["creation_date"] == "2020-08-30T00:00:00"


def test_certificates_over_the_limit_are_counted(spark):
    certs = [{"id": i, "issuer_name": "O=CA", "name_value": f"h{i}.x.com\nx.com\nother.org"} for i in range(105)]
    obs = observations(spark, ("certificate_transparency", "x.com", {"certificates": certs}))
    mentions, _ = extract.extract_ct(obs, max_certs=100)
    rows = mentions.collect()
    assert len({r.id for r in rows if r.type == "Certificate"}) == 100
    anchor = [r for r in rows if r.id == "domain:x.com"][0]
    assert anchor.properties == {
        "_ct_total_certs": "105", "_ct_processed_certs": "100", "_ct_truncated": "true",
    }
    everything, _ = extract.extract_ct(obs)
    assert everything.where("type = 'Certificate'").count() == 105


def test_github_blog_forms(spark):
    rows = [
        ("github", f"u{i}", {"profile": {"login": f"u{i}", "blog": blog}})
        for i, blog in enumerate(["https://www.Example.com/", "example.org/me", "", "  ", "localhost"])
    ]
    mentions, _ = extract.extract_github(observations(spark, *rows))
    found = {(r.observation_id, r.id) for r in mentions.where("type in ('URL', 'Domain')").collect()}
    assert found == {
        ("o0", "url:https://www.example.com"),
        ("o0", "domain:example.com"),
        ("o1", "url:https://example.org/me"),
        ("o1", "domain:example.org"),
        ("o4", "url:https://localhost"),
    }


def test_profiles_need_to_be_found(spark):
    obs = observations(
        spark,
        ("keybase", "a", {"found": False, "profile": {"username": "a"}}),
        ("reddit", "b", {"found": True}),
        ("hackernews", "c", {"found": True, "profile": {}}),
    )
    mentions, _ = extract.extract_all(obs)
    # an empty profile object still parses, so the target stands in for the name
    assert set(ids(mentions)) <= {"username:c"}


def test_empty_and_broken_payloads_yield_nothing(spark):
    obs = observations(
        spark, ("dns", "x.com", "{}"), ("dns", "x.com", ""), ("dns", "x.com", None), ("github", "x", "not json")
    )
    mentions, edges = extract.extract_all(obs)
    assert set(ids(mentions)) <= {"username:x"} and ids(edges) == []
    assert ids(extract.rejected_observations(obs)) == ["o3"]


def test_email_targets_always_yield_the_email(spark):
    obs = observations(spark, ("http", "Me@Example.com", {"title": "hi"}), ("whois", "me@example.com", {"registrar": "R"}))
    mentions, edges = extract.extract_all(obs)
    assert [r.confidence for r in mentions.where("observation_id = 'o0' and type = 'Email'").collect()] == [1.0]
    assert "domain:example.com:associated_with_email:email:me@example.com" in ids(edges)


def test_threat_indicators_and_links(spark):
    payload = {"abuseipdb": {"abuse_confidence_score": 90}, "urlhaus": {"threat": "malware"}}
    low = {"abuseipdb": {"abuse_confidence_score": 50}}
    obs = observations(spark, ("threat_intel", "1.2.3.4", payload), ("threat_intel", "bad.com", low))
    mentions, _ = extract.extract_threat(obs)
    assert ids(mentions) == [
        "domain:bad.com", "ip:1.2.3.4", "threatindicator:abuse_score_90", "threatindicator:urlhaus_malware",
    ]
    edges = link.link_threat(obs, resolve.resolve_exact(mentions))
    assert edges.count() == 2


def test_own_extractor(spark):
    def mine(obs):
        rows = obs.select(
            "investigation_id", F.col("id").alias("observation_id"), F.col("source_adapter").alias("source"),
            F.col("collected_at").alias("seen_at"), F.lit("person:me").alias("id"), F.lit("Person").alias("type"),
            F.lit("me").alias("value"), F.lit(0.5).alias("confidence"),
            F.create_map().cast("map<string,string>").alias("properties"),
        )
        return rows, extract.extract_dns(obs)[1]

    extract.register_extractor("badge", mine)
    try:
        mentions, _ = extract.extract_all(observations(spark, ("badge", "x", {"a": 1}), ("reddit", "r", {"found": True, "profile": {"name": "r"}})))
        assert ids(mentions) == ["person:me", "username:r"]
    finally:
        extract._CUSTOM.clear()


def test_search_hits(spark):
    df = spark.createDataFrame(
        [("See Example.com", "mail A@B.org, style.css", "https://x.io/p?q=1")], "title string, snippet string, url string"
    )
    row = text.extract_search_hits(df).first()
    assert row.domains == ["b.org", "example.com", "x.io"]
    assert row.emails == ["a@b.org"] and row.urls == ["https://x.io/p?q=1"]


def test_links_within_their_own_mentions(spark):
    """One pass gives the links that two passes give."""
    payloads = ("a.com", {"A": ["192.0.2.1"], "NS": ["ns.b.net"]}), ("x@c.org", {"A": ["192.0.2.2"]})
    rows = observations(spark, *[("dns", *p) for p in payloads])
    ents = extract.extract_dns(rows)[0].select("investigation_id", "id")
    want = link.link_dns(rows, ents)
    got = link.links_within(rows, "dns")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0


def test_news_are_scanned_as_text(spark):
    """An escaped line end is no letter of the address behind it."""
    from linkloom.catalog.browsing import _newsfeed
    from linkloom.plans.correlate import correlate

    rows = observations(spark, ("newsfeed", "doc1", {"text": "write to\nthe.65@mail7.example.com"}))
    extract.register_extractor("newsfeed", _newsfeed)
    try:
        found = correlate(rows, "2024-02-15 00:00:00")["entities"]
    finally:
        extract.unregister_extractor("newsfeed")
    assert ids(found) == ["email:the.65@mail7.example.com"]
    assert ids(correlate(rows, "2024-02-15 00:00:00")["entities"]) != ids(found)
