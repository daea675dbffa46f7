"""Single-value rules: inputs with the results they must have."""

import datetime as dt
import ipaddress

import pytest
from columns import column
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import values

KINDS = {
    "example.com": "domain",
    "sub.example.co.uk": "domain",
    "example.com.": "domain",
    "192.168.1.1": "ip",
    "999.1.1.1": "ip",
    "2001:db8::1": "ip",
    "::1": "ip",
    "::": "ip",
    "fe:: junk": "username",
    "https://example.com/a?b=c": "url",
    "HTTP://Example.com:8080": "url",
    "ftp://example.com": "username",
    "user@example.com": "email",
    "user@192.168.1.1": "email",
    "user@": "username",
    "john_doe": "username",
    "": "unknown",
    "   ": "unknown",
}


def test_target_kinds(spark):
    got = column(spark, list(KINDS), values.target_type)
    assert dict(zip(KINDS, got)) == KINDS


def test_loose_ipv6_accepts_text_that_starts_like_an_address(spark):
    assert column(spark, ["fe:: junk"], lambda x: values.target_type(x, strict=False)) == ["ip"]


DOMAINS = {
    "Example.COM": "example.com",
    " example.com.. ": "example.com",
    "*.Example.com": "*.example.com",
    "bücher.example": "xn--bcher-kva.example",
    "192.168.1.1": "",
    "no_dots": "",
    "under_score.com": "",
    "-bad.com": "",
    "a..b.com": "",
    "": "",
}


def test_domains(spark):
    got = column(spark, list(DOMAINS), values.domain)
    assert dict(zip(DOMAINS, got)) == DOMAINS


def test_ips(spark):
    cases = {
        "192.168.001.001": "192.168.1.1",
        " 8.8.8.8 ": "8.8.8.8",
        "256.1.1.1": "256.1.1.1",
        "2001:0DB8:0000:0000:0000:0000:0000:0001": "2001:db8::1",
        "FE80::1": "fe80::1",
        "Not An IP": "not an ip",
        "1.2.3": "1.2.3",
    }
    got = column(spark, list(cases), values.ip)
    assert dict(zip(cases, got)) == cases


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 2**128 - 1), min_size=60, max_size=60), st.lists(st.integers(0, 255), min_size=60, max_size=60))
def test_ipv6_matches_the_standard_library(spark, numbers, masks):
    # blanking random groups makes runs of zeros
    texts = []
    for n, m in zip(numbers, masks):
        groups = [0 if m >> i & 1 else n >> 16 * i & 0xFFFF for i in range(8)]
        texts.append(":".join(f"{g:04X}" for g in groups))
    want = [str(ipaddress.ip_address(t)) for t in texts]
    # addresses that embed IPv4 have their own written form there
    keep = [i for i, w in enumerate(want) if "." not in w]
    got = column(spark, texts, values.ip)
    assert [got[i] for i in keep] == [want[i] for i in keep]


def test_address_validity(spark):
    texts = ["1.2.3.4", "01.2.3.4", "1.2.3.256", "::1", "1::2::3", "12345::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "::ffff:1.2.3.4"]

    def valid(t):
        try:
            return ipaddress.ip_address(t).version
        except ValueError:
            return None

    assert column(spark, texts, values.ip_version) == [valid(t) for t in texts]


URLS = {
    "HTTP://Example.COM:80/Path/": "http://example.com/Path",
    "https://example.com:443": "https://example.com",
    "https://example.com:8443/": "https://example.com:8443",
    "https://user:secret@example.com/x": "https://example.com/x",
    "https://example.com/a/?Q=1#Frag": "https://example.com/a?Q=1#Frag",
    "https://example.com/a;p=1?x": "https://example.com/a;p=1?x",
    "https://example.com:99999/A": "https://example.com:99999/a",
    "https://example.com/": "https://example.com",
}


def test_urls(spark):
    got = column(spark, list(URLS), values.url)
    assert dict(zip(URLS, got)) == URLS


TIMES = {
    "2026-08-30T12:00:00Z": dt.datetime(2026, 8, 30, 12),
    "2026-08-30T12:00:00.250Z": dt.datetime(2026, 8, 30, 12, 0, 0, 250000),
    "2026-08-30T12:00:00+02:00": dt.datetime(2026, 8, 30, 10),
    "Sun, 30 Aug 2026 12:00:00 +0000": dt.datetime(2026, 8, 30, 12),
    "Aug 30, 2026": dt.datetime(2026, 8, 30),
    "Aug 30 2026": None,
    "30-Aug-2026": dt.datetime(2026, 8, 30),
    "1788091200": dt.datetime(2026, 8, 30, 12),
    "1788091200000": dt.datetime(2026, 8, 30, 12),
    "2026-08-30": dt.datetime(2026, 8, 30),
    "30/08/2026": dt.datetime(2026, 8, 30),
    "08/30/2026": None,
    "2026-08-30 12:00:00": dt.datetime(2026, 8, 30, 12),
    "soon": None,
    "": None,
}


def test_timestamps(spark):
    got = column(spark, list(TIMES), lambda x: values.timestamp(x).cast("timestamp_ntz"))
    assert dict(zip(TIMES, got)) == TIMES


def test_issuer(spark):
    cases = {
        "C=US, O=Let's Encrypt, CN=R3": "Let's Encrypt",
        "CN = Some CA": "Some CA",
        "O = Acme , C=US": "Acme",
        "OU=x, C=US": None,
    }
    assert dict(zip(cases, column(spark, list(cases), values.issuer_organization))) == cases


def test_asn(spark):
    cases = {"AS13335": "AS13335", " as 13335 ": "AS13335", "13335": "AS13335", "none": "", "": ""}
    assert dict(zip(cases, column(spark, list(cases), values.asn))) == cases


def test_entity_ids_split_at_the_first_colon(spark):
    ids = ["url:https://x.com/a:b", "plain"]
    assert column(spark, ids, values.id_value) == ["https://x.com/a:b", "plain"]


def test_redaction(spark):
    cases = {
        "api_key=abc123 more text": "api_key=[REDACTED] text",
        "Password: hunter2": "Password=[REDACTED]",
        "see /home/me/file.txt": "see [path]",
        r"see C:\Users\me": "see [path]",
        "host 10.1.2.3:80 down": "host [internal] down",
        "postgresql://u:p@h/db failed": "[db] failed",
    }
    assert dict(zip(cases, column(spark, list(cases), values.redacted))) == cases
    assert column(spark, ["x" * 600, None], lambda c: values.redacted(c, 500)) == ["x" * 500 + "...", ""]


def test_comparison_keys(spark):
    df = spark.createDataFrame(
        [("Organization", "Acme, Inc"), ("Organization", "Foo Company"), ("Username", "a.b-c_d"), ("Email", "Me@x.org")],
        "type string, value string",
    )
    rows = df.select(values.comparison_key(F.col("type"), F.col("value")).alias("k")).collect()
    assert [r.k for r in rows] == ["acme", "foo", "abcd", "me"]


@pytest.mark.parametrize("status, state", [(200, "available"), (301, "redirected"), (303, "unknown"), (404, "not_found"),
                                           (429, "rate_limited"), (503, "temporarily_unavailable")])
def test_availability(spark, status, state):
    assert column(spark, [status], values.availability, "int") == [state]
