"""Jobs that bring raw target strings, timestamps, texts and URLs into standard form."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed, values


def classify_targets(df: DataFrame, col: str = "target", strict: bool = True) -> DataFrame:
    """Adds ``target_type``. ``strict=False`` also accepts text that only starts like an IPv6 address."""
    return df.withColumn("target_type", values.target_type(F.col(col), strict))


def standardize_targets(df: DataFrame, col: str = "target") -> DataFrame:
    """Adds ``target_type``, ``normalized_value`` and, for addresses, ``ip_version``."""
    typed = classify_targets(df, col)
    return typed.withColumn(
        "normalized_value", values.standard_target(F.col(col), F.col("target_type"))
    ).withColumn("ip_version", values.ip_version(F.col("normalized_value")))


def distinct_targets(df: DataFrame, col: str = "target") -> DataFrame:
    """One row per standardized target."""
    return (
        standardize_targets(df, col)
        .where(F.col("normalized_value") != "")
        .select("target_type", "normalized_value", "ip_version")
        .distinct()
    )


def standardize_timestamps(df: DataFrame, col: str, out: str = "parsed_at") -> DataFrame:
    return df.withColumn(out, values.timestamp(F.col(col)))


def _is_internal(value):
    number = values.ipv4_number(value)
    internal = F.lit(False)
    # Five fixed ranges: comparisons in the scan beat a join.
    for block in fixed.INTERNAL_IPV4:
        network = ipaddress.ip_network(block)
        internal = internal | number.between(int(network.network_address), int(network.broadcast_address))
    address6 = F.when(values.is_ipv6(value), values.ipv6(value))
    named = F.lower(value).isin(fixed.INTERNAL_HOSTS)
    return F.coalesce(internal, F.lit(False)) | F.coalesce(address6.rlike(fixed.INTERNAL_IPV6), F.lit(False)) | named


def flag_internal(df: DataFrame, col: str, out: str = "is_internal") -> DataFrame:
    """Marks addresses in private, loopback, link-local and unique-local ranges, and internal host names."""
    return df.withColumn(out, F.coalesce(_is_internal(F.col(col)), F.lit(False)))


def validate_targets(df: DataFrame, col: str = "target", type_col: str = "target_type") -> DataFrame:
    """Adds ``cleaned`` and ``reject_reason`` (null for a target that may be used)."""
    raw, kind = F.col(col), F.col(type_col)
    cleaned = F.regexp_replace(raw, fixed.CONTROL_CHARACTERS, "")
    with_clean = df.withColumn("cleaned", cleaned)
    clean = F.col("cleaned")
    host = values.url_host(clean)
    netloc = F.regexp_extract(clean, r"^[^:/]*://([^/?#]*)", 1)
    is_url = kind == "url"
    reason = (
        F.when(raw.isNull() | (values.trimmed(raw) == ""), "empty")
        .when(_is_internal(clean), "internal")
        .when(is_url & ~F.lower(clean).rlike(r"^https?:"), "scheme")
        .when(is_url & netloc.rlike(r"^(?:[^@:]+(?::[^@]*)?|:[^@]+)@"), "credentials")
        .when(is_url & (host == ""), "no_host")
        .when(is_url & _is_internal(host), "internal")
        .when(kind.isin("domain", "ip") & ~clean.rlike(r"^[a-zA-Z0-9.\-:/\[\]]+$"), "characters")
    )
    return with_clean.withColumn("reject_reason", reason)


def redact_text(df: DataFrame, col: str, max_len: int | None = None, out: str | None = None) -> DataFrame:
    """Redacts secrets, paths, internal addresses and connection strings. ``max_len`` cuts longer texts."""
    return df.withColumn(out or col, values.redacted(F.col(col), max_len))


def availability_states(df: DataFrame, col: str, out: str = "availability") -> DataFrame:
    return df.withColumn(out, values.availability(F.col(col)))


def source_urls(ents: DataFrame) -> DataFrame:
    """Adds ``source_url`` from the stored properties only."""
    profile, url = F.col("properties")["profile_url"], F.col("properties")["url"]
    return ents.withColumn(
        "source_url",
        F.coalesce(F.when(profile.startswith("http"), profile), F.when(url.startswith("http"), url)),
    )


def display_urls(ents: DataFrame) -> DataFrame:
    """Adds ``display_url``: stored links first, else one built from type, value and sources."""
    profile, url = F.col("properties")["profile_url"], F.col("properties")["url"]
    value, kind = F.col("value"), F.col("type")
    sources = F.transform(F.col("sources"), lambda s: F.lower(s))

    def by_source(bases: dict[str, str]):
        links = [
            F.when(F.array_contains(sources, name), F.concat(F.lit(base), value)) for name, base in bases.items()
        ]
        return F.coalesce(*links)

    # Where a source shows an account or a repository.
    accounts = {
        "github": "https://github.com/",
        "gitlab": "https://gitlab.com/",
        "reddit": "https://www.reddit.com/user/",
        "hackernews": "https://news.ycombinator.com/user?id=",
        "keybase": "https://keybase.io/",
    }
    repositories = {"github": "https://github.com/", "gitlab": "https://gitlab.com/"}
    with_scheme = F.when(value.startswith("http"), value).otherwise(F.concat(F.lit("https://"), value))
    built = (
        F.when(kind == "URL", with_scheme)
        .when(kind.isin("Domain", "Subdomain") & ~value.rlike(r"\s"), with_scheme)
        .when(kind == "Username", by_source(accounts))
        .when(kind == "Repository", by_source(repositories))
    )
    return ents.withColumn(
        "display_url",
        F.coalesce(F.when(profile != "", profile), F.when(url.startswith("http"), url), built),
    )


def safe_json(df: DataFrame, col: str, out: str = "parsed") -> DataFrame:
    """Adds a variant: valid JSON as it is, other text under ``_raw``, null as an empty object."""
    text = F.col(col)
    wrapped = F.to_json(F.struct(text.alias("_raw")))
    return df.withColumn(
        out,
        F.coalesce(
            F.try_parse_json(text),
            F.when(text.isNull(), F.parse_json(F.lit("{}"))).otherwise(F.parse_json(wrapped)),
        ),
    )


def tag_platform(df: DataFrame, url_col: str = "url", hosts: DataFrame | None = None) -> DataFrame:
    """Adds ``platform`` for URLs on known hosts, with or without 'www.'.

    The built-in host list is a constant of some sixty entries and becomes a map in the projection; a host table
    of the caller's own is joined, and Spark picks the strategy by its size.
    """
    host = values.url_host(F.col(url_col))
    if hosts is None:
        pairs = [F.lit(x) for pair in fixed.PLATFORM_HOSTS.items() for x in pair]
        known = F.create_map(*pairs)
        return df.withColumn(
            "platform",
            F.coalesce(F.try_element_at(known, host), F.try_element_at(known, F.regexp_replace(host, r"^www\.", ""))),
        )
    named = hosts.select(F.col("host").alias("_host"), F.col("platform"))
    both = named.union(named.select(F.concat(F.lit("www."), "_host"), "platform"))
    first = both.groupBy("_host").agg(F.min("platform").alias("platform"))
    return df.withColumn("_host", host).join(first, "_host", "left").drop("_host")
