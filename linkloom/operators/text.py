"""Entities in free text and in search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed, values
from linkloom.functions.once import built_once

TEXT_CONFIDENCE = 0.85


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})" if group == 0 else pattern), F.lit(1))


def _guarded(found: Column, condition: Column) -> Column:
    """Runs a scan only on texts that can hold a match."""
    return F.when(condition, found).otherwise(F.array().cast("array<string>"))


def text_candidates(text: Column, exclude_email_domains: bool = False) -> Column:
    """Distinct (type, standardized value) pairs found in a text, as an array."""
    edge, start, end = values.WORD_EDGE, values.WORD_START, values.WORD_END
    ipv4 = _guarded(_all(text, start + fixed.IPV4_TEXT + end), text.rlike(r"\d\.\d"))
    ipv6 = _guarded(_all(text, fixed.IPV6_TEXT), text.contains(":") & text.rlike(r"::|(?:[0-9a-fA-F]{1,4}:){7}"))
    email = _guarded(_all(text, edge + fixed.EMAIL_TEXT + end), text.contains("@"))
    asn = _guarded(_all(text, "(?i)" + start + fixed.ASN_TEXT + end, 1), text.rlike(r"(?i)AS\d"))
    url = _guarded(_all(text, "(?i)" + fixed.URL_TEXT), text.contains("://"))
    domain = _guarded(_all(text, start + fixed.DOMAIN_TEXT + end), text.rlike(r"[a-zA-Z0-9]\.[a-zA-Z]"))
    if exclude_email_domains:
        hosts = F.transform(email, lambda e: F.substring_index(e, "@", -1))
        domain = F.array_except(domain, hosts)
    else:
        # Only the word behind the last '@' is known to be the domain of an address.
        last = F.split(values.trimmed(F.substring_index(text, "@", -1)), r"\s+")[0]
        domain = F.when(text.contains("@"), F.array_except(domain, F.array(last))).otherwise(domain)

    def typed(kind: str, found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    # Matches are few, so each is brought into standard form here and repeats end inside the row.
    return F.array_distinct(
        F.concat(
            typed("IP", ipv4),
            typed("IP", F.transform(F.array_distinct(ipv6), values.ipv6)),
            typed("Email", F.transform(email, values.email)),
            typed("ASN", F.transform(asn, lambda n: F.concat(F.lit("AS"), n))),
            typed("URL", F.transform(F.array_distinct(url), values.url)),
            typed("Domain", F.filter(F.transform(domain, F.lower), lambda d: d.rlike(fixed.DOMAIN_VALID))),
        )
    )


@built_once
def _candidates_in(col: str, exclude_email_domains: bool) -> Column:
    return text_candidates(F.col(col), exclude_email_domains)


def extract_from_text(
    df: DataFrame, text_col: str, id_cols: list[str], exclude_email_domains: bool = False
) -> DataFrame:
    """One row per text and entity: the id columns, ``id``, ``type``, ``value``, ``confidence``.

    One narrow pass without a shuffle: whatever repeats inside a text is removed before its rows leave the task.
    """
    found = df.select(*id_cols, F.inline(_candidates_in(text_col, exclude_email_domains)))
    return found.select(
        *id_cols,
        values.entity_id(F.col("type"), F.col("value")).alias("id"),
        "type",
        "value",
        F.lit(TEXT_CONFIDENCE).alias("confidence"),
    )


def text_mentions(
    df: DataFrame, text_col: str, investigation: Column, observation: Column, source: Column, seen_at: Column
) -> DataFrame:
    """Free text in the mention schema."""
    shaped = df.select(
        investigation.alias("investigation_id"),
        observation.alias("observation_id"),
        source.alias("source"),
        seen_at.alias("seen_at"),
        F.col(text_col).alias("_text"),
    )
    rows = extract_from_text(shaped, "_text", ["investigation_id", "observation_id", "source", "seen_at"])
    return rows.withColumn("properties", F.create_map().cast("map<string,string>"))


def extract_search_hits(
    hits: DataFrame, title_col: str = "title", snippet_col: str = "snippet", url_col: str = "url"
) -> DataFrame:
    """Adds sorted distinct ``domains``, ``emails``, ``urls`` and ``ips`` found in title, snippet and URL of a hit."""
    empty = F.lit("")
    text = F.concat_ws(
        " ", F.coalesce(title_col, empty), F.coalesce(snippet_col, empty), F.coalesce(url_col, empty)
    )
    edge, start, end = values.WORD_EDGE, values.WORD_START, values.WORD_END
    asset = values.alternation(fixed.ASSET_EXTENSIONS)
    with_text = hits.withColumn("_text", text)
    scan = F.col("_text")
    domains = F.transform(_all(scan, start + fixed.DOMAIN_TEXT + end), lambda d: F.lower(d))
    found = {
        "domains": F.filter(domains, lambda d: ~d.rlike(f"(?:{asset})$")),
        "emails": F.transform(_all(scan, edge + fixed.HIT_EMAIL_TEXT + edge), lambda e: F.lower(e)),
        "urls": _all(scan, fixed.URL_TEXT),
        "ips": _all(scan, start + fixed.HIT_IPV4_TEXT + end),
    }
    return with_text.withColumns({k: F.array_sort(F.array_distinct(v)) for k, v in found.items()}).drop("_text")
