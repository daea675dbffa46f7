"""Stored web pages and search hits: metadata, filters, profile evidence, deduplication, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed, values
from linkloom.operators.ordering import first_rows, numbered

MIN_PAGE_LENGTH = 500
LONG_PAGE_LENGTH = 10000


def page_metadata(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``title`` and ``content_length``."""
    return pages.withColumn("title", values.page_title(F.col(html_col))).withColumn(
        "content_length", F.length(html_col)
    )


def filter_parked(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Pages that are longer than 500 characters and carry no phrase of a parked domain."""
    body = F.lower(html_col)
    return pages.where((F.length(body) > MIN_PAGE_LENGTH) & ~body.rlike(values.alternation(fixed.PARKED_PHRASES)))


def classify_pages(pages: DataFrame, platforms: DataFrame) -> DataFrame:
    """Whether a stored page shows a profile, by the rules of its platform.

    ``pages``: platform_key, url, status_code, html and any other columns. ``platforms``: key, fail_codes,
    fail_body, ok_codes, must_have, must_not (arrays). Rules apply in that order.
    """
    none = F.array().cast("array<string>")
    rules = platforms.select(
        F.col("key").alias("platform_key"),
        F.coalesce("fail_codes", F.array().cast("array<int>")).alias("_fail_codes"),
        *[
            F.transform(F.coalesce(c, none), lambda t: F.lower(t)).alias(f"_{c}")
            for c in ("fail_body", "must_have", "must_not")
        ],
        F.coalesce("ok_codes", F.array(F.lit(200))).alias("_ok_codes"),
    )
    rows = pages.join(rules, "platform_key").withColumn("_body", F.lower("html"))
    body, status = F.col("_body"), F.col("status_code")
    missing = F.try_element_at(F.filter("_must_have", lambda t: ~F.contains(body, t)), F.lit(1))
    negative = F.try_element_at(F.filter("_must_not", lambda t: F.contains(body, t)), F.lit(1))
    failed = F.array_contains("_fail_codes", status) | F.exists("_fail_body", lambda t: F.contains(body, t))
    refused = failed | ~F.array_contains("_ok_codes", status)
    positive = F.least(
        F.lit(0.95),
        F.lit(0.7)
        + F.when(status == 200, 0.1).otherwise(0.0)
        + F.when(F.length(body) > LONG_PAGE_LENGTH, 0.05).otherwise(0.0)
        + F.when(F.size("_must_not") > 0, 0.05).otherwise(0.0),
    )
    judged = (
        rows.withColumn("_refused", refused)
        .withColumn("_missing", F.when(~F.col("_refused"), missing))
        .withColumn("_negative", F.when(~F.col("_refused") & F.col("_missing").isNull(), negative))
    )
    near = F.col("_missing").isNotNull() | F.col("_negative").isNotNull()
    return judged.select(
        *[F.col(c) for c in pages.columns if c != "html"],
        (~F.col("_refused") & ~near).alias("found"),
        F.when(F.col("_refused"), 0.0).when(near, 0.3).otherwise(positive).alias("confidence"),
        F.coalesce(
            F.concat(F.lit("body missing required term: "), F.col("_missing")),
            F.concat(F.lit("body contains negative term: "), F.col("_negative")),
        ).alias("reason"),
        values.evidence_tier(F.lit("direct_http")).alias("evidence_confidence"),
    )


def _profile_rule(position: str) -> Column:
    """A field of the profile rules by platform; the rules are constants."""
    pairs = []
    for rule in fixed.PROFILE_RULES:
        pairs.append(F.lit(rule["platform_key"]))
        if position == "patterns":
            pairs.append(F.lit("(?i)(?:" + "|".join(rule["patterns"]) + ")"))
        elif position == "negatives":
            pairs.append(F.lit("(?:" + values.alternation(rule["negatives"]) + ")"))
        else:
            pairs.append(F.lit(rule["base_confidence"]))
    return F.try_element_at(F.create_map(*pairs), F.col("platform_key"))


def match_profiles(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles found by stored search hits (platform_key, username, url, title, snippet, rank and the key columns).

    A hit counts when no negative phrase occurs in it, its URL looks like a profile of the platform and a path
    segment is the user name.
    """
    user = F.lower("username")
    snippet = F.lower(F.coalesce("snippet", F.lit("")))
    text = F.concat_ws(" ", F.lower(F.coalesce("title", F.lit(""))), snippet)
    path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#;]*)", 1)
    segments = F.transform(F.split(path, "/"), lambda s: F.ltrim(F.lower(s), F.lit("@")))
    group = [*keys, "platform_key", "username"]
    good = hits.where(
        ~F.regexp(text, _profile_rule("negatives"))
        & F.regexp(F.col("url"), _profile_rule("patterns"))
        & F.array_contains(segments, user)
    )
    found = good.groupBy(*group).agg(
        F.count("*").alias("matches"),
        F.max(F.contains(snippet, user)).alias("_named"),
        F.min_by("url", F.struct("rank", "url")).alias("best_url"),
    )
    base = _profile_rule("base_confidence")
    several = F.when(F.col("matches") > 1, F.least(base + 0.05, F.lit(0.65))).otherwise(base)
    named = F.when(F.col("_named"), F.least(several + 0.03, F.lit(0.65))).otherwise(several)
    return found.select(
        *group, "best_url", "matches", named.alias("confidence"),
        values.evidence_tier(F.lit("search_discovery")).alias("evidence_confidence"),
    )


# --- search hits -------------------------------------------------------------------------------------------------


def normalize_hits(raw: DataFrame, payload_col: str = "payload", max_results: int | None = None) -> DataFrame:
    """Provider payloads as uniform hits; the rank counts usable results from 0."""
    items = F.from_json(
        payload_col, "results ARRAY<STRUCT<title STRING, url STRING, content STRING, engine STRING>>"
    )["results"]
    if max_results is not None:
        items = F.slice(items, 1, max_results)
    usable = F.filter(items, lambda i: i.isNotNull() & (F.coalesce(i["url"], F.lit("")) != ""))
    keys = [c for c in raw.columns if c != payload_col]
    rows = raw.select(*keys, F.posexplode(usable).alias("rank", "_i"))
    return rows.select(
        *keys,
        F.coalesce("_i.title", F.lit("")).alias("title"),
        F.col("_i.url").alias("url"),
        F.coalesce("_i.content", F.lit("")).alias("snippet"),
        F.coalesce("_i.engine", F.lit("unknown")).alias("engine"),
        "rank",
    )


def _url_key(url: Column) -> Column:
    return F.rtrim(F.lower(url), F.lit("/"))


def dedupe_hits(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first hit per URL (case and final slashes ignored); hits without a URL are dropped."""
    rows = hits.withColumn("_url", _url_key(F.col("url"))).where(F.col("_url") != "")
    return first_rows(rows, [*keys, "_url"], [F.col(o) for o in order]).drop("_url")


# Fixed value: the phases in which findings arrive.
FINDING_PHASES = ["search", "domain", "platform"]


def dedupe_findings(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest finding per URL; search comes before domain and platform findings."""
    phase = F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(p) for p in FINDING_PHASES]), F.col("phase")), F.lit(0)), F.lit(99)
    )
    rows = findings.withColumn("_phase", phase)
    return dedupe_hits(rows, keys, ["_phase", "rank", "url"]).drop("_phase")


def interleave_hits(hits: DataFrame, keys: list[str], provider_order: list[str]) -> DataFrame:
    """Adds ``position``: first hit of each provider, then the second of each, and so on; unknown providers go last."""
    order = F.array(*[F.lit(p) for p in provider_order])
    place = F.array_position(order, F.col("provider"))
    placed = hits.withColumn("_provider", F.when(place > 0, place - 1).otherwise(len(provider_order)))
    turns = numbered(placed, [*keys, "provider"], ["rank", "url"], "_turn")
    unknown = F.col("_provider") == len(provider_order)
    lined = turns.withColumn("_late", unknown.cast("int"))
    return numbered(lined, keys, ["_late", "_turn", "_provider", "provider", "rank", "url"], "position").drop(
        "_provider", "_turn", "_late"
    )


def hit_stats(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Raw, distinct and duplicate hit counts."""
    url = F.nullif(_url_key(F.col("url")), F.lit(""))
    return hits.groupBy(*keys).agg(
        F.count("*").alias("total_raw_results"),
        F.count_distinct(url).alias("distinct_results"),
        (F.count("*") - F.count_distinct(url)).alias("deduplicated_count"),
    )


def provider_stats(hits: DataFrame, statuses: DataFrame, keys: list[str]) -> DataFrame:
    """Status and number of hits per provider, also for providers without hits."""
    counts = hits.groupBy(*keys, "provider").agg(F.count("*").alias("hits"))
    return statuses.join(counts, [*keys, "provider"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
