"""Linking accounts by shared attributes, and accounts and domains by variants of a handle."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed, values
from linkloom.operators.resolve import member_pairs
from linkloom.session import cut_lineage

PROFILE = (
    "found BOOLEAN, profile STRUCT<name STRING, username STRING, full_name STRING, display_name STRING, "
    "real_name STRING, bio_name STRING, email STRING, public_email STRING, description STRING, bio STRING, "
    "about STRING, organization STRING, website_url STRING, website STRING, location STRING, profile_url STRING>"
)
_EQUAL = ["email", "full_name", "organization", "website", "location"]


def _first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def accounts(obs: DataFrame) -> DataFrame:
    """Accounts in profile observations; fields that sources name differently are brought together."""
    rows = obs.withColumn("_p", F.from_json("raw_response", PROFILE)).where(
        F.col("_p.profile").isNotNull() & F.coalesce("_p.found", F.lit(False))
    )
    fields = profile_fields(F.col("_p.profile"))
    return rows.select(
        "investigation_id",
        F.col("id").alias("observation_id"),
        F.col("source_adapter").alias("platform"),
        *[field.alias(name) for name, field in fields.items()],
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
    )


def profile_fields(p: Column) -> dict[str, Column]:
    """The fields of an account, from a parsed profile and the column ``target``; missing ones are empty."""
    return {
        "username": _first_filled(p["name"], p["username"], F.col("target")),
        "full_name": _first_filled(p["full_name"], p["name"]),
        "email": _first_filled(p["email"], p["public_email"]),
        "bio": _first_filled(p["description"], p["bio"], p["about"]),
        "organization": _first_filled(p["organization"]),
        "website": _first_filled(p["website_url"], p["website"]),
        "location": _first_filled(p["location"]),
        "profile_url": _first_filled(p["profile_url"]),
    }


def _plain(value: Column) -> Column:
    return F.lower(values.trimmed(value))


def bio_keywords(bio: Column) -> Column:
    """Distinct words of more than three characters, without punctuation around them."""
    words = F.transform(F.split(values.trimmed(bio), r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(".,;:!?()\"'-"))))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))


def _shared_weight() -> Column:
    """Sum of the weights of attributes that two accounts share, over columns a_* and b_*."""
    weight = F.lit(0.0)
    for name in _EQUAL:
        a, b = F.col(f"a_{name}"), F.col(f"b_{name}")
        weight = weight + F.when((a != "") & (a == b), fixed.ACCOUNT_WEIGHTS[name]).otherwise(0.0)
    common = F.size(F.array_intersect("a_words", "b_words"))
    fewer = F.least(F.size("a_words"), F.size("b_words"))
    alike = (fewer > 0) & ((common >= 2) | (common / F.nullif(fewer, F.lit(0)) >= 0.3))
    return weight + F.when(alike, fixed.ACCOUNT_WEIGHTS["bio_keywords"]).otherwise(0.0)


# Every pair that reaches the threshold shares the whole key of at least one of these rules: the attribute weights
# and the largest platform bonus leave no other combination, see tests/test_accounts.py.
_RULES = [
    ["email"],
    ["full_name", "organization"],
    ["full_name", "website"],
    ["full_name", "location"],
    ["organization", "website"],
    ["organization", "location"],
    ["website", "location"],
]


#: Accounts of a user name up to which its profiles are compared where they are gathered, each with each.
FEW_ACCOUNTS = 20


def _met_at_home(profiles: DataFrame) -> DataFrame:
    """All pairs of profiles (a, b) of the user names that have few accounts, made from one row per user name."""
    gathered = profiles.groupBy("investigation_id", "handle").agg(F.collect_list("profile").alias("_all"))
    pairs = F.flatten(
        F.transform(
            "_all",
            lambda a, i: F.transform(
                F.slice("_all", i + 2, F.size("_all")), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    return gathered.select("investigation_id", "handle", F.inline(pairs))


def _met_by_key(profiles: DataFrame) -> DataFrame:
    """Pairs of profiles (a, b) of a user name that share the whole key of a rule; each pair once, at the first such rule.

    Even a key that most profiles of a busy user name share is compared in blocks by many tasks.
    """
    inv = "investigation_id"
    keys = F.array_compact(
        F.array(
            *[
                F.when(
                    F.forall(F.array(*[F.col("profile")[c] for c in rule]), lambda v: v != ""),
                    F.struct(F.lit(i).alias("rule"), F.concat_ws("\x1f", *[F.col("profile")[c] for c in rule]).alias("key")),
                )
                for i, rule in enumerate(_RULES)
            ]
        )
    )
    keyed = profiles.select(inv, "handle", "profile", F.inline(keys))
    met = member_pairs(keyed, [inv, "handle", "rule", "key"], "profile")

    def shared(name: str) -> Column:
        return (F.col("id_a")[name] != "") & (F.col("id_a")[name] == F.col("id_b")[name])

    first = F.coalesce(*[F.when(reduce(and_, map(shared, rule)), F.lit(i)) for i, rule in enumerate(_RULES)])
    return met.where(F.col("rule") == first).select(inv, "handle", F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def account_links(accts: DataFrame) -> DataFrame:
    """same_person links between accounts of one user name whose shared attributes weigh enough, one row per account
    that supports a link between two platforms.

    Accounts with the same attributes on the same platform count as one profile, so copies do not multiply. Profiles of a
    busy user name are compared only when they share attributes that can carry a pair over the threshold; nothing that
    reaches it is missed.
    """
    inv = "investigation_id"
    named = accts.withColumn("handle", _plain(F.col("username")))
    sizes = named.groupBy(inv, "handle").agg(F.count("*").alias("group_size"))
    clean = named.select(
        inv, "handle", "platform", "observation_id",
        *[_plain(F.col(c)).alias(c) for c in _EQUAL],
        F.array_sort(bio_keywords(F.col("bio"))).alias("words"),
    )
    profiles = (
        clean.groupBy(inv, "handle", "platform", *_EQUAL, "words")
        .agg(F.count("*").alias("copies"), F.min("observation_id").alias("observation_id"))
        .join(sizes.where(F.col("group_size") > 1), [inv, "handle"])
    )
    # Pairs hold whole profiles, which are not looked up again.
    profile = ["platform", "observation_id", "words", "group_size", *_EQUAL]
    profiles = cut_lineage(profiles.select(inv, "handle", "copies", F.struct(*profile).alias("profile")))
    few = F.col("profile.group_size") <= FEW_ACCOUNTS
    twins = profiles.where(F.col("copies") > 1).select(
        inv, "handle", F.col("profile").alias("a"), F.col("profile").alias("b")
    )
    pairs = _met_at_home(profiles.where(few)).unionByName(_met_by_key(profiles.where(~few))).unionByName(twins)
    both = pairs.select(inv, "handle", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in profile])
    total = round(sum(fixed.ACCOUNT_WEIGHTS.values()), 10)
    weight = _shared_weight()
    score = F.least(
        F.lit(1.0), F.col("weight") / total + F.least(F.lit(0.1), F.col("a_group_size") * 0.02)
    )
    scored = (
        both.withColumn("weight", weight)
        .where(F.col("weight") > 0)
        .withColumn("confidence", F.round(score, 3))
        .where(F.col("confidence") >= fixed.MIN_ACCOUNT_SCORE)
        .withColumn("platform_a", F.least("a_platform", "b_platform"))
        .withColumn("platform_b", F.greatest("a_platform", "b_platform"))
    )
    evidence = scored.select(
        inv, "handle", "platform_a", "platform_b", "confidence",
        F.explode(F.array("a_observation_id", "b_observation_id")).alias("_e"),
    )
    user = values.entity_id(F.lit("Username"), F.col("handle"))
    return evidence.select(
        inv,
        F.concat_ws(":", F.lit("cross_platform"), "platform_a", "platform_b", "handle").alias("id"),
        "handle",
        "platform_a",
        "platform_b",
        F.concat_ws("@", user, "platform_a").alias("source_id"),
        F.concat_ws("@", user, "platform_b").alias("target_id"),
        F.lit("same_person").alias("relationship_type"),
        "confidence",
        F.col("_e").alias("observation_id"),
    )


def link_accounts(accts: DataFrame) -> DataFrame:
    """One edge per user name and pair of platforms; its evidence is counted, the best score wins."""
    edge = ["investigation_id", "id", "handle", "platform_a", "platform_b", "source_id", "target_id", "relationship_type"]
    return account_links(accts).groupBy(*edge).agg(
        F.max("confidence").alias("confidence"),
        F.min("observation_id").alias("observation_id"),
        F.count_distinct("observation_id").alias("evidence_count"),
    )


def account_entities(accts: DataFrame, seen_at: Column) -> tuple[DataFrame, DataFrame]:
    """Mentions and edges that linked accounts add: user names, people, emails, organizations.

    People, emails and organizations are taken from user names found on more than one account only.
    """
    inv = "investigation_id"
    named = accts.withColumn("handle", _plain(F.col("username")))
    sizes = named.groupBy(inv, "handle").agg(F.count("*").alias("_n"))
    rows = named.join(sizes, [inv, "handle"])
    many = F.col("_n") > 1
    # A user name seen once keeps its spelling.
    user = F.when(many, F.col("handle")).otherwise(F.col("username"))
    user_id = values.entity_id(F.lit("Username"), user)
    person_id = values.entity_id(F.lit("Person"), _plain(F.col("full_name")))
    mail = values.email(F.col("email"))
    mail_id = values.entity_id(F.lit("Email"), mail)
    org_id = values.entity_id(F.lit("Organization"), _plain(F.col("organization")))

    def item(entity: Column, kind: str, value: Column, trust: Column) -> Column:
        return F.struct(entity.alias("id"), F.lit(kind).alias("type"), value.alias("value"), trust.alias("confidence"))

    def filled(name: str) -> Column:
        return many & (F.col(name) != "")

    items = F.array_compact(
        F.array(
            item(user_id, "Username", user, F.col("confidence")),
            F.when(filled("full_name"), item(person_id, "Person", F.col("full_name"), F.lit(0.7))),
            F.when(filled("email"), item(mail_id, "Email", mail, F.lit(0.8))),
            F.when(filled("organization"), item(org_id, "Organization", F.col("organization"), F.lit(0.7))),
        )
    )
    mentions = rows.select(
        inv, "observation_id", F.col("platform").alias("source"), seen_at.alias("seen_at"), F.inline(items)
    ).withColumn("properties", F.create_map().cast("map<string,string>"))

    def edge(name: str, target: Column, key: Column, rel: str, trust: float) -> Column:
        return F.struct(
            F.concat_ws(":", F.lit(name), "handle", key).alias("id"),
            user_id.alias("source_id"),
            target.alias("target_id"),
            F.lit(rel).alias("relationship_type"),
            F.lit(trust).alias("confidence"),
            F.lit("").alias("method"),
        )

    links = F.array_compact(
        F.array(
            F.when(
                filled("full_name"),
                edge("username_person", person_id, _plain(F.col("full_name")), "same_person", 0.8),
            ),
            F.when(filled("email"), edge("username_email", mail_id, mail, "has_email", 0.85)),
        )
    )
    edges = rows.select(inv, "observation_id", seen_at.alias("seen_at"), F.inline(links))
    return mentions, edges


def real_names(obs: DataFrame) -> DataFrame:
    """Distinct full names in profiles: the first of the name fields that holds a space."""
    p = F.from_json("raw_response", PROFILE)["profile"]
    fields = ["full_name", "name", "display_name", "real_name", "bio_name"]
    rows = obs.withColumn("_p", p)
    texts = [values.trimmed(F.col(f"_p.{f}")) for f in fields]
    name = F.coalesce(*[F.when((F.length(t) >= 2) & t.contains(" "), t) for t in texts])
    return rows.select("investigation_id", name.alias("real_name")).where(F.col("real_name").isNotNull()).distinct()


# --- handle variants ---------------------------------------------------------------------------------------------


def _split(handle: Column) -> Column:
    return F.filter(F.split(handle, r"[._\-\s]+"), lambda p: p != "")


def _leet(word: Column) -> Column:
    """All spellings with one, then with two letters as digits."""
    table = F.create_map(*[F.lit(x) for pair in fixed.LEET_DIGITS.items() for x in pair])
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))),
        lambda i: F.try_element_at(table, F.substring(word, i, F.lit(1))).isNotNull(),
    )

    def put(text: Column, place: Column) -> Column:
        return F.overlay(text, F.try_element_at(table, F.substring(word, place, F.lit(1))), place, F.lit(1))

    single = F.transform(places, lambda i: put(word, i))
    double = F.flatten(
        F.transform(
            places,
            lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: put(put(word, i), j)),
        )
    )
    return F.array_distinct(F.concat(single, double))


def handle_variants(handle: Column) -> Column:
    """The handle itself, then all its likely variants in order of preference; their number is bounded by its length."""
    base = F.lower(handle)
    camel = F.filter(F.split(F.regexp_replace(handle, "([a-z])([A-Z])", "$1 $2"), r"\s+"), lambda p: p != "")
    parts = F.array_distinct(F.concat(_split(handle), camel))
    joined = F.array_join(parts, "")
    one = F.concat(
        F.array(*[F.concat(F.lit(p), base) for p in fixed.HANDLE_PREFIXES]),
        F.array(*[F.concat(base, F.lit(s)) for s in fixed.HANDLE_SUFFIXES]),
        _leet(base),
    )
    shorter = F.when(
        F.size(parts) > 2,
        F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(parts) - 1),
                lambda k: F.array(
                    *[F.array_join(F.filter(parts, lambda p, i: i != k), s) for s in fixed.HANDLE_SEPARATORS[:2]]
                ),
            )
        ),
    ).otherwise(F.array().cast("array<string>"))
    many = F.concat(
        F.array(*[F.array_join(parts, s) for s in fixed.HANDLE_SEPARATORS]),
        shorter,
        F.array(*[F.concat(F.lit(p), joined) for p in fixed.HANDLE_PREFIXES]),
        F.array(*[F.concat(joined, F.lit(s)) for s in fixed.HANDLE_SUFFIXES]),
    )
    variants = F.when(F.size(parts) < 2, one).otherwise(many)
    other = F.array_distinct(F.filter(variants, lambda v: (v != base) & (v != "")))
    return F.concat(F.array(base), other)


def probe_variants(handle: Column) -> Column:
    """Fewer, safer variants: separators, reversed parts, a number behind the joined parts."""
    base = F.lower(values.trimmed(handle))
    parts = _split(base)
    joined = F.array_join(parts, "")
    turned = F.reverse(parts)
    many = F.concat(
        F.array(*[F.array_join(parts, s) for s in fixed.HANDLE_SEPARATORS]),
        F.array(F.array_join(turned, ""), F.array_join(turned, ".")),
        F.array(F.concat(joined, F.lit("0")), F.concat(joined, F.lit("1"))),
    )
    one = F.array(*[F.concat(base, F.lit(s)) for s in ("0", "1", "dev")])
    other = F.array_distinct(F.filter(F.when(F.size(parts) >= 2, many).otherwise(one), lambda v: v != base))
    return F.concat(F.array(base), other)


def candidate_handles(
    owners: DataFrame, known: DataFrame, col: str = "username", probe: bool = False
) -> DataFrame:
    """Known handles that are a variant of an owner's handle: ``username``, ``matched``, ``rank`` (0 = the handle itself)."""
    build = probe_variants if probe else handle_variants
    handles = owners.select(F.col(col).alias("username")).where(values.trimmed(F.col(col)) != "").distinct()
    variants = handles.select("username", F.posexplode(build(F.col("username"))).alias("rank", "_v"))
    best = variants.withColumn("_v", F.lower("_v")).groupBy("username", "_v").agg(F.min("rank").alias("rank"))
    have = known.select(F.col(col).alias("matched"), F.lower(col).alias("_v")).distinct()
    return best.join(have, "_v").select("username", "matched", "rank")


def personal_domains(handle: Column) -> Column:
    """Domains a person with this handle might own, in order of preference."""
    lower = F.lower(handle)
    parts = F.split(handle, r"[._\-\s]+")
    clean = F.regexp_replace(lower, "[^a-z0-9]", "")
    first = F.regexp_replace(F.lower(parts[0]), "[^a-z]", "")
    last = F.regexp_replace(F.lower(F.element_at(parts, -1)), "[^a-z]", "")
    named = (F.size(parts) >= 2) & (first != "") & (last != "")
    stems = F.when(
        named,
        F.array(
            F.concat(first, last),
            F.concat(first, F.lit("-"), last),
            F.concat(last, first),
            F.concat(last, F.lit("-"), first),
            F.concat(F.substring(first, 1, 1), last),
            F.concat(first, F.substring(last, 1, 1)),
            clean,
        ),
    ).otherwise(F.array(clean))
    endings = F.array(*[F.lit(t) for t in fixed.PERSONAL_TLDS])
    wide = F.flatten(F.transform(stems, lambda s: F.transform(endings, lambda t: F.concat(s, t))))
    more = F.transform(handle_variants(handle), lambda v: F.regexp_replace(F.lower(v), "[^a-z0-9]", ""))
    extra = F.flatten(
        F.transform(
            F.filter(more, lambda v: (v != "") & (v != clean)),
            lambda v: F.transform(endings, lambda t: F.concat(v, t)),
        )
    )
    return F.array_distinct(F.concat(wide, extra))


def candidate_domains(owners: DataFrame, domains: DataFrame, col: str = "username") -> DataFrame:
    """Known domains (column ``domain``) that a handle suggests: ``username``, ``domain``, ``rank``."""
    handles = owners.select(F.col(col).alias("username")).where(values.trimmed(F.col(col)) != "").distinct()
    wanted = handles.select("username", F.posexplode(personal_domains(F.col("username"))).alias("rank", "domain"))
    return wanted.join(domains.select("domain").distinct(), "domain").select("username", "domain", "rank")
