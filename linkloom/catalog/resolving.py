"""Queries for merging, linking, scoring and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.derive import (
    AS_OF,
    DOC_TIME,
    EVENTS_SQL,
    document_mentions,
    event_mentions,
    event_observations,
    observations,
)
from linkloom.catalog.extracting import _LINKS, edges_sql, links_sql, mentions_sql, text_scan_sql
from linkloom.catalog.registry import query, spread, table
from linkloom.operators import accounts, link, resolve, score
from linkloom.session import cut_lineage

_E = f"WITH {EVENTS_SQL}"


def event_entities(spark, d):
    return resolve.resolve_exact(event_mentions(spark, d))


def _flat(ents):
    """Entities with lists and maps as text."""
    return ents.withColumn("sources", F.array_join("sources", ",")).drop("properties")


@query(
    "r1_resolved_entities",
    f"""{_E} SELECT * REPLACE (array_to_string(sources, ',') AS sources) FROM ents""",
)
def _(spark, d):
    return _flat(event_entities(spark, d))


_DOCS = f"""m AS (SELECT source AS investigation_id, 'd' || doc_id AS observation_id, lang AS source, id, type, value
    FROM ({text_scan_sql('documents', 'doc_id, source, lang')}))"""


@query(
    "r1_resolved_text_entities",
    f"""WITH {_DOCS} SELECT investigation_id, id, min(type) AS type, min(value) AS value,
      CAST(0.85 AS DOUBLE) AS confidence, count(DISTINCT source) AS source_count,
      count(DISTINCT observation_id) AS evidence_count FROM m GROUP BY investigation_id, id""",
)
def _(spark, d):
    ents = resolve.resolve_exact(document_mentions(spark, d))
    return ents.select("investigation_id", "id", "type", "value", "confidence", "source_count", "evidence_count")


_PROPS = """
props AS (SELECT investigation_id, id, seen_at, observation_id, unnest([
    {'key': 'k', 'value': '' || k},
    {'key': 'first', 'value': CASE WHEN event_id % 2 = 0 THEN '' ELSE '' || event_id END}]) AS p FROM men
    WHERE event_id % 3 = 0),
firsts AS (SELECT investigation_id, id, p.key AS key, arg_min(p.value, (seen_at, observation_id)) AS value
    FROM props {where} GROUP BY ALL),
maps AS (SELECT investigation_id, id, string_agg(key || '=' || value, ';' ORDER BY key) AS properties FROM firsts
    GROUP BY ALL)"""


def _properties(fill: bool) -> str:
    where = "WHERE p.value <> ''" if fill else ""
    return f"""{_E}, {_PROPS.replace('{where}', where)}
    SELECT investigation_id, id, coalesce(properties, '') AS properties FROM ents LEFT JOIN maps
    USING (investigation_id, id)"""


def _shown_properties(ents):
    pairs = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return ents.select("investigation_id", "id", F.array_join(F.array_sort(pairs), ";").alias("properties"))


@query("r1_merged_properties", _properties(False))
def _(spark, d):
    return _shown_properties(resolve.resolve_exact(event_mentions(spark, d)))


@query("r1b_merged_properties_fill_empty", _properties(True))
def _(spark, d):
    return _shown_properties(resolve.resolve_exact(event_mentions(spark, d), fill_empty=True))


@query(
    "r2_merged_by_value",
    f"""{_E}, other AS (SELECT *, id || CASE WHEN event_id % 2 = 0 THEN '#alt' ELSE '' END AS eid FROM men),
      per AS (SELECT investigation_id, eid, min(type) AS type, min(value) AS value, max(confidence) AS confidence
        FROM other GROUP BY ALL)
    SELECT investigation_id, type, value, arg_min(eid, (-confidence, eid)) AS id, max(confidence) AS confidence,
      any_value(n) AS evidence_count, any_value(s) AS sources
    FROM per JOIN (SELECT investigation_id, type, value, count(DISTINCT observation_id) AS n,
      string_agg(DISTINCT source, ',' ORDER BY source) AS s FROM other GROUP BY ALL) USING (investigation_id, type, value)
    GROUP BY ALL""",
)
def _(spark, d):
    even = F.col("observation_id").substr(F.lit(2), F.lit(20)).cast("bigint") % 2 == 0
    rows = event_mentions(spark, d).withColumn("id", F.when(even, F.concat("id", F.lit("#alt"))).otherwise(F.col("id")))
    prov = resolve.entity_provenance(rows, uuid_only=False)
    ents = resolve.resolve_normalized(resolve.resolve_exact(rows), prov)
    return _flat(ents).select("investigation_id", "type", "value", "id", "confidence", "evidence_count", "sources")


# Users that act in the same hour on the same kind of event.
_TOGETHER = """
WITH mem AS (SELECT DISTINCT 'g' AS inv, event_type || date_trunc('hour', ts) AS obs, 'u' || user_id AS e FROM events),
n AS (SELECT e, count(*) AS n FROM mem GROUP BY e),
p AS (SELECT a.e AS x, b.e AS y, count(*) AS shared, min(a.obs) AS first FROM mem a JOIN mem b
    ON a.obs = b.obs AND a.e < b.e GROUP BY ALL)
SELECT x || ':co_occurs_with:' || y AS id, x AS source_id, y AS target_id, shared,
    greatest(0.3, least(0.9, 1.5 * CAST(shared AS DOUBLE) / (nx.n + ny.n - shared))) AS confidence
FROM p JOIN n nx ON nx.e = x JOIN n ny ON ny.e = y"""


@query("r3_co_occurring_users", _TOGETHER)
def _(spark, d):
    members = table(spark, d, "events").select(
        F.lit("g").alias("investigation_id"),
        F.concat("event_type", F.date_trunc("hour", "ts").cast("string")).alias("observation_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("entity_id"),
    )
    pairs = resolve.co_occurrences(members)
    return pairs.select("id", "source_id", "target_id", "shared", "confidence")


@query(
    "r3_co_occurring_text_values",
    f"""WITH {_DOCS}, mem AS (SELECT DISTINCT investigation_id, observation_id AS obs, id AS e FROM m),
      n AS (SELECT investigation_id, e, count(*) AS n FROM mem GROUP BY ALL),
      p AS (SELECT a.investigation_id, a.e AS x, b.e AS y, count(*) AS shared, min(a.obs) AS observation_id
        FROM mem a JOIN mem b ON a.investigation_id = b.investigation_id AND a.obs = b.obs AND a.e < b.e GROUP BY ALL)
    SELECT p.investigation_id, x AS source_id, y AS target_id, observation_id,
      greatest(0.3, least(0.9, 1.5 * CAST(shared AS DOUBLE) / (nx.n + ny.n - shared))) AS confidence
    FROM p JOIN n nx ON nx.e = x AND nx.investigation_id = p.investigation_id
      JOIN n ny ON ny.e = y AND ny.investigation_id = p.investigation_id""",
)
def _(spark, d):
    rows = document_mentions(spark, d)
    pairs = resolve.co_occurrences(rows.select("investigation_id", "observation_id", F.col("id").alias("entity_id")))
    return pairs.select("investigation_id", "source_id", "target_id", "observation_id", "confidence")


def _names(spark, d):
    """Part names with brand, distinct per type of part, as organizations."""
    return (
        table(spark, d, "part")
        .select(
            F.col("p_type").alias("investigation_id"),
            F.lit("Organization").alias("type"),
            F.concat("p_name", F.lit(" "), "p_brand").alias("value"),
        )
        .distinct()
        .withColumn("id", F.concat(F.lit("organization:"), "value"))
    )


# The ratio is that of recursively longest common substrings, the earliest in the first name, then in the second.
_SIMILAR_SQL = """RECURSIVE nm AS (SELECT DISTINCT p_type AS inv, 'organization:' || p_name || ' ' || p_brand AS id,
      lower(p_name || ' ' || p_brand) AS s FROM part),
    pr AS (SELECT a.inv, a.id AS id_a, b.id AS id_b, a.s AS a, b.s AS b
      FROM nm a JOIN nm b ON a.inv = b.inv AND a.id < b.id
      WHERE 2 * list_sum(list_transform(list_distinct(string_split(a.s, '')), lambda c: least(
        length(a.s) - length(replace(a.s, c, '')), length(b.s) - length(replace(b.s, c, '')))))
        >= 0.85 * (length(a.s) + length(b.s))),
    seg AS (SELECT inv, id_a, id_b, a AS x, b AS y, 0 AS m FROM pr
      UNION ALL
      SELECT inv, id_a, id_b, unnest([x[:i-1], x[i+l:]]), unnest([y[:j-1], y[j+l:]]), unnest([l, 0])
      FROM (SELECT inv, id_a, id_b, x, y, best['l'] AS l, -best['i'] AS i, -best['j'] AS j
        FROM (SELECT inv, id_a, id_b, x, y, list_max(flatten(list_transform(range(1, length(x) + 1), lambda i: flatten(
          list_transform(range(1, length(y) + 1), lambda j: list_transform(list_filter(
            range(1, least(length(x) - i, length(y) - j) + 2), lambda l: x[i:i+l-1] = y[j:j+l-1]),
            lambda l: {'l': l, 'i': -i, 'j': -j})))))) AS best
          FROM seg WHERE x <> '' AND y <> '') WHERE best IS NOT NULL)),
    alike AS (SELECT inv AS investigation_id, id_a, id_b,
      2.0 * sum(m) / (any_value(length(a)) + any_value(length(b))) AS similarity
      FROM seg JOIN pr USING (inv, id_a, id_b) GROUP BY ALL HAVING similarity >= 0.85)"""


@query(
    "r4_similar_names",
    f"WITH {_SIMILAR_SQL} SELECT investigation_id, 'Organization' AS type, id_a, id_b, similarity FROM alike",
)
def _(spark, d):
    return resolve.similar_entities(_names(spark, d))


@query(
    "r5_similarity_edges",
    f"""WITH {_SIMILAR_SQL} SELECT investigation_id, NULL::VARCHAR AS observation_id, NULL::TIMESTAMP AS seen_at,
      'similarity:' || id_a || ':' || id_b AS id, id_a AS source_id, id_b AS target_id,
      'co_occurs_with' AS relationship_type, similarity AS confidence, 'fuzzy_similarity' AS method FROM alike""",
)
def _(spark, d):
    return resolve.similarity_edges(resolve.similar_entities(_names(spark, d), normalize=True))


@query(
    "r6_merged_relationships",
    f"""{_E}, e AS (SELECT investigation_id, 'user:' || investigation_id || ':uses:' || id AS id, seen_at, observation_id,
        confidence, 'm' || event_id % 3 AS method, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS t FROM men)
    SELECT investigation_id, id, max(confidence) AS confidence, count(DISTINCT observation_id) AS evidence_count,
      arg_min(seen_at, (t, seen_at, observation_id, method)) AS discovered_at,
      arg_min(method, (t, seen_at, observation_id, method)) AS method FROM e GROUP BY ALL""",
)
def _(spark, d):
    number = F.col("observation_id").substr(F.lit(2), F.lit(20)).cast("bigint")
    source = F.concat(F.lit("user:"), F.col("investigation_id"))
    edges = event_mentions(spark, d).select(
        "investigation_id",
        "observation_id",
        "seen_at",
        F.concat_ws(":", source, F.lit("uses"), "id").alias("id"),
        source.alias("source_id"),
        F.col("id").alias("target_id"),
        F.lit("uses").alias("relationship_type"),
        "confidence",
        F.concat(F.lit("m"), (number % 3).cast("string")).alias("method"),
        number.alias("_k"),
    )
    first, second = edges.where(F.col("_k") % 2 == 0).drop("_k"), edges.where(F.col("_k") % 2 == 1).drop("_k")
    merged = resolve.merge_relationships(first, second)
    return merged.select("investigation_id", "id", "confidence", "evidence_count", "discovered_at", "method")


# --- accounts ----------------------------------------------------------------------------------------------------
# Customers as accounts: a handle has up to three of them, some attributes agree.

_ACCOUNT_SQL = """
acc AS (SELECT c_custkey AS k, 'inv' AS inv, 'user' || c_custkey // 3 AS handle,
    ['github', 'gitlab', 'reddit'][c_custkey % 3 + 1] AS platform,
    'Name ' || c_nationkey % 3 AS full_name, 'm' || c_custkey // 6 || '@x.org' AS email,
    c_mktsegment AS organization, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'site' || c_nationkey % 4 END AS website,
    'City ' || c_nationkey % 2 AS location FROM customer)"""


def _accounts(spark, d):
    return spread(table(spark, d, "customer"), "c_custkey").selectExpr(
        "'inv' AS investigation_id",
        "lpad(c_custkey, 12, '0') AS observation_id",
        "element_at(array('github', 'gitlab', 'reddit'), CAST(c_custkey % 3 + 1 AS INT)) AS platform",
        "if(c_custkey % 2 = 0, ' User', 'user') || c_custkey div 3 AS username",
        "'Name ' || c_nationkey % 3 AS full_name",
        "upper('m' || c_custkey div 6 || '@x.org') AS email",
        "'Writes code, ' || if(c_nationkey % 2 = 0, 'likes tea.', 'plays chess.') AS bio",
        "c_mktsegment AS organization",
        "if(c_custkey % 2 = 0, '', 'site' || c_nationkey % 4) AS website",
        "'City ' || c_nationkey % 2 AS location",
        "'' AS profile_url",
        "0.8D AS confidence",
    )


@query(
    "r7_linked_accounts",
    f"""WITH {_ACCOUNT_SQL}, g AS (SELECT handle, count(*) AS n FROM acc GROUP BY handle),
      p AS (SELECT a.handle, least(a.platform, b.platform) AS platform_a, greatest(a.platform, b.platform) AS platform_b,
        round(least(1.0, (0.95 * (a.email = b.email)::INT + 0.85 * (a.full_name = b.full_name)::INT
          + 0.70 * (a.organization = b.organization)::INT
          + 0.65 * (a.website <> '' AND a.website = b.website)::INT + 0.50 * (a.location = b.location)::INT
          + 0.55) / 4.2 + least(0.1, 0.02 * n)), 3) AS confidence, a.k AS x, b.k AS y
        FROM acc a JOIN acc b ON a.handle = b.handle AND a.k < b.k JOIN g ON g.handle = a.handle),
      ok AS (SELECT * FROM p WHERE confidence >= 0.45)
    SELECT 'cross_platform:' || platform_a || ':' || platform_b || ':' || handle AS id, max(confidence) AS confidence,
      count(DISTINCT e) AS evidence_count FROM (SELECT *, unnest([x, y]) AS e FROM ok)
    GROUP BY platform_a, platform_b, handle""",
)
def _(spark, d):
    return accounts.link_accounts(_accounts(spark, d)).select("id", "confidence", "evidence_count")


@query(
    "plan_linked_accounts",
    f"""WITH {_ACCOUNT_SQL}, g AS (SELECT handle, count(*) AS n FROM acc GROUP BY handle),
      p AS (SELECT a.handle, least(a.platform, b.platform) AS platform_a, greatest(a.platform, b.platform) AS platform_b,
        round(least(1.0, (0.95 * (a.email = b.email)::INT + 0.85 * (a.full_name = b.full_name)::INT
          + 0.70 * (a.organization = b.organization)::INT
          + 0.65 * (a.website <> '' AND a.website = b.website)::INT + 0.50 * (a.location = b.location)::INT
          + 0.55) / 4.2 + least(0.1, 0.02 * n)), 3) AS confidence, a.k AS x, b.k AS y
        FROM acc a JOIN acc b ON a.handle = b.handle AND a.k < b.k JOIN g ON g.handle = a.handle),
      ok AS (SELECT *, unnest([x, y]) AS e FROM p WHERE confidence >= 0.45)
    SELECT 'cross_platform:' || platform_a || ':' || platform_b || ':' || handle AS id,
      'username:' || handle || '@' || platform_a AS source_id, 'username:' || handle || '@' || platform_b AS target_id,
      'same_person' AS relationship_type, count(DISTINCT e) AS evidence_count
    FROM ok GROUP BY platform_a, platform_b, handle
    UNION ALL SELECT 'username_person:' || handle || ':' || lower(full_name), 'username:' || handle,
      'person:' || lower(full_name), 'same_person', count(DISTINCT k) FROM acc
      WHERE handle IN (SELECT handle FROM acc GROUP BY handle HAVING count(*) > 1) GROUP BY handle, full_name""",
)
def _(spark, d):
    from linkloom.plans.correlate import correlate

    profile = F.struct("full_name", "email", "bio", "organization", "website", "location")
    obs = _accounts(spark, d).select(
        F.col("observation_id").alias("id"), "investigation_id", F.col("platform").alias("source_adapter"),
        F.lit(DOC_TIME).cast("timestamp").alias("collected_at"), F.lit("profile").alias("method"),
        F.trim("username").alias("target"),
        F.to_json(F.struct(F.lit(True).alias("found"), profile.alias("profile"))).alias("raw_response"),
        F.lower(F.trim("username")).alias("normalized_value"), "confidence", F.lit("active").alias("status"),
    )
    rels = correlate(obs, DOC_TIME, fuzzy=False)["relationships"].where("relationship_type = 'same_person'")
    return rels.select("id", "source_id", "target_id", "relationship_type", "evidence_count")


@query(
    "r7d_accounts",
    """SELECT 'gitlab-' || c_custkey AS observation_id, 'gitlab' AS platform, 'user' || c_custkey AS username,
      '' AS full_name, 'User' || c_custkey || '@Example.org' AS email, 'Org ' || c_nationkey AS organization,
      'https://gitlab.com/user' || c_custkey AS profile_url FROM customer
    UNION ALL SELECT 'reddit-' || c_custkey, 'reddit', 'user' || c_custkey, 'user' || c_custkey, '', '',
      'https://reddit.com/user/user' || c_custkey FROM customer""",
)
def _(spark, d):
    found = accounts.accounts(observations(spark, d, "gitlab", "reddit"))
    return found.select("observation_id", "platform", "username", "full_name", "email", "organization", "profile_url")


@query(
    "r7e_account_entities",
    f"""WITH {_ACCOUNT_SQL}, m AS (SELECT k, unnest([
        {{'id': 'username:' || handle, 'type': 'Username', 'confidence': 0.8}},
        {{'id': 'person:' || lower(full_name), 'type': 'Person', 'confidence': 0.7}},
        {{'id': 'email:' || email, 'type': 'Email', 'confidence': 0.8}},
        {{'id': 'organization:' || lower(organization), 'type': 'Organization', 'confidence': 0.7}}]) AS e FROM acc
        WHERE handle IN (SELECT handle FROM acc GROUP BY handle HAVING count(*) > 1))
    SELECT e.id AS id, e.type AS type, count(*) AS sightings, max(e.confidence)::DOUBLE AS confidence FROM m GROUP BY ALL
    UNION ALL SELECT 'username:' || CASE WHEN k % 2 = 0 THEN ' User' || k // 3 ELSE handle END, 'Username', 1, 0.8
      FROM acc WHERE handle IN (SELECT handle FROM acc GROUP BY handle HAVING count(*) = 1)""",
)
def _(spark, d):
    mentions, _edges = accounts.account_entities(_accounts(spark, d), F.lit(DOC_TIME).cast("timestamp"))
    return mentions.groupBy("id", "type").agg(
        F.count("*").alias("sightings"), F.max("confidence").alias("confidence")
    )


@query(
    "r7e_account_edges",
    f"""WITH {_ACCOUNT_SQL}, many AS (SELECT * FROM acc
        WHERE handle IN (SELECT handle FROM acc GROUP BY handle HAVING count(*) > 1))
    SELECT 'username_person:' || handle || ':' || lower(full_name) AS id, 'same_person' AS relationship_type,
      count(*) AS sightings FROM many GROUP BY ALL
    UNION ALL SELECT 'username_email:' || handle || ':' || email, 'has_email', count(*) FROM many GROUP BY ALL""",
)
def _(spark, d):
    _mentions, edges = accounts.account_entities(_accounts(spark, d), F.lit(DOC_TIME).cast("timestamp"))
    return edges.groupBy("id", "relationship_type").agg(F.count("*").alias("sightings"))


@query(
    "r8_handle_matches",
    """WITH h AS (SELECT DISTINCT 'u' || c_custkey % 400 AS username FROM customer),
      v AS (SELECT username, username AS v, 0 AS rank FROM h
        UNION ALL SELECT username, 'the' || username, 1 FROM h UNION ALL SELECT username, 'real' || username, 2 FROM h
        UNION ALL SELECT username, username || '0', 3 FROM h UNION ALL SELECT username, username || '1', 4 FROM h
        UNION ALL SELECT username, username || '2', 5 FROM h)
    SELECT v.username, h.username AS matched, min(rank) AS rank FROM v JOIN h ON v.v = h.username GROUP BY ALL""",
)
def _(spark, d):
    rows = table(spark, d, "customer").selectExpr("'u' || c_custkey % 400 AS username")
    return accounts.candidate_handles(rows, rows)


@query(
    "r8_leet_variants",
    """WITH n AS (SELECT DISTINCT lower(replace(n_name, '_', '')) AS u FROM nation),
      m AS (SELECT u, MAP {'a': '4', 'e': '3', 'i': '1', 'o': '0', 's': '5', 't': '7', 'l': '1', 'b': '8', 'g': '9',
        'z': '2'} AS d FROM n),
      p AS (SELECT u, d, list_filter(range(1, length(u) + 1), lambda i: len(map_keys(d)) > 0
        AND list_contains(map_keys(d), u[i:i])) AS ps FROM m),
      v AS (SELECT u, list_transform(ps, lambda i: u[:i-1] || d[u[i:i]] || u[i+1:]) AS one,
        flatten(list_transform(ps, lambda i: list_transform(list_filter(ps, lambda j: j > i),
          lambda j: u[:i-1] || d[u[i:i]] || u[i+1:j-1] || d[u[j:j]] || u[j+1:]))) AS two FROM p)
    SELECT u AS username, unnest([u, 'the' || u, 'real' || u, u || '0', u || '1', u || '2'] || one || two) AS variant
    FROM v""",
)
def _(spark, d):
    name = F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit("")))
    names = table(spark, d, "nation").select(name.alias("username")).distinct()
    return names.select("username", F.explode(accounts.handle_variants(F.col("username"))).alias("variant"))


@query(
    "r8_part_name_variants",
    """WITH n AS (SELECT DISTINCT p_name AS username, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b
      FROM part), v AS (SELECT username, unnest([username, a || b, a || '.' || b, a || '-' || b, a || '_' || b,
        'the' || a || b, 'real' || a || b, a || b || '0', a || b || '1', a || b || '2']) AS variant,
        unnest(range(10)) AS rank FROM n)
    SELECT username, variant, rank FROM v""",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("username")).distinct()
    variants = accounts.handle_variants(F.col("username"))
    return names.select("username", F.posexplode(variants).alias("rank", "variant"))


@query(
    "r8_probe_variants",
    """WITH n AS (SELECT DISTINCT p_name AS username, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b
      FROM part)
    SELECT username, unnest([username, a || b, a || '.' || b, a || '-' || b, a || '_' || b, b || a, b || '.' || a,
        a || b || '0', a || b || '1']) AS variant, unnest(range(9)) AS rank FROM n""",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("username")).distinct()
    variants = accounts.probe_variants(F.col("username"))
    return names.select("username", F.posexplode(variants).alias("rank", "variant"))


@query(
    "r8b_domain_matches",
    """WITH n AS (SELECT DISTINCT p_name AS username, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b
      FROM part) SELECT username, b || '-' || a || '.io' AS domain, 22 AS rank FROM n
    UNION ALL SELECT username, a || b || '.dev', 0 FROM n""",
)
def _(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("username")).distinct()
    parts = F.split("username", " ")
    owned = names.select(
        F.explode(
            F.array(
                F.concat(parts[1], F.lit("-"), parts[0], F.lit(".io")),
                F.concat(parts[0], parts[1], F.lit(".dev")),
                F.concat(parts[0], F.lit("x"), parts[1], F.lit(".dev")),
            )
        ).alias("domain")
    )
    return accounts.candidate_domains(names, owned)


@query(
    "r9_real_names",
    """SELECT DISTINCT 'inv-' || c_nationkey AS investigation_id, 'Name' || c_custkey % 50 || ' Family' || c_nationkey
      AS real_name FROM customer""",
)
def _(spark, d):
    return accounts.real_names(observations(spark, d, "keybase", "reddit"))


@query("r12_events_without_repeats",
       """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t FROM events),
         f AS (SELECT user_id, event_type, t, min(event_id) AS event_id FROM e GROUP BY ALL),
         nx AS (SELECT a.user_id, a.event_type, a.t, min(b.t) AS t2 FROM f a LEFT JOIN f b ON a.user_id = b.user_id
            AND a.event_type = b.event_type AND b.t >= a.t + 86400000000 GROUP BY ALL),
         k AS (SELECT user_id, event_type, min(t) AS t FROM f GROUP BY ALL
            UNION ALL SELECT k.user_id, k.event_type, nx.t2 FROM k JOIN nx USING (user_id, event_type, t)
            WHERE nx.t2 IS NOT NULL)
       SELECT event_id FROM k JOIN f USING (user_id, event_type, t)""")
def _(spark, d):
    rows = table(spark, d, "events")
    return resolve.dedupe_within(rows, ["user_id", "event_type"], "ts", 86400, "event_id").select("event_id")


# --- scores ------------------------------------------------------------------------------------------------------

def _age(col: str) -> str:
    days = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({col})) / 86400000000.0"
    return f"""CASE WHEN {days} <= 7 THEN 1.0 WHEN {days} <= 30 THEN 0.95 WHEN {days} <= 90 THEN 0.90
        WHEN {days} <= 180 THEN 0.85 WHEN {days} <= 365 THEN 0.80 ELSE 0.75 END"""


_SCORE_SQL = f"""scored AS (SELECT investigation_id, id, least(1.0::DOUBLE, 0.75::DOUBLE
    * least(1.0, 0.7 + CASE WHEN source_count >= 3 THEN 0.15 WHEN source_count = 2 THEN 0.1 ELSE 0.05 END
      + CASE WHEN evidence_count >= 2 THEN 0.1 ELSE 0.05 END + least(0.05, 0.01 * coalesce(np, 0)))
    * CASE WHEN source_count >= 3 THEN 1.15 WHEN source_count = 2 THEN 1.08 ELSE 1.0 END
    * {_age('last_seen')}) AS confidence
    FROM ents LEFT JOIN (SELECT investigation_id, id, count(DISTINCT p.key) AS np FROM props GROUP BY ALL)
    USING (investigation_id, id))"""
_SCORED = f"{_E}, {_PROPS.replace('{where}', '')}, {_SCORE_SQL}"


@query("c1_scored_entities", f"{_SCORED} SELECT investigation_id, id, round(confidence, 8) AS confidence FROM scored")
def _(spark, d):
    scored = score.score_entities(event_entities(spark, d), AS_OF)
    return scored.select("investigation_id", "id", F.round("confidence", 8).alias("confidence"))


_OWN_WEIGHT = "0.5 + (count(*) % 10) / 100.0"


@query(
    "c1a_own_source_weights",
    f"""{_E}, {_PROPS.replace('{where}', '')}, w AS (SELECT event_type, {_OWN_WEIGHT} AS weight FROM events
        WHERE event_type <> 'view' GROUP BY ALL),
      r AS (SELECT investigation_id, id, avg(coalesce(weight, 0.75)::DOUBLE) AS trust FROM (SELECT investigation_id, id,
        unnest(sources) AS s FROM ents) LEFT JOIN w ON w.event_type = s GROUP BY ALL),
      scored AS (SELECT investigation_id, id, least(1.0::DOUBLE, trust
        * least(1.0, 0.7 + CASE WHEN source_count >= 3 THEN 0.15 WHEN source_count = 2 THEN 0.1 ELSE 0.05 END
          + CASE WHEN evidence_count >= 2 THEN 0.1 ELSE 0.05 END + least(0.05, 0.01 * coalesce(np, 0)))
        * CASE WHEN source_count >= 3 THEN 1.15 WHEN source_count = 2 THEN 1.08 ELSE 1.0 END
        * {_age('last_seen')}) AS confidence
        FROM ents JOIN r USING (investigation_id, id) LEFT JOIN (SELECT investigation_id, id, count(DISTINCT p.key) AS np
        FROM props GROUP BY ALL) USING (investigation_id, id))
    SELECT investigation_id, id, round(confidence, 8) AS confidence FROM scored""",
)
def _(spark, d):
    """Weights of sources from a table; one source keeps the default."""
    own = table(spark, d, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("source"))
    own = own.agg(F.expr(_OWN_WEIGHT).alias("weight"))
    scored = score.score_entities(event_entities(spark, d), AS_OF, own)
    return scored.select("investigation_id", "id", F.round("confidence", 8).alias("confidence"))


@query(
    "c1_scored_collector_entities",
    f"""WITH m AS ({mentions_sql('dns', 'whois', 'github')}), e AS (SELECT investigation_id, id,
        list(DISTINCT source) AS s, count(DISTINCT observation_id) AS n,
        max(len(string_split(nullif(properties, ''), ';'))) AS np FROM m GROUP BY ALL)
    SELECT investigation_id, id, round(least(1.0,
      list_avg(list_transform(s, lambda x: CASE x WHEN 'dns' THEN 0.95 WHEN 'whois' THEN 0.9 ELSE 0.82 END))
      * least(1.0, 0.7 + CASE len(s) WHEN 1 THEN 0.05 WHEN 2 THEN 0.1 ELSE 0.15 END
        + CASE WHEN n >= 2 THEN 0.1 ELSE 0.05 END + least(0.05, 0.01 * coalesce(np, 0)))
      * CASE len(s) WHEN 1 THEN 1.0 WHEN 2 THEN 1.08 ELSE 1.15 END * 0.9), 8) AS confidence FROM e""",
)
def _(spark, d):
    from linkloom.operators import extract

    adapters = ["dns", "whois", "github"]
    mentions, _edges = extract.extract_all(observations(spark, d, *adapters), adapters=adapters)
    # Entities and their properties are merged from the same mentions.
    scored = score.score_entities(
        resolve.resolve_exact(cut_lineage(mentions)), F.lit("2024-03-20 00:00:00").cast("timestamp")
    )
    return scored.select("investigation_id", "id", F.round("confidence", 8).alias("confidence"))


_RELS_SQL = """edges AS (SELECT investigation_id, 'user:' || investigation_id AS source_id, id AS target_id,
    count(DISTINCT observation_id) AS n, min(seen_at) AS since,
    arg_min(CASE WHEN event_id % 2 = 0 THEN 'dns_a_record' ELSE 'other' END, (seen_at, observation_id)) AS method
    FROM men GROUP BY ALL)"""


def _event_edges(spark, d, to_self=False):
    even = F.col("observation_id").substr(F.lit(2), F.lit(20)).cast("bigint") % 2 == 0
    source = F.col("id") if to_self else F.concat(F.lit("user:"), "investigation_id")
    rows = event_mentions(spark, d).select(
        "investigation_id",
        "observation_id",
        "seen_at",
        F.concat_ws(":", source, F.lit("uses"), "id").alias("id"),
        source.alias("source_id"),
        F.col("id").alias("target_id"),
        F.lit("uses").alias("relationship_type"),
        "confidence",
        F.when(even, "dns_a_record").otherwise("other").alias("method"),
    )
    return resolve.merge_relationships(rows)


@query(
    "c2_scored_relationships",
    f"""{_E}, {_RELS_SQL} SELECT investigation_id, target_id, round(least(1.0::DOUBLE,
      CASE method WHEN 'dns_a_record' THEN 0.95::DOUBLE ELSE 0.75 END
      * CASE WHEN n >= 3 THEN 1.15 WHEN n = 2 THEN 1.08 ELSE 1.0 END * {_age('since')}), 8) AS confidence FROM edges""",
)
def _(spark, d):
    scored = score.score_relationships(_event_edges(spark, d), event_entities(spark, d), AS_OF)
    return scored.select("investigation_id", "target_id", F.round("confidence", 8).alias("confidence"))


@query(
    "c3_scored_graph",
    f"""{_SCORED}, {_RELS_SQL} SELECT e.investigation_id, target_id, round(least(1.0::DOUBLE,
      CASE method WHEN 'dns_a_record' THEN 0.95::DOUBLE ELSE 0.75 END
      * CASE WHEN n >= 3 THEN 1.15 WHEN n = 2 THEN 1.08 ELSE 1.0 END * (0.8 + 0.2 * s.confidence)
      * {_age('since')}), 8) AS confidence FROM edges e JOIN scored s
      ON s.investigation_id = e.investigation_id AND s.id = e.target_id""",
)
def _(spark, d):
    _ents, rels = score.score_all(event_entities(spark, d), _event_edges(spark, d, True), AS_OF)
    return rels.select("investigation_id", "target_id", F.round("confidence", 8).alias("confidence"))


_OVERRIDES = """ov AS (SELECT investigation_id, id AS entity_id, event_id, seen_at, (event_id % 100) / 100.0 AS c
    FROM men WHERE source = 'error')"""


@query(
    "c4_manual_overrides",
    f"""{_E}, {_OVERRIDES} SELECT e.investigation_id, e.id, coalesce(o.c, e.confidence)::DOUBLE AS confidence
    FROM ents e LEFT JOIN (SELECT investigation_id, entity_id, arg_max(c, (seen_at, event_id)) AS c FROM ov GROUP BY ALL) o
    ON o.investigation_id = e.investigation_id AND o.entity_id = e.id""",
)
def _(spark, d):
    k = F.col("observation_id").substr(F.lit(2), F.lit(20)).cast("bigint")
    rows = event_mentions(spark, d).where("source = 'error'").select(
        "investigation_id",
        F.col("id").alias("entity_id"),
        ((k % 100) / 100.0).alias("override_confidence"),
        F.col("seen_at").alias("created_at"),
        F.lpad(k.cast("string"), 12, "0").alias("id"),
    )
    out = score.apply_overrides(event_entities(spark, d), rows)
    return out.select("investigation_id", "id", "confidence")


@query(
    "c5_threat_scores",
    """SELECT s_suppkey, greatest((s_suppkey % 101) / 100.0, CASE s_suppkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5
      WHEN 2 THEN 0.7 ELSE 0.0 END)::DOUBLE AS threat_score FROM supplier""",
)
def _(spark, d):
    rows = table(spark, d, "supplier").selectExpr(
        "s_suppkey",
        "s_suppkey % 101 AS abuse",
        "element_at(array('online', 'offline', 'unknown', NULL), CAST(s_suppkey % 4 + 1 AS INT)) AS url_status",
    )
    found = score.threat_score(F.col("abuse"), F.col("url_status"), F.col("url_status").isNotNull())
    return rows.select("s_suppkey", found.alias("threat_score"))


# --- links -------------------------------------------------------------------------------------------------------


def _entities_of(spark, d, *adapters):
    from linkloom.operators import extract

    obs = observations(spark, d, *adapters)
    # Entities are a stored table; both ends of an edge are looked up in it by id.
    mentions, _edges = extract.extract_all(obs, adapters=list(adapters))
    return obs, cut_lineage(mentions.select("investigation_id", "id").distinct())


# links to a technology and to a redirect hold only when some observation mentions those entities
_LINK_JOBS = {
    "l1_dns_links": "dns",
    "l2_whois_links": "whois",
    "l3_certificate_links": "certificate_transparency",
    "l4_ip_asn_links": "ip_to_asn",
    "l6_threat_links": "threat_intel",
    "l7_github_links": "github",
}


def _register() -> None:
    for name, adapter in _LINK_JOBS.items():

        @query(name, links_sql(adapter))
        def _(spark, d, adapter=adapter):
            return link.links_within(observations(spark, d, adapter), adapter).drop("seen_at")


_register()


_HTTP_LINKS = """SELECT 'inv-' || p_partkey % 25 AS investigation_id, 'http-' || p_partkey AS observation_id,
      'domain:shop' || p_partkey || '.example.com' AS source_id,
      unnest(['technology:nginx 1.' || p_size, 'url:https://shop' || p_partkey || '.example.com/home']) AS target_id,
      unnest(['uses_technology', 'links_to']) AS relationship_type,
      unnest([0.85::DOUBLE, 0.8]) AS confidence FROM part"""


def _shops(spark, d):
    """The domains and redirect targets that other observations would have found."""
    return table(spark, d, "part").selectExpr(
        "'inv-' || p_partkey % 25 AS investigation_id",
        "explode(array('domain:shop' || p_partkey || '.example.com', "
        "'url:https://shop' || p_partkey || '.example.com/home')) AS id",
    )


@query("l5_http_links", _HTTP_LINKS)
def _(spark, d):
    from linkloom.operators import extract

    obs = observations(spark, d, "http")
    named = resolve.resolve_exact(extract.extract_http(obs)[0])
    ents = named.select("investigation_id", "id").unionByName(_shops(spark, d))
    return link.link_http(obs, ents).select(
        "investigation_id", "observation_id", "source_id", "target_id", "relationship_type", "confidence"
    )


_EMAIL_LINKS = """SELECT 'inv-' || s_nationkey AS investigation_id, 'dns-' || s_suppkey AS observation_id,
    'email:admin@s' || s_suppkey || '.example.com:associated_with_email:domain:s' || s_suppkey || '.example.com' AS id,
    'email:admin@s' || s_suppkey || '.example.com' AS source_id, 'domain:s' || s_suppkey || '.example.com' AS target_id,
    'associated_with_email' AS relationship_type, 1.0::DOUBLE AS confidence, 'target_email_domain' AS method
    FROM supplier WHERE s_suppkey % 10 = 9"""


@query("l8_email_domain_links", _EMAIL_LINKS)
def _(spark, d):
    return link.link_email_domain(*_entities_of(spark, d, "dns")).drop("seen_at")


_ALL_LINKED = ["dns", "whois", "certificate_transparency", "ip_to_asn", "threat_intel", "github"]


@query(
    "l9_structural_links",
    f"""SELECT investigation_id, id, source_id, target_id, relationship_type FROM
    (SELECT DISTINCT investigation_id, id, source_id, target_id, relationship_type FROM
    ({edges_sql(_LINKS, *_ALL_LINKED)} UNION ALL {_EMAIL_LINKS})
    UNION ALL SELECT investigation_id, source_id || ':' || relationship_type || ':' || target_id, source_id, target_id,
      relationship_type FROM ({_HTTP_LINKS}))""",
)
def _(spark, d):
    """One pass over the payloads gives both the entities and the links between them."""
    from linkloom.operators import extract

    adapters = [*_ALL_LINKED, "http"]
    said = extract.said_in(observations(spark, d, *adapters), (extract.MENTIONED, extract.LINKED), adapters)
    said = cut_lineage(said, by=["what"])
    ents = extract.mentions_of(said).select("investigation_id", "id").distinct().unionByName(_shops(spark, d))
    found = link.known_links(extract.edges_of(said, extract.LINKED), ents)
    return found.select("investigation_id", "id", "source_id", "target_id", "relationship_type")


# --- provenance, references, enrichment --------------------------------------------------------------------------


def _provenance(spark, d):
    return resolve.entity_provenance(event_mentions(spark, d), uuid_only=False)


@query(
    "s7_provenance",
    f"""{_E} SELECT id AS entity_id, '00000000-0000-4000-8000-' || lpad('' || event_id, 12, '0') AS observation_id,
      investigation_id, seen_at AS created_at FROM men WHERE event_id % 10 <> 0""",
)
def _(spark, d):
    k = F.col("observation_id").substr(F.lit(2), F.lit(20))
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(k, 12, "0"))
    # every tenth observation has an id that is no UUID or blank
    bad = F.when(k.cast("bigint") % 20 == 0, "").otherwise(F.col("observation_id"))
    rows = event_mentions(spark, d).withColumn(
        "observation_id", F.when(k.cast("bigint") % 10 == 0, bad).otherwise(uuid)
    )
    return resolve.entity_provenance(rows.unionAll(rows))


@query(
    "s8_edges_both_ways",
    f"""{_E}, {_RELS_SQL} SELECT source_id AS from_id, target_id AS to_id, investigation_id FROM edges
    UNION ALL SELECT target_id, source_id, investigation_id FROM edges""",
)
def _(spark, d):
    return resolve.edges_bidi(_event_edges(spark, d))


@query(
    "j1_entity_observations",
    f"""{_E} SELECT m.id AS entity_id, m.investigation_id, m.observation_id, source_adapter, collected_at, method, target,
      normalized_value, o.confidence, status FROM men m JOIN obs o ON o.id = m.observation_id""",
)
def _(spark, d):
    return link.entity_observations(_provenance(spark, d), event_observations(spark, d))


@query(
    "j2_provenance_trail",
    f"""{_E} SELECT m.id AS entity_id, m.observation_id, m.investigation_id, m.seen_at AS discovered_at, source_adapter,
      collected_at, method, target, o.confidence, status FROM men m LEFT JOIN (SELECT * FROM obs WHERE status = 'success') o
      ON o.id = m.observation_id""",
)
def _(spark, d):
    kept = event_observations(spark, d).where(F.col("status") == "success")
    return link.provenance_trail(_provenance(spark, d), kept)


@query(
    "j3_workspace_notes",
    """SELECT 'o' || o_orderkey AS id, o_orderpriority AS content, o_orderdate::TIMESTAMP AS created_at,
      c_name AS investigation_name FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(spark, d):
    notes = table(spark, d, "orders").selectExpr(
        "'o' || o_orderkey AS id", "'c' || o_custkey AS investigation_id", "o_orderpriority AS content",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
    )
    inv = table(spark, d, "customer").selectExpr("'c' || c_custkey AS id", "c_name AS name")
    return link.workspace_notes(notes, inv)


def _refs(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "transform(array(o_custkey, o_orderkey % 3000, o_orderkey % 7), x -> CAST(x AS STRING)) AS refs",
    )


@query(
    "j4_valid_references",
    """WITH r AS (SELECT o_orderkey, unnest([o_custkey, o_orderkey % 3000, o_orderkey % 7]) AS ref,
        unnest([1, 2, 3]) AS pos FROM orders)
    SELECT o_orderkey, coalesce(string_agg(CASE WHEN c_custkey IS NOT NULL THEN '' || ref END, ',' ORDER BY pos), '') AS refs,
      count(*) - count(c_custkey) AS unknown_count FROM r LEFT JOIN customer ON ref = c_custkey GROUP BY o_orderkey""",
)
def _(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    out = link.validate_references(_refs(spark, d), "o_orderkey", "refs", known, "id")
    return out.select("o_orderkey", F.array_join("refs", ",").alias("refs"), "unknown_count")


@query(
    "u3_unknown_references",
    """SELECT '' || ref AS reference, o_orderkey FROM (SELECT o_orderkey, unnest([o_custkey, o_orderkey % 3000,
      o_orderkey % 7]) AS ref FROM orders) WHERE ref NOT IN (SELECT c_custkey FROM customer)""",
)
def _(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return link.unknown_references(_refs(spark, d), "o_orderkey", "refs", known, "id")


@query(
    "j6_announced_prefixes",
    """WITH pre AS (SELECT '198.' || s_suppkey % 64 || '.0.0/16' AS prefix, 'AS' || s_suppkey AS asn,
        198 * 256 + s_suppkey % 64 AS key, 16 AS bits, 65536 AS w FROM supplier
      UNION ALL SELECT '198.' || s_suppkey % 64 || '.' || s_nationkey || '.0/24', 'AS9' || s_suppkey,
        (198 * 256 + s_suppkey % 64) * 256 + s_nationkey, 24, 256 FROM supplier),
      best AS (SELECT key, bits, w, arg_min({'prefix': prefix, 'asn': asn}, (prefix, asn)) AS p FROM pre GROUP BY ALL),
      ip AS (SELECT o_orderkey, '198.' || o_orderkey % 80 || '.' || o_custkey % 30 || '.' || o_orderkey % 256 AS value,
        ((198 * 256 + o_orderkey % 80) * 256 + o_custkey % 30) * 256 + o_orderkey % 256 AS n FROM orders),
      hit AS (SELECT o_orderkey, arg_max(p, bits) AS p FROM ip JOIN best ON n // w = key GROUP BY o_orderkey)
    SELECT o_orderkey, value, p.prefix AS prefix, p.asn AS asn FROM ip LEFT JOIN hit USING (o_orderkey)""",
)
def _(spark, d):
    supplier = table(spark, d, "supplier")
    prefixes = supplier.selectExpr(
        "'198.' || s_suppkey % 64 || '.0.0/16' AS prefix", "'AS' || s_suppkey AS asn"
    ).unionAll(
        supplier.selectExpr("'198.' || s_suppkey % 64 || '.' || s_nationkey || '.7/24'", "'AS9' || s_suppkey")
    )
    # a prefix may be written with host bits; it is shown as written, so write it without
    prefixes = prefixes.withColumn("prefix", F.replace("prefix", F.lit(".7/24"), F.lit(".0/24")))
    ips = table(spark, d, "orders").selectExpr(
        "o_orderkey", "'198.' || o_orderkey % 80 || '.' || o_custkey % 30 || '.' || o_orderkey % 256 AS value"
    )
    return link.enrich_asn(ips, prefixes)


@query(
    "j7_threat_feed",
    f"""{_E}, feed AS (SELECT 'v' || p_size AS value, p_partkey % 100 AS score,
        CASE p_partkey % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' END AS st FROM part),
      best AS (SELECT value, max(greatest(score / 100.0, CASE st WHEN 'online' THEN 0.9 WHEN 'offline' THEN 0.5
        ELSE 0.0 END)) AS t FROM feed GROUP BY value)
    SELECT investigation_id, id, t::DOUBLE AS threat_score FROM ents JOIN best USING (value)
    WHERE type IN ('IP', 'URL', 'Domain', 'Subdomain')""",
)
def _(spark, d):
    feed = table(spark, d, "part").selectExpr(
        "'v' || p_size AS value", "p_partkey % 100 AS abuse_score",
        "CASE p_partkey % 3 WHEN 0 THEN 'online' WHEN 1 THEN 'offline' END AS url_status",
    )
    return link.enrich_threat(event_entities(spark, d), feed).select("investigation_id", "id", "threat_score")
