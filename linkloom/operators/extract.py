"""Entities and edges in stored collector payloads.

Each adapter is three array expressions over one observation row: the values it mentions, the edges it states, and the
edges that hold between known entities. Dispatch picks those of the row's adapter, so a whole observation table is read
and parsed once, without unions and shuffles; values are standardized after the arrays are taken apart.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkloom.functions import fixed, values
from linkloom.functions.once import built_once
from linkloom.operators.accounts import PROFILE, profile_fields
from linkloom.operators.text import TEXT_CONFIDENCE, text_candidates

# What a payload says, as one kind of item: a mention has a type and a raw value; an edge has those of its source, and
# those of its target.
ITEM = (
    "struct<type:string,raw:string,confidence:double,properties:map<string,string>,verbatim:boolean,id:string,"
    "rel:string,tgt_type:string,tgt_raw:string,method:string>"
)
MENTION = EDGE = ITEM

PAYLOADS = {
    "dns": "A ARRAY<STRING>, AAAA ARRAY<STRING>, MX ARRAY<STRING>, NS ARRAY<STRING>, TXT ARRAY<STRING>, "
    "PTR ARRAY<STRING>, SOA STRING",
    "whois": "registrar STRING, registrant_name STRING, registrant_email STRING, creation_date STRING, "
    "expiry_date STRING, expiration_date STRING, updated_date STRING, nameservers STRING, name_servers STRING, "
    "domain_status STRING",
    "certificate_transparency": "certificates ARRAY<STRUCT<id STRING, common_name STRING, name_value STRING, "
    "issuer_name STRING>>",
    "http": "headers MAP<STRING,STRING>, title STRING, technologies ARRAY<STRING>, redirects ARRAY<STRING>",
    "github": "login STRING, email STRING, organization STRING, profile STRUCT<login STRING, email STRING, "
    "blog STRING, organization STRING>, repositories ARRAY<STRING>, organizations ARRAY<STRING>",
    "gitlab": "found BOOLEAN, profile STRUCT<username STRING, email STRING, organization STRING, "
    "profile_url STRING>, projects ARRAY<STRUCT<path STRING>>, groups ARRAY<STRUCT<path STRING>>",
    "keybase": "found BOOLEAN, profile STRUCT<username STRING, full_name STRING, website STRING, "
    "profile_url STRING, social_proofs ARRAY<STRUCT<service STRING, username STRING>>>",
    "reddit": "found BOOLEAN, profile STRUCT<name STRING, profile_url STRING>",
    "hackernews": "found BOOLEAN, profile STRUCT<username STRING, profile_url STRING>",
    "ip_to_asn": "asn STRING, organization STRING",
    "threat_intel": "abuse_score INT, abuseipdb STRUCT<abuse_confidence_score INT>, urlhaus STRUCT<threat STRING>",
    "search": "query STRING, result_count INT, extracted_entities STRUCT<domains ARRAY<STRING>, "
    "emails ARRAY<STRING>, ips ARRAY<STRING>>",
    "username_probe": "found BOOLEAN, platform STRING, platform_key STRING, username STRING, url STRING, "
    "confidence DOUBLE, evidence STRUCT<title STRING, snippet STRING, source STRING, domain STRING>",
}


# --- building blocks ---------------------------------------------------------------------------------------------


def _properties(**pairs: Column) -> Column:
    """A map of the given values; null ones are left out."""
    entries = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in pairs.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def _mention(
    kind: str | Column,
    raw: Column,
    confidence: float | Column,
    properties: Column | None = None,
    verbatim: bool = False,
    entity: Column | None = None,
) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
        raw.cast("string").alias("raw"),
        (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
        (properties if properties is not None else F.create_map().cast("map<string,string>")).alias("properties"),
        F.lit(verbatim).alias("verbatim"),
        (entity if entity is not None else F.lit(None).cast("string")).alias("id"),
        *[F.lit(None).cast("string").alias(x) for x in ("rel", "tgt_type", "tgt_raw", "method")],
    )


def _edge(
    src_type: str | Column,
    src: Column,
    rel: str | Column,
    tgt_type: str | Column,
    tgt: Column,
    confidence: float | Column,
    method: str | Column,
    verbatim: bool = False,
) -> Column:
    def lit(x):
        return F.lit(x) if isinstance(x, (str, float)) else x

    return F.struct(
        lit(src_type).alias("type"),
        src.cast("string").alias("raw"),
        lit(confidence).alias("confidence"),
        F.lit(None).cast("map<string,string>").alias("properties"),
        F.lit(verbatim).alias("verbatim"),
        F.lit(None).cast("string").alias("id"),
        lit(rel).alias("rel"),
        lit(tgt_type).alias("tgt_type"),
        tgt.cast("string").alias("tgt_raw"),
        lit(method).alias("method"),
    )


def _list(*items: Column, of: str) -> Column:
    """An array of the items that are present."""
    return F.filter(F.array(*items), lambda x: x.isNotNull()).cast(f"array<{of}>") if items else F.array().cast(
        f"array<{of}>"
    )


def _no_edges() -> Column:
    return _list(of=EDGE)


def _each(items: Column, build: Callable[[Column], Column], of: str) -> Column:
    return F.coalesce(F.transform(items, build).cast(f"array<{of}>"), F.array().cast(f"array<{of}>"))


def _present(value: Column) -> Column:
    return value.isNotNull() & (value != "")


def _record(item: Column) -> Column:
    """A DNS record is a plain string or an object that holds 'value', else 'data'."""
    return F.when(
        item.startswith("{"), F.coalesce(F.get_json_object(item, "$.value"), F.get_json_object(item, "$.data"))
    ).otherwise(item)


def _field(item: Column, name: str) -> Column:
    """A named field of an item that is an object, or the item itself."""
    return F.when(item.startswith("{"), F.get_json_object(item, f"$.{name}")).otherwise(item)


def _text_mentions(text: Column) -> Column:
    return _each(
        text_candidates(text),
        lambda c: _mention(c["type"], c["value"], TEXT_CONFIDENCE),
        MENTION,
    )


# --- adapters ----------------------------------------------------------------------------------------------------
# Every function returns what builds (mentions, edges stated by the payload, edges that hold only between known
# entities), so that only the wanted array is built.
# ``p`` is the parsed payload; the columns _anchor, _anchor_type and _name describe the target, see _prepared().


def _target_mentions(confidence: float, properties: Column | None = None) -> list[Column]:
    return [
        _mention(F.col("_anchor_type"), F.col("_anchor"), confidence, properties),
        F.when(F.col("_is_email"), _mention("Email", F.col("target"), 0.95)),
    ]


def _email_of_target() -> Column:
    return F.when(
        F.col("_is_email"),
        _edge(
            F.col("_anchor_type"), F.col("_anchor"), "associated_with_email", "Email", F.col("target"), 1.0,
            "email_domain",
        ),
    )


def _anchored(kind: str, rel: str, confidence: float, method: str) -> Callable[[Column], Column]:
    return lambda v: _edge(F.col("_anchor_type"), F.col("_anchor"), rel, kind, v, confidence, method)


def _dns_facts(p: Column) -> Column:
    """What mentions, edges and links of a DNS payload have in common."""

    def mx(item: Column) -> Column:
        whole = F.coalesce(
            F.get_json_object(item, "$.exchange"), F.get_json_object(item, "$.value"), F.get_json_object(item, "$.data")
        )
        is_object = item.startswith("{")
        text = F.when(is_object, whole).otherwise(F.regexp_replace(values.trimmed(item), r"\s+", " "))
        stated = F.when(is_object, F.get_json_object(item, "$.priority"))
        leading = F.nullif(F.regexp_extract(text, r"^(\d+) ", 1), F.lit(""))
        host = F.when(is_object, F.regexp_replace(text, r"^[^ ]* ", "")).otherwise(
            F.regexp_replace(text, r"^\d+ (?=[^ ]+$)", "")
        )
        return F.struct(host.alias("host"), F.coalesce(F.nullif(stated, F.lit("")), leading).alias("priority"))

    lists = [F.transform(p[k], _record).alias(k) for k in ("A", "AAAA", "NS", "PTR")]
    return F.struct(*lists, F.transform(p["MX"], mx).alias("MX"))


def _dns(p: Column):
    facts = F.col("_dns_facts")
    a, aaaa, ns, ptr, mail = (facts[k] for k in ("A", "AAAA", "NS", "PTR", "MX"))
    soa = p["SOA"]
    mname = F.coalesce(F.get_json_object(soa, "$.mname"), F.get_json_object(soa, "$.data"))
    rname = F.get_json_object(soa, "$.rname")
    # 'user.host.tld' means user@host.tld
    admin = F.when(
        _present(rname) & ~rname.contains("@") & rname.contains("."),
        F.concat(F.substring_index(rname, ".", 1), F.lit("@"), F.regexp_replace(rname, r"^[^.]*\.", "")),
    )
    mentions = lambda: F.concat(
        _list(*_target_mentions(0.95), of=MENTION),
        _each(a, lambda v: _mention("IP", v, 0.9), MENTION),
        _each(aaaa, lambda v: _mention("IP", v, 0.9), MENTION),
        _each(mail, lambda m: _mention("Domain", m["host"], 0.9, _properties(mx_priority=m["priority"])), MENTION),
        _each(ns, lambda v: _mention("Domain", v, 0.9), MENTION),
        _list(
            F.when(_present(mname), _mention("Domain", mname, 0.9)),
            F.when(_present(admin), _mention("Email", admin, 0.9)),
            of=MENTION,
        ),
        F.coalesce(
            F.flatten(F.transform(p["TXT"], lambda t: _text_mentions(_record(t)))), _list(of=MENTION)
        ),
        _each(ptr, lambda v: _mention("Domain", v, 0.9), MENTION),
    )
    edges = lambda: F.concat(
        _list(_email_of_target(), of=EDGE),
        _each(a, _anchored("IP", "hosted_on", 0.9, "dns_a_record"), EDGE),
        _each(aaaa, _anchored("IP", "hosted_on", 0.9, "dns_aaaa_record"), EDGE),
        _each(mail, lambda m: _anchored("Domain", "sends_mail_via", 0.9, "dns_mx_record")(m["host"]), EDGE),
        _each(ns, _anchored("Domain", "uses_nameserver", 0.9, "dns_ns_record"), EDGE),
        _list(
            F.when(_present(mname), _anchored("Domain", "uses_nameserver", 0.9, "dns_soa_mname")(mname)),
            F.when(_present(admin), _anchored("Email", "registered_by", 0.7, "dns_soa_rname")(admin)),
            of=EDGE,
        ),
        _each(ptr, _anchored("Domain", "has_ptr", 0.9, "dns_ptr_record"), EDGE),
    )
    links = lambda: F.concat(
        _each(a, _anchored("IP", "hosted_on", 0.95, "dns_a_record"), EDGE),
        _each(aaaa, _anchored("IP", "hosted_on", 0.95, "dns_aaaa_record"), EDGE),
        _each(ns, _anchored("Domain", "uses_nameserver", 0.95, "dns_ns_record"), EDGE),
        _each(mail, lambda m: _anchored("Domain", "sends_mail_via", 0.9, "dns_mx_record")(m["host"]), EDGE),
    )
    return mentions, edges, links


def _name_servers(p: Column) -> Column:
    text = F.coalesce(p["nameservers"], p["name_servers"])
    items = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))

    def one(item: Column) -> Column:
        is_object = item.startswith("{")
        name = values.trimmed(F.when(is_object, F.get_json_object(item, "$.name")).otherwise(item))
        address = F.when(
            is_object,
            values.trimmed(F.coalesce(F.get_json_object(item, "$.ipv4"), F.get_json_object(item, "$.ipv6"))),
        )
        shown = _present(name) & ~F.lower(name).isin(fixed.HIDDEN_NAMESERVERS)
        is_ip = values.is_ipv4(name) | values.is_ipv6(name)
        return F.struct(
            F.when(shown, name).alias("name"),
            F.when(~is_object & is_ip, "IP").otherwise("Domain").alias("kind"),
            F.when(values.is_ipv4(address) | values.is_ipv6(address), address).alias("address"),
        )

    return F.transform(F.filter(items, _present), one)


def _whois(p: Column):
    def iso(value: Column) -> Column:
        return F.date_format(values.timestamp(value), "yyyy-MM-dd'T'HH:mm:ss")

    about = _properties(
        creation_date=iso(p["creation_date"]),
        expiry_date=iso(F.coalesce(F.nullif(p["expiry_date"], F.lit("")), p["expiration_date"])),
        updated_date=iso(p["updated_date"]),
        whois_status=F.nullif(p["domain_status"], F.lit("")),
    )
    registrar = F.when(_present(p["registrar"]), p["registrar"])
    mail = F.when(_present(p["registrant_email"]) & ~values.is_redacted(p["registrant_email"]), p["registrant_email"])
    person = F.when(_present(p["registrant_name"]) & ~values.is_redacted(p["registrant_name"]), p["registrant_name"])
    servers = F.col("_whois_facts")
    named = F.filter(servers, lambda s: s["name"].isNotNull())
    placed = F.filter(servers, lambda s: s["address"].isNotNull())
    mentions = lambda: F.concat(
        _list(
            *_target_mentions(0.9, about),
            F.when(registrar.isNotNull(), _mention("Organization", registrar, 0.8)),
            F.when(mail.isNotNull(), _mention("Email", mail, 0.75)),
            F.when(person.isNotNull(), _mention("Organization", person, 0.7)),
            of=MENTION,
        ),
        _each(named, lambda s: _mention(s["kind"], s["name"], 0.9), MENTION),
        _each(placed, lambda s: _mention("IP", s["address"], 0.9), MENTION),
    )

    def serves(confidence: float) -> Column:
        return _each(
            named,
            lambda s: _edge(
                F.col("_anchor_type"), F.col("_anchor"), "uses_nameserver", s["kind"], s["name"], confidence,
                "whois_nameserver",
            ),
            EDGE,
        )

    edges = lambda: F.concat(
        _list(
            _email_of_target(),
            F.when(
                registrar.isNotNull(), _anchored("Organization", "registered_with", 0.85, "whois_registrar")(registrar)
            ),
            F.when(mail.isNotNull(), _anchored("Email", "registered_by", 0.85, "whois_registrant_email")(mail)),
            F.when(
                person.isNotNull(), _anchored("Organization", "registered_by", 0.7, "whois_registrant_name")(person)
            ),
            of=EDGE,
        ),
        serves(0.85),
        _each(
            F.filter(placed, lambda s: s["name"].isNotNull()),
            lambda s: _edge("Domain", s["name"], "hosted_on", "IP", s["address"], 0.85, "whois_nameserver_ip"),
            EDGE,
        ),
    )
    links = lambda: F.concat(
        _list(
            F.when(mail.isNotNull(), _anchored("Email", "registered_by", 0.8, "whois_registrant_email")(mail)),
            F.when(
                registrar.isNotNull(), _anchored("Organization", "registered_with", 0.85, "whois_registrar")(registrar)
            ),
            of=EDGE,
        ),
        serves(0.9),
    )
    return mentions, edges, links


def _ct_facts(p: Column, max_certs: int | None) -> Column:
    """The certificates of a payload with the names on each, and how many there were."""
    every = F.coalesce(p["certificates"], F.array().cast("array<struct<id:string,common_name:string,"
                                                          "name_value:string,issuer_name:string>>"))
    certs = every if max_certs is None else F.slice(every, 1, max_certs)
    certs = F.transform(
        certs,
        lambda c: F.struct(
            F.coalesce(F.nullif(c["id"], F.lit("")), c["issuer_name"], F.lit("unknown")).alias("id"),
            values.issuer_organization(c["issuer_name"]).alias("issuer"),
            F.transform(
                F.filter(
                    F.array_distinct(
                        F.transform(F.split(F.coalesce(c["name_value"], F.lit("")), "\n"),
                                    lambda n: F.lower(values.trimmed(n)))
                    ),
                    lambda n: (n != "") & (n != F.col("_name")),
                ),
                lambda n: F.struct(
                    n.alias("name"),
                    F.when(values.is_ipv4(n) | values.is_ipv6(n), "IP")
                    .when(n.endswith(F.concat(F.lit("."), F.col("_name"))), "Subdomain")
                    .otherwise("Domain")
                    .alias("kind"),
                ),
            ).alias("names"),
        ),
    )
    return F.struct(certs.alias("certs"), F.size(every).alias("total"))


def _ct(p: Column):
    facts = F.col("_certificate_transparency_facts")
    certs, total = facts["certs"], facts["total"]
    about = _properties(
        _ct_total_certs=total, _ct_processed_certs=F.size(certs), _ct_truncated=total > F.size(certs)
    )
    mentions = lambda: F.concat(
        _list(*_target_mentions(0.95, about), of=MENTION),
        F.flatten(
            F.transform(
                certs,
                lambda c: F.concat(
                    _list(
                        _mention("Certificate", c["id"], 0.9),
                        F.when(_present(c["issuer"]), _mention("Organization", c["issuer"], 0.85)),
                        of=MENTION,
                    ),
                    _each(
                        c["names"],
                        lambda n: _mention(
                            n["kind"], n["name"], F.when(n["kind"] == "Domain", F.lit(0.75)).otherwise(F.lit(0.9))
                        ),
                        MENTION,
                    ),
                ),
            )
        ),
    )

    def san(cert: Column, n: Column) -> Column:
        other = n["kind"] == "Domain"
        return _edge(
            F.when(other, F.lit("Domain")).otherwise(F.col("_anchor_type")),
            F.when(other, n["name"]).otherwise(F.col("_anchor")),
            F.when(other, "covered_by_certificate").when(n["kind"] == "IP", "hosted_on").otherwise("has_subdomain"),
            F.when(other, "Certificate").otherwise(n["kind"]),
            F.when(other, cert).otherwise(n["name"]),
            F.when(n["kind"] == "Subdomain", F.lit(0.9)).otherwise(F.lit(0.8)),
            F.when(n["kind"] == "IP", "ct_san_ip").otherwise("ct_san"),
        )

    def per_cert(issuer_confidence: float, names: Callable[[Column], Column]) -> Column:
        return F.flatten(
            F.transform(
                certs,
                lambda c: F.concat(
                    _list(
                        _anchored("Certificate", "covered_by_certificate", 0.9, "ct_certificate")(c["id"]),
                        F.when(
                            _present(c["issuer"]),
                            _edge(
                                "Certificate", c["id"], "issued_by", "Organization", c["issuer"], issuer_confidence,
                                "ct_issuer",
                            ),
                        ),
                        of=EDGE,
                    ),
                    _each(names(c), lambda n: san(c["id"], n), EDGE),
                ),
            )
        )

    edges = lambda: F.concat(_list(_email_of_target(), of=EDGE), per_cert(0.9, lambda c: c["names"]))
    links = lambda: per_cert(0.85, lambda c: F.filter(c["names"], lambda n: n["kind"] == "Subdomain"))
    return mentions, edges, links


def _header_mentions(headers: Column) -> Column:
    server = values.trimmed(F.coalesce(headers["server"], headers["Server"]))
    powered = F.coalesce(headers["x-powered-by"], headers["X-Powered-By"])
    product = F.regexp_extract(server, r"^([a-zA-Z]+)/(\d[\d.]*)", 1)
    version = F.regexp_extract(server, r"^([a-zA-Z]+)/(\d[\d.]*)", 2)
    name = F.when(product != "", F.concat(product, F.lit(" "), version)).otherwise(F.lower(server))
    return _list(
        F.when(_present(server), _mention("Technology", name, 0.9, verbatim=True)),
        F.when(
            _present(powered),
            _mention(
                "Technology", powered, 0.95, verbatim=True,
                entity=values.entity_id(F.lit("Technology"), F.lower(powered)),
            ),
        ),
        of=MENTION,
    )


def _http(p: Column):
    mentions = lambda: F.concat(
        F.coalesce(_header_mentions(p["headers"]), _list(of=MENTION)),
        F.coalesce(F.when(_present(p["title"]), _text_mentions(p["title"])), _list(of=MENTION)),
    )
    links = lambda: F.concat(
        _each(
            p["technologies"],
            lambda t: _anchored("Technology", "uses_technology", 0.85, "http_tech_detection")(_field(t, "name")),
            EDGE,
        ),
        _each(p["redirects"], lambda r: _anchored("URL", "links_to", 0.8, "http_redirect")(_field(r, "url")), EDGE),
    )
    return mentions, _no_edges, links


def _github_facts(p: Column) -> Column:
    """The blog of a profile as a URL, and everything that edges repeat."""
    login = F.coalesce(p["login"], p["profile"]["login"], F.col("target"))
    mail = F.coalesce(F.nullif(p["email"], F.lit("")), F.nullif(p["profile"]["email"], F.lit("")))
    org = F.coalesce(F.nullif(p["organization"], F.lit("")), F.nullif(p["profile"]["organization"], F.lit("")))
    orgs = F.array_distinct(
        F.concat(
            F.filter(F.array(org), _present),
            F.coalesce(
                F.filter(
                    F.transform(
                        p["organizations"],
                        lambda o: F.when(
                            o.startswith("{"),
                            F.coalesce(F.get_json_object(o, "$.login"), F.get_json_object(o, "$.name")),
                        ).otherwise(o),
                    ),
                    _present,
                ),
                F.array().cast("array<string>"),
            ),
        )
    )
    blog = values.trimmed(p["profile"]["blog"])
    link = values.url(F.when(blog.rlike("^https?://"), blog).otherwise(F.concat(F.lit("https://"), blog)))
    repos = F.filter(
        F.transform(
            p["repositories"],
            lambda r: F.struct(
                _field(r, "name").alias("name"),
                F.when(r.startswith("{"), F.nullif(F.get_json_object(r, "$.html_url"), F.lit(""))).alias("url"),
            ),
        ),
        lambda r: _present(r["name"]),
    )
    known = {"login": login, "mail": mail, "orgs": orgs, "repos": repos, "link": F.when(_present(blog), link)}
    return F.struct(*[c.alias(name) for name, c in known.items()])


def _github(p: Column):
    facts = F.col("_github_facts")
    login, mail, orgs, repos, link = (facts[k] for k in ("login", "mail", "orgs", "repos", "link"))
    host = F.regexp_replace(values.url_host(link), r"^www\.", "")
    mentions = lambda: F.concat(
        _list(
            _mention(
                "Username", login, 0.9, _properties(profile_url=F.concat(F.lit("https://github.com/"), login)), True
            ),
            F.when(mail.isNotNull(), _mention("Email", mail, 0.8)),
            F.when(link.isNotNull(), _mention("URL", link, 0.75, _properties(source=F.lit("github_blog")), True)),
            F.when(host.contains("."), _mention("Domain", host, 0.7, verbatim=True)),
            of=MENTION,
        ),
        _each(orgs, lambda o: _mention("Organization", o, 0.75, verbatim=True), MENTION),
        _each(repos, lambda r: _mention("Repository", r["name"], 0.85, _properties(profile_url=r["url"]), True), MENTION),
    )
    links = lambda: F.concat(
        _list(
            F.when(
                mail.isNotNull(),
                _edge("Username", login, "associated_with_email", "Email", values.email(mail), 0.8, "github_profile",
                      True),
            ),
            of=EDGE,
        ),
        _each(orgs, lambda o: _edge("Username", login, "member_of", "Organization", o, 0.75, "github_profile", True), EDGE),
        _each(
            repos,
            lambda r: _edge("Username", login, "owns_repository", "Repository", r["name"], 0.85, "github_repos", True),
            EDGE,
        ),
    )
    return mentions, _no_edges, links


def _profile(kind: str, name_field: str):
    """Profiles of one shape: a user name with a link, and what the adapter adds to it."""

    def build(p: Column):
        profile = p["profile"]
        ok = profile.isNotNull() & F.coalesce(p["found"], F.lit(False))
        user = _mention(
            "Username",
            F.coalesce(profile[name_field], F.col("target")),
            0.9,
            _properties(profile_url=profile["profile_url"]),
            True,
        )
        parts = [_list(user, of=MENTION)]
        if kind == "gitlab":
            parts += [
                _list(
                    F.when(_present(profile["email"]), _mention("Email", profile["email"], 0.8)),
                    F.when(
                        _present(profile["organization"]),
                        _mention("Organization", profile["organization"], 0.75, verbatim=True),
                    ),
                    of=MENTION,
                ),
                _each(p["projects"], lambda r: _mention("Repository", r["path"], 0.85, verbatim=True), MENTION),
                _each(p["groups"], lambda g: _mention("Organization", g["path"], 0.7, verbatim=True), MENTION),
            ]
        if kind == "keybase":
            proofs = F.filter(
                profile["social_proofs"], lambda s: _present(s["service"]) & _present(s["username"])
            )
            parts += [
                _list(
                    F.when(
                        _present(profile["full_name"]), _mention("Person", profile["full_name"], 0.7, verbatim=True)
                    ),
                    of=MENTION,
                ),
                _each(proofs, lambda s: _mention("Username", s["username"], 0.85, verbatim=True), MENTION),
                _list(
                    F.when(_present(profile["website"]), _mention("URL", profile["website"], 0.6, verbatim=True)),
                    of=MENTION,
                ),
            ]
        return lambda: F.when(ok, F.concat(*parts)), _no_edges, _no_edges

    return build


def _ip_asn(p: Column):
    number = values.asn(p["asn"])
    org = p["organization"]
    mentions = lambda: _list(
        _mention("IP", F.col("target"), 0.9),
        F.when(number != "", _mention("ASN", number, 0.88)),
        F.when(_present(org), _mention("Organization", org, 0.8, verbatim=True)),
        of=MENTION,
    )
    links = lambda: _list(
        F.when(number != "", _edge("IP", F.col("target"), "belongs_to_asn", "ASN", number, 0.9, "ip_to_asn")),
        F.when(_present(org), _edge("IP", F.col("target"), "operated_by", "Organization", org, 0.8, "ip_to_asn")),
        of=EDGE,
    )
    return mentions, _no_edges, links


def _threat(p: Column):
    score = F.coalesce(p["abuse_score"], p["abuseipdb"]["abuse_confidence_score"])
    threat = p["urlhaus"]["threat"]
    is_ip = values.is_ipv4(F.col("target")) | values.is_ipv6(F.col("target"))
    kind = F.when(is_ip, "IP").otherwise("Domain")
    link = F.when(~is_ip, F.concat(F.lit("https://"), F.col("_name")))
    abuse_key = F.concat(F.lit("abuse_score_"), score.cast("string"))
    urlhaus_key = F.concat(F.lit("urlhaus_"), threat)
    mentions = lambda: _list(
        _mention(kind, F.col("target"), 0.85, _properties(profile_url=link)),
        F.when(
            score > 50,
            _mention(
                "ThreatIndicator",
                F.concat(F.lit("AbuseIPDB score: "), score.cast("string"), F.lit("/100")),
                0.85,
                entity=values.entity_id(F.lit("ThreatIndicator"), abuse_key),
            ),
        ),
        F.when(
            _present(threat),
            _mention(
                "ThreatIndicator",
                F.concat(F.lit("URLhaus: "), threat),
                0.8,
                entity=values.entity_id(F.lit("ThreatIndicator"), urlhaus_key),
            ),
        ),
        of=MENTION,
    )

    def indicates(condition: Column, key: Column, confidence: float, method: str) -> Column:
        return F.when(
            condition,
            _edge(kind, F.col("target"), "associated_with_threat", "ThreatIndicator", key, confidence, method),
        )

    links = lambda: _list(
        indicates(score > 50, abuse_key, 0.85, "threat_intel_abuseipdb"),
        indicates(_present(threat), urlhaus_key, 0.8, "threat_intel_urlhaus"),
        of=EDGE,
    )
    return mentions, _no_edges, links


def _search(p: Column):
    found = p["extracted_entities"]
    asked = F.coalesce(p["query"], F.col("target"))
    mentions = lambda: F.concat(
        _each(
            found["domains"],
            lambda d: _mention(
                "Domain", d, 0.7,
                _properties(profile_url=F.concat(F.lit("https://"), F.lower(F.rtrim(values.trimmed(d), F.lit("."))))),
            ),
            MENTION,
        ),
        _each(found["emails"], lambda e: _mention("Email", e, 0.6), MENTION),
        _each(found["ips"], lambda i: _mention("IP", i, 0.6), MENTION),
        _list(
            F.when(
                p["result_count"] > 0,
                _mention(
                    "Domain",
                    F.concat(F.lit("Search results for: "), asked),
                    0.5,
                    verbatim=True,
                    entity=F.concat(F.lit("search_result:"), F.col("target"), F.lit(":"), asked),
                ),
            ),
            of=MENTION,
        ),
    )
    return mentions, _no_edges, _no_edges


def _account(p: Column):
    name = F.coalesce(p["username"], F.col("target"))
    platform, link, seen = p["platform"], p["url"], p["evidence"]
    personal = platform == fixed.PERSONAL_WEBSITE
    trust = F.coalesce(p["confidence"], F.lit(0.7))
    about = _properties(
        platform=platform,
        platform_key=p["platform_key"],
        profile_url=link,
        title=seen["title"],
        snippet=seen["snippet"],
        source_type=F.coalesce(seen["source"], F.lit("platform_probe")),
    )
    short = _properties(platform=platform, profile_url=link, title=seen["title"])
    site = _properties(platform=platform, title=seen["title"], domain=seen["domain"])
    mentions = lambda: _list(
        _mention("Username", name, trust, about, True),
        F.when(platform.isin(fixed.PROFESSIONAL_PLATFORMS), _mention("Person", name, trust, short, True)),
        F.when(personal, _mention("URL", link, F.coalesce(p["confidence"], F.lit(0.75)), site, True)),
        F.when(
            _present(link) & ~F.coalesce(personal, F.lit(False)),
            _mention("URL", link, trust, _properties(platform=platform), True),
        ),
        of=MENTION,
    )
    edges = lambda: _list(
        F.when(
            _present(link) & ~F.coalesce(personal, F.lit(False)),
            _edge("Username", name, "has_account_on", "URL", link, trust, "username_probe", True),
        ),
        of=EDGE,
    )
    ok = F.coalesce(p["found"], F.lit(False))
    return lambda: F.when(ok, mentions()), lambda: F.when(ok, edges()), _no_edges


ADAPTERS: dict[str, Callable[[Column], tuple[Callable[[], Column], ...]]] = {
    "dns": _dns,
    "whois": _whois,
    "certificate_transparency": _ct,
    "http": _http,
    "github": _github,
    "gitlab": _profile("gitlab", "username"),
    "keybase": _profile("keybase", "username"),
    "reddit": _profile("reddit", "name"),
    "hackernews": _profile("hackernews", "username"),
    "ip_to_asn": _ip_asn,
    "threat_intel": _threat,
    "search": _search,
    "username_probe": _account,
}
# These describe a domain: without a usable one the observation yields nothing.
_NEED_ANCHOR = ["dns", "whois", "certificate_transparency"]
#: Adapters that ask for the name of the target.
_NAMED = [*_NEED_ANCHOR, "threat_intel"]
# Computed once per payload, for all that is built from it.
_FACTS: dict[str, Callable[[Column, int | None], Column]] = {
    "dns": lambda p, _: _dns_facts(p),
    "whois": lambda p, _: _name_servers(p),
    "certificate_transparency": _ct_facts,
    "github": lambda p, _: _github_facts(p),
}
#: What an adapter builds: mentions, edges that the payload states, edges that hold only between known entities. And the
#: account that any payload with a profile describes.
MENTIONED, STATED, LINKED, ACCOUNT = 0, 1, 2, 3


# --- jobs --------------------------------------------------------------------------------------------------------


def _prepared(obs: DataFrame) -> DataFrame:
    """Adds what the adapters need to know about the target, and whether there is a payload."""
    target = F.col("target")
    host = F.when(F.col("_is_email"), values.trimmed(F.substring_index(target, "@", -1))).otherwise(target)
    is_ip = (F.col("source_adapter") == "dns") & (values.is_ipv4(F.col("_anchor")) | values.is_ipv6(F.col("_anchor")))
    return (
        obs.withColumn("_said", ~F.coalesce(F.trim("raw_response"), F.lit("")).isin("", "{}", "null", "[]"))
        .withColumn("_is_email", target.contains("@") & (_target_kind("target") == "email"))
        .withColumn("_anchor", host)
        .withColumn("_anchor_type", F.when(is_ip, "IP").otherwise("Domain"))
        .withColumn("_name", F.when(F.col("source_adapter").isin(_NAMED), _domain_of("_anchor")).otherwise(""))
    )


def _parsed(adapter: str) -> Column:
    return F.from_json(F.col("raw_response"), PAYLOADS[adapter])


@built_once
def _arrays_of(which: tuple[int, ...], adapter: str) -> Column:
    """The arrays of items that one adapter builds; null where the target is unusable."""
    parts = ADAPTERS[adapter](F.col(f"_{adapter}"))
    arrays = F.array(*[parts[k]().cast(f"array<{ITEM}>") for k in which if k != ACCOUNT])
    if adapter in _NEED_ANCHOR:
        arrays = F.when((F.col("_name") != "") | (F.col("_anchor_type") == "IP"), arrays)
    return arrays


@built_once
def _scanned(col: str) -> Column:
    return _text_mentions(F.col(col)).cast(f"array<{ITEM}>")


@built_once
def _standard(kind: str, raw: str, verbatim: str) -> Column:
    """The value of a mention or an end of an edge."""
    return F.when(F.col(verbatim), F.col(raw)).otherwise(values.entity_value(F.col(kind), F.col(raw)))


@built_once
def _target_kind(col: str) -> Column:
    return values.target_type(F.col(col))


@built_once
def _domain_of(col: str) -> Column:
    return values.domain(F.col(col))


def _items(
    obs: DataFrame, which: tuple[int, ...], adapters: list[str], generic: bool, max_certs: int | None
) -> DataFrame:
    """The items of the wanted kinds in all payloads, each payload parsed once: (investigation_id, observation_id,
    source, seen_at, what, and the fields of ITEM)."""
    rows = _prepared(obs)
    source, said = F.col("source_adapter"), F.col("_said")
    if LINKED not in which:
        rows = rows.where(said)
    if not generic or which == (STATED,):
        # Only the named adapters state edges, so other payloads need not be looked at for them.
        rows = rows.where(source.isin(adapters))
    rows = rows.withColumns({f"_{a}": F.when(said & (source == a), _parsed(a)) for a in adapters})
    facts = {f"_{a}_facts": F.when(source == a, _FACTS[a](F.col(f"_{a}"), max_certs)) for a in adapters if a in _FACTS}
    rows = rows.withColumns(facts) if facts else rows
    built = [k for k in which if k != ACCOUNT]
    none = F.lit(None).cast(f"array<{ITEM}>")
    chosen = F.when(~said, F.lit(None).cast(f"array<array<{ITEM}>>"))
    for name in adapters:
        chosen = chosen.when(source == name, _arrays_of(which, name))
    if generic:
        chosen = chosen.otherwise(F.array(*[_scanned("raw_response") if k == MENTIONED else none for k in built]))
    lists = [F.struct(F.lit(k).alias("what"), F.get("_arrays", F.lit(i)).alias("items")) for i, k in enumerate(built)]
    # What holds of any observation by its target alone.
    if MENTIONED in which and generic:
        lost = source.isin(_NEED_ANCHOR) & (F.col("_name") == "")
        alone = said & F.col("_is_email") & (~source.isin(_NEED_ANCHOR) | lost)
        named = F.when(alone, F.array(_mention("Email", F.col("target"), 1.0)).cast(f"array<{ITEM}>"))
        lists.append(F.struct(F.lit(MENTIONED).alias("what"), named.alias("items")))
    if LINKED in which and generic:
        own = F.when(F.col("_is_email"), F.array(_target_link()).cast(f"array<{ITEM}>"))
        lists.append(F.struct(F.lit(LINKED).alias("what"), own.alias("items")))
    if ACCOUNT in which:
        rows = rows.withColumn("_account", _profile_in("raw_response"))
        lists.append(F.struct(F.lit(ACCOUNT).alias("what"), _account_item().alias("items")))
    keys = [
        "investigation_id",
        F.col("id").alias("observation_id"),
        F.col("source_adapter").alias("source"),
        F.col("collected_at").alias("seen_at"),
    ]
    found = rows.withColumn("_arrays", chosen).select(*keys, F.inline(F.array(*lists)))
    return found.select("investigation_id", "observation_id", "source", "seen_at", "what", F.inline("items"))


def _profile_in(col: str) -> Column:
    return F.when(F.col(col).contains('"profile"'), F.from_json(F.col(col), PROFILE))


def _account_item() -> Column:
    """The account that a found profile describes; its fields are properties."""
    fields = F.create_map(*[x for name, f in profile_fields(F.col("_account.profile")).items() for x in (F.lit(name), f)])
    item = _mention("Account", F.lit("account"), F.coalesce("confidence", F.lit(0.5)), fields, True)
    there = F.col("_account.profile").isNotNull() & F.coalesce("_account.found", F.lit(False))
    return F.when(there, F.array(item).cast(f"array<{ITEM}>"))


def _target_link() -> Column:
    """An email target and its own domain."""
    domain = F.substring_index(F.col("target"), "@", -1)
    return _edge("Email", F.col("target"), "associated_with_email", "Domain", domain, 1.0, "target_email_domain")


def _standardized(items: DataFrame) -> DataFrame:
    """Items with standard values and ids: a mention's value and id; an edge's ends as source_id and target_id."""
    known = F.col("source").isin(list(ADAPTERS)) | (F.col("what") == ACCOUNT)
    source = F.when(known, F.col("source")).otherwise("generic")
    is_edge = F.col("rel").isNotNull()
    ends = items.withColumnsRenamed({"id": "stated_id"}).withColumns(
        {"value": _standard("type", "raw", "verbatim"), "_tgt": F.when(is_edge, _standard("tgt_type", "tgt_raw", "verbatim"))}
    )
    ends = ends.where((F.col("value") != "") & (~is_edge | (F.col("_tgt") != "")))
    own_id = F.coalesce("stated_id", values.entity_id(F.col("type"), F.col("value")))
    return ends.select(
        "investigation_id", "observation_id", source.alias("source"), "seen_at", "what", own_id.alias("own_id"), "type",
        "value", "confidence", "properties", "rel",
        F.when(is_edge, values.entity_id(F.col("tgt_type"), F.col("_tgt"))).alias("target_id"), "method",
        F.lit(None).cast("string").alias("edge_id"),
    )


def mentions_of(said: DataFrame) -> DataFrame:
    """The mentions among standardized items."""
    return said.where(F.col("what") == MENTIONED).select(
        "investigation_id", "observation_id", "source", "seen_at", F.col("own_id").alias("id"), "type", "value",
        "confidence", "properties",
    )


def edges_of(said: DataFrame, what: int = STATED) -> DataFrame:
    """The stated edges, or the ones between known entities, among standardized items."""
    return said.where(F.col("what") == what).select(
        "investigation_id",
        "observation_id",
        "seen_at",
        F.coalesce("edge_id", F.concat_ws(":", "own_id", "rel", "target_id")).alias("id"),
        F.col("own_id").alias("source_id"),
        "target_id",
        F.col("rel").alias("relationship_type"),
        "confidence",
        "method",
    )


def accounts_of(said: DataFrame) -> DataFrame:
    """The accounts among standardized items, as ``accounts.accounts`` has them."""
    names = ("username", "full_name", "email", "bio", "organization", "website", "location", "profile_url")
    return said.where(F.col("what") == ACCOUNT).select(
        "investigation_id", "observation_id", F.col("source").alias("platform"),
        *[F.col("properties")[x].alias(x) for x in names], "confidence",
    )


def said_in(
    obs: DataFrame,
    which: tuple[int, ...] = (MENTIONED, STATED, LINKED, ACCOUNT),
    adapters: list[str] | None = None,
    max_certs: int | None = None,
) -> DataFrame:
    """All that the observations say, one row per mention, stated edge, link and account, in one pass: ``mentions_of``,
    ``edges_of`` and ``accounts_of`` take it apart. Unknown adapters are read as text; own extractors (``register_extractor``) add theirs.

    ``adapters`` names the built-in adapters that occur, which keeps the plan small; by default all are planned for.
    """
    said = _by_adapters(obs, which, adapters, max_certs)
    for more in _by_own_extractors(obs, which):
        said = said.unionByName(more)
    return said


#: Observations that a task should take in, when they are dealt by their id.
_OBSERVATIONS_PER_TASK = 100_000


def said_by_observation(obs: DataFrame, adapters: list[str] | None = None) -> DataFrame:
    """``said_in`` with all that an observation says in one task. Payloads are dealt by the id of their observation, instead
    of the many rows that are made from them; of own extractors, which may say anything, the rows."""
    least = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, obs.count() // _OBSERVATIONS_PER_TASK)
    which = (MENTIONED, STATED, LINKED, ACCOUNT)
    said = _by_adapters(obs.repartition(tasks, "id"), which, adapters, None)
    theirs = _by_own_extractors(obs, which)
    if theirs:
        said = said.unionByName(reduce(DataFrame.unionByName, theirs).repartition(tasks, "observation_id"))
    return said


def _by_adapters(
    obs: DataFrame, which: tuple[int, ...], adapters: list[str] | None, max_certs: int | None
) -> DataFrame:
    """What the built-in adapters find, and the scan of payloads of unknown ones."""
    planned = list(ADAPTERS) if adapters is None else adapters
    own = obs.where(~F.col("source_adapter").isin(list(_CUSTOM))) if _CUSTOM else obs
    return _standardized(_items(own, which, planned or ["dns"], True, max_certs))


def _by_own_extractors(obs: DataFrame, which: tuple[int, ...]) -> list[DataFrame]:
    """What own extractors find, and the accounts and links that any observation has."""
    found = []
    empty = F.lit(None).cast("string")
    for name, extractor in _CUSTOM.items():
        theirs = obs.where(F.col("source_adapter") == name)
        mentions, edges = extractor(theirs)
        if ACCOUNT in which:
            rows = theirs.withColumn("_account", _profile_in("raw_response"))
            found.append(
                _standardized(
                    rows.select(
                        "investigation_id", F.col("id").alias("observation_id"), F.col("source_adapter").alias("source"),
                        F.col("collected_at").alias("seen_at"), F.lit(ACCOUNT).alias("what"), F.inline(_account_item()),
                    )
                )
            )
        if LINKED in which:
            mail = theirs.where(_target_kind("target") == "email").select(
                "investigation_id", F.col("id").alias("observation_id"), F.col("source_adapter").alias("source"),
                F.col("collected_at").alias("seen_at"), F.lit(LINKED).alias("what"),
                F.inline(F.array(_target_link()).cast(f"array<{ITEM}>")),
            )
            found.append(_standardized(mail))
        if MENTIONED in which:
            more = dict.fromkeys(("rel", "target_id", "method", "edge_id"), empty)
            rows = mentions.withColumns({"what": F.lit(MENTIONED)} | more)
            found.append(rows.withColumnRenamed("id", "own_id"))
        if STATED in which:
            more = {"what": F.lit(STATED), "source": F.lit(name), "type": empty, "value": empty}
            rows = edges.withColumns(more | {"properties": F.lit(None).cast("map<string,string>")})
            renamed = {"id": "edge_id", "source_id": "own_id", "relationship_type": "rel"}
            found.append(rows.withColumnsRenamed(renamed))
    return found


Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
_CUSTOM: dict[str, Extractor] = {}


def register_extractor(adapter: str, extractor: Extractor) -> None:
    """Adds an adapter: a function from its observations to (mentions, edges)."""
    _CUSTOM[adapter] = extractor


def unregister_extractor(adapter: str) -> None:
    """Takes an added adapter away; its observations are read as text again."""
    _CUSTOM.pop(adapter, None)


def _adapter_job(*adapters: str) -> Callable[..., tuple[DataFrame, DataFrame]]:
    def job(obs: DataFrame, max_certs: int | None = None) -> tuple[DataFrame, DataFrame]:
        def of(what: int) -> DataFrame:
            return _standardized(_items(obs, (what,), list(adapters), False, max_certs))

        return mentions_of(of(MENTIONED)), edges_of(of(STATED))

    return job


extract_dns = _adapter_job("dns")
extract_whois = _adapter_job("whois")
extract_ct = _adapter_job("certificate_transparency")
extract_http = _adapter_job("http")
extract_github = _adapter_job("github")
extract_gitlab = _adapter_job("gitlab")
extract_keybase = _adapter_job("keybase")
extract_profiles = _adapter_job("reddit", "hackernews")
extract_ip_asn = _adapter_job("ip_to_asn")
extract_threat = _adapter_job("threat_intel")
extract_search = _adapter_job("search")
extract_accounts = _adapter_job("username_probe")


def extract_generic(obs: DataFrame) -> DataFrame:
    """Free-text scan of the whole payload of observations from unknown adapters."""
    unknown = obs.where(~F.col("source_adapter").isin(list(ADAPTERS)))
    return mentions_of(_standardized(_items(unknown, (MENTIONED,), ["dns"], True, None)))


def present_adapters(obs: DataFrame) -> list[str]:
    """Which of the built-in adapters occur in the observations."""
    known = obs.where(F.col("source_adapter").isin(list(ADAPTERS))).select("source_adapter").distinct()
    return sorted(r.source_adapter for r in known.collect())


def extract_all(
    obs: DataFrame, max_certs: int | None = None, adapters: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Mentions and edges of every observation, each adapter by its own rule, unknown ones as text.

    Either table is a pass of its own, so that a caller who wants one builds one; ``said_in`` gives all in one pass.
    """
    mentions = mentions_of(said_in(obs, (MENTIONED,), adapters, max_certs))
    stating = [a for a in [*_NEED_ANCHOR, "username_probe"] if adapters is None or a in adapters]
    return mentions, edges_of(said_in(obs, (STATED,), stating, max_certs))


def rejected_observations(obs: DataFrame) -> DataFrame:
    """Observations whose payload is no JSON: extraction yields nothing for them."""
    return obs.where(F.try_parse_json("raw_response").isNull() & (F.coalesce("raw_response", F.lit("")) != ""))


def link_candidates(obs: DataFrame, adapters: list[str]) -> DataFrame:
    """Edges of these adapters that count only between known entities, see linkloom.operators.link."""
    return edges_of(_standardized(_items(obs, (LINKED,), adapters, False, None)), LINKED)


def extract_header_tech(obs: DataFrame, headers_col: str = "headers") -> DataFrame:
    """Technologies named by the Server and X-Powered-By headers: adds rows of ``type``, ``value``, ``id``."""
    keys = [c for c in obs.columns if c != headers_col]
    rows = obs.select(*keys, F.inline(_header_mentions(F.col(headers_col))))
    # the struct has an id of its own
    names = ("type", "value", "confidence", "properties", "verbatim", "stated_id", "rel", "tgt_type", "tgt_raw", "method")
    flat = rows.toDF(*keys, *names)
    return flat.select(
        *keys,
        F.coalesce("stated_id", values.entity_id(F.col("type"), F.col("value"))).alias("technology_id"),
        F.col("value").alias("technology"),
        "confidence",
    )


def detect_technologies(df: DataFrame, key_cols: list[str], headers_col: str, cookies_col: str) -> DataFrame:
    """Technologies by header substring and by exact cookie name: ``name``, ``source``, ``version`` per page.

    The pattern lists are constants of a few dozen entries, so they are matched inside the row, not joined.
    """
    headers = F.map_from_entries(
        F.transform(F.map_entries(headers_col), lambda e: F.struct(F.lower(e["key"]), F.lower(e["value"])))
    )
    rows = df.withColumn("_h", headers)
    hits = []
    for header, patterns in fixed.HEADER_TECHNOLOGIES.items():
        text = F.col("_h")[header]
        version = F.regexp_extract(text, r"\d+\.\d+(?:\.\d+)?", 0)
        for pattern, name in patterns.items():
            found = F.struct(
                F.lit(name).alias("name"), F.lit(f"header:{header}").alias("source"), version.alias("version")
            )
            hits.append(F.when(text.contains(pattern), found))
    known = F.create_map(*[F.lit(x) for pair in fixed.COOKIE_TECHNOLOGIES.items() for x in pair])
    by_cookie = F.transform(
        F.coalesce(F.col(cookies_col), F.array().cast("array<string>")),
        lambda c: F.when(
            F.try_element_at(known, c).isNotNull(),
            F.struct(
                F.try_element_at(known, c).alias("name"), F.lit("cookie").alias("source"), F.lit("").alias("version")
            ),
        ),
    )
    every = F.filter(F.concat(F.array(*hits), by_cookie), lambda h: h.isNotNull())
    return rows.select(*key_cols, F.inline(every))


def ct_first_entries(entries: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Raw certificate rows: the first one per certificate id."""
    window = W.partitionBy(*key_cols, "id").orderBy(*order_cols)
    kept = entries.where(F.col("id").isNotNull()).withColumn("_n", F.row_number().over(window))
    return kept.where(F.col("_n") == 1).drop("_n")


def ct_subdomains(obs: DataFrame) -> DataFrame:
    """Distinct names under the target domain in all certificates, '*.' removed."""
    rows = obs.where(F.col("source_adapter") == "certificate_transparency").select(
        "investigation_id", "target", F.explode(_parsed("certificate_transparency")["certificates"]).alias("c")
    )
    base = F.lower(F.btrim(F.col("target"), F.lit(".")))
    name = F.regexp_replace(F.lower(values.trimmed(F.col("line"))), r"^\*\.", "")
    return (
        rows.select("investigation_id", "target", F.explode(F.split("c.name_value", "\n")).alias("line"))
        .select("investigation_id", "target", base.alias("_base"), name.alias("subdomain"))
        .where(F.col("subdomain").endswith(F.concat(F.lit("."), "_base")) | (F.col("subdomain") == F.col("_base")))
        .drop("_base")
        .distinct()
    )
