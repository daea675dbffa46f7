"""Column rules for single values: what a string is, and its standard form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import fixed

# A word edge as Unicode sees it, so that a letter with an accent is part of the word next to it.
_WORD = r"[\p{L}\p{N}_]"
WORD_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
WORD_START = rf"(?<!{_WORD})"
WORD_END = rf"(?!{_WORD})"


def trimmed(value: Column) -> Column:
    return F.btrim(value, F.lit(fixed.WHITESPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Names an intermediate value, so that it is written and evaluated once however often it is used."""
    return F.transform(F.array(value), use)[0]


def alternation(words: list[str]) -> str:
    """A pattern that matches any of the literal words."""
    special = set(r"\.[]{}()*+?^$|")
    return "|".join("".join("\\" + c if c in special else c for c in word) for word in words)


def _ipv6_pattern() -> str:
    """All written forms of an IPv6 address: eight groups, or fewer around one '::', the last two maybe dotted."""
    group = r"[0-9a-fA-F]{1,4}"
    dotted = rf"{fixed.STRICT_OCTET}(?:\.{fixed.STRICT_OCTET}){{3}}"
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{dotted}"]
    for left in range(8):
        head = rf"{group}(?::{group}){{{left - 1}}}" if left else ""
        room = 7 - left
        tail = rf"(?:{group}(?::{group}){{0,{room - 1}}})?" if room else ""
        forms.append(f"{head}::{tail}")
        if room >= 2:
            forms.append(rf"{head}::(?:{group}:){{0,{room - 2}}}{dotted}")
    return "^(?:" + "|".join(forms) + ")$"


IPV6_VALID = _ipv6_pattern()
# Without end anchors this also accepts text that merely starts like an address.
IPV6_LOOSE = r"^(?:(?:[0-9a-fA-F]{1,4}:){1,7}:|::)"
IPV4_VALID = rf"^{fixed.STRICT_OCTET}(?:\.{fixed.STRICT_OCTET}){{3}}$"


def is_ipv4(value: Column) -> Column:
    return F.coalesce(trimmed(value).rlike(IPV4_VALID), F.lit(False))


def is_ipv6(value: Column) -> Column:
    # The pattern is long, and most values hold no colon.
    return F.coalesce(value.contains(":") & trimmed(value).rlike(IPV6_VALID), F.lit(False))


def ip_version(value: Column) -> Column:
    return F.when(is_ipv4(value), 4).when(is_ipv6(value), 6)


def target_type(value: Column, strict: bool = True) -> Column:
    """The kind of a target string; the first rule that holds decides."""
    text = trimmed(value)
    ipv6 = text.rlike(IPV6_VALID)
    if not strict:
        ipv6 = ipv6 | text.rlike(IPV6_LOOSE)
    return (
        F.when(text.isNull() | (text == ""), "unknown")
        .when(text.rlike(fixed.EMAIL_TARGET), "email")
        .when(text.rlike(fixed.URL_TARGET), "url")
        .when(text.rlike(fixed.IPV4_TARGET), "ip")
        .when(ipv6, "ip")
        .when(text.rlike(fixed.DOMAIN_TARGET), "domain")
        .otherwise("username")
    )


def domain(value: Column) -> Column:
    """Lower-case ASCII name without final dots; '' when it is not a domain."""
    plain = F.lower(F.rtrim(trimmed(value), F.lit(".")))
    # Internationalized names take the JVM's own IDNA conversion; plain names never reach it.
    foreign = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), plain)
    name = F.when(plain.rlike(r"[^\x00-\x7F]"), foreign).otherwise(plain)
    return F.when(name.rlike(fixed.DOMAIN_VALID), name).otherwise("")


def ipv6(value: Column) -> Column:
    """Shortest form: the first of the longest runs of two or more zero groups becomes '::'."""
    dotted = r"(\d+)\.(\d+)\.(\d+)\.(\d+)$"

    def undotted(text: Column) -> Column:
        """A dotted tail as two groups."""
        octet = [F.regexp_extract(text, dotted, i).cast("int") for i in range(1, 5)]
        tail = F.concat(F.hex(octet[0] * 256 + octet[1]), F.lit(":"), F.hex(octet[2] * 256 + octet[3]))
        return F.when(text.contains("."), F.concat(F.regexp_replace(text, dotted, ""), tail)).otherwise(text)

    def filled(text: Column) -> Column:
        """All eight groups as ':a:b:...:h:'."""
        groups = F.size(F.filter(F.split(text, ":"), lambda g: g != ""))
        whole = F.replace(text, F.lit("::"), F.concat(F.repeat(F.lit(":0"), F.lit(8) - groups), F.lit(":")))
        parts = F.transform(
            F.split(F.btrim(whole, F.lit(":")), ":"), lambda g: F.lower(F.regexp_replace(g, r"^0+(?=.)", ""))
        )
        return F.concat(F.lit(":"), F.array_join(parts, ":"), F.lit(":"))

    def shortened(line: Column) -> Column:
        runs = F.filter(
            F.transform(F.sequence(F.lit(8), F.lit(2)), lambda n: F.concat(F.repeat(F.lit(":0"), n), F.lit(":"))),
            lambda run: F.contains(line, run),
        )

        def cut(run: Column) -> Column:
            at = F.instr(line, run)
            head = F.substring(line, F.lit(2), F.greatest(at - 2, F.lit(0)))
            rest = F.rtrim(F.substring(line, at + F.length(run), F.length(line)), F.lit(":"))
            return F.concat(head, F.lit("::"), rest)

        return F.coalesce(F.try_element_at(F.transform(F.slice(runs, 1, 1), cut), F.lit(1)), F.btrim(line, F.lit(":")))

    return let(let(undotted(value), filled), shortened)


def ip(value: Column) -> Column:
    """Canonical address; text that is no address is only lower-cased."""
    numbers = r"^\d{1,9}(?:\.\d{1,9}){3}$"

    def plain(text: Column) -> Column:
        shown = F.regexp_replace(text, r"(^|\.)0+(?=\d)", "$1")
        return F.when(text.rlike(numbers) & shown.rlike(IPV4_VALID), shown).otherwise(F.lower(text))

    text = trimmed(value)
    return F.when(text.contains(":") & text.rlike(IPV6_VALID), ipv6(text)).otherwise(let(text, plain))


def email(value: Column) -> Column:
    return F.lower(trimmed(value))


def is_email(value: Column) -> Column:
    return F.coalesce(email(value).rlike(fixed.EMAIL_VALID), F.lit(False))


_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_host(value: Column) -> Column:
    """Lower-case host of a URL without user part and port."""
    netloc = F.regexp_extract(value, _URL, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", ""))


def url(value: Column) -> Column:
    """Lower-case scheme and host, no default port, no user part, no slash at the end of the path."""
    names = ["scheme", "netloc", "path", "query", "fragment"]
    pieces = F.struct(*[F.regexp_extract(value, _URL, i + 1).alias(n) for i, n in enumerate(names)])

    def with_port(u: Column) -> Column:
        netloc = F.regexp_replace(u["netloc"], r"^.*@", "")
        text = F.regexp_extract(netloc, r":([^:\]]*)$", 1)
        return F.struct(
            F.lower(u["scheme"]).alias("scheme"),
            F.lower(F.regexp_replace(netloc, r":[^:\]]*$|[\[\]]", "")).alias("host"),
            text.alias("port"),
            # ';parameters' of the last path segment keep their place behind the shortened path
            F.regexp_extract(u["path"], r"^(?:.*/)?[^;/]*(;[^/]+)$", 1).alias("parameters"),
            u["path"].alias("path"),
            F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise("").alias("query"),
            F.when(u["fragment"] != "", F.concat(F.lit("#"), u["fragment"])).otherwise("").alias("fragment"),
        )

    def built(u: Column) -> Column:
        number = u["port"].try_cast("int")
        default = F.concat_ws(":", u["scheme"], number.cast("string")).isin("http:80", "https:443") | (number == 0)
        path = F.substring(u["path"], F.lit(1), F.length(u["path"]) - F.length(u["parameters"]))
        port = F.when(default | (u["port"] == ""), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        return F.when(
            (u["port"] == "") | number.between(0, 65535),
            F.concat(
                u["scheme"], F.lit("://"), u["host"], F.coalesce(port, F.lit("")), F.rtrim(path, F.lit("/")),
                u["parameters"], u["query"], u["fragment"],
            ),
        )

    return F.coalesce(let(let(pieces, with_port), built), F.lower(trimmed(value)))


def standard_target(value: Column, kind: Column) -> Column:
    """The standard form of a target of a known kind."""
    text = trimmed(value)
    return (
        F.when(kind == "domain", domain(text))
        .when(kind == "ip", ip(text))
        .when(kind == "email", email(text))
        .when(kind == "url", url(text))
        .when(kind == "username", F.lower(text))
        .otherwise(text)
    )


def asn(value: Column) -> Column:
    """AS<number> from a provider's ASN field, or ''."""
    digits = F.regexp_extract(F.upper(trimmed(value)), r"^(?:AS\s*)?(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit("AS"), digits)).otherwise("")


def entity_value(kind: Column, value: Column) -> Column:
    """The standard form of an extracted value of an entity type."""
    text = trimmed(value)
    upper = F.upper(text)
    return (
        F.when(text == "", "")
        .when(kind == "IP", ip(text))
        .when(kind.isin("Domain", "Subdomain"), domain(text))
        .when(kind == "Email", email(text))
        .when(kind == "URL", url(text))
        .when(kind == "ASN", F.when(upper.startswith("AS"), upper).otherwise(F.concat(F.lit("AS"), upper)))
        .when(kind == "Technology", F.lower(text))
        .otherwise(text)
    )


def entity_id(kind: Column, value: Column) -> Column:
    return F.concat(F.lower(kind), F.lit(":"), value)


def id_type(entity: Column) -> Column:
    return F.substring_index(entity, ":", 1)


def id_value(entity: Column) -> Column:
    """Everything after the first ':'; the whole text when there is none."""
    return F.when(entity.contains(":"), F.regexp_extract(entity, r"(?s)^[^:]*:(.*)$", 1)).otherwise(entity)


def is_redacted(value: Column) -> Column:
    return F.lower(value).rlike(alternation(fixed.REDACTED_WORDS))


def issuer_organization(name: Column) -> Column:
    """The O= part of a distinguished name, else its CN= part, else null."""

    def part(key: str) -> Column:
        found = F.regexp_extract(name, rf"(?i)(?:^|,)\s*{key} ?=\s*([^,]*)", 1)
        return F.nullif(trimmed(found), F.lit(""))

    return F.coalesce(part("O"), part("CN"))


def ipv4_number(value: Column) -> Column:
    """An IPv4 address as a number; null for other text."""
    parts = F.split(value, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
    return F.when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), number)


def comparison_key(kind: Column, value: Column) -> Column:
    """A looser form of a value for comparing names; one company ending of each kind is dropped, in list order."""
    text = F.lower(trimmed(value))
    company = text
    for ending in fixed.COMPANY_ENDINGS:
        company = trimmed(F.regexp_replace(company, ending.replace(" ", r"\s") + "$", ""))
    return (
        F.when(kind == "Organization", F.regexp_replace(company, r"[.,']", ""))
        .when(kind == "Username", F.regexp_replace(text, r"[_\-.]", ""))
        .when(kind == "Email", F.substring_index(text, "@", 1))
        .otherwise(text)
    )


_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"


def timestamp(value: Column) -> Column:
    """A timestamp from any of the known notations, in UTC; null when none fits."""
    text = trimmed(value)

    def fits(pattern: str, reading: Column) -> Column:
        return F.when(text.rlike(pattern), reading)

    def read(fmt: str, source: Column = text) -> Column:
        return F.try_to_timestamp(source, F.lit(fmt))

    without_weekday = F.regexp_replace(F.regexp_replace(text, r"^[A-Z][a-z]{2},\s+", ""), r"\s+", " ")
    return F.coalesce(
        fits(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?$", text.try_cast("timestamp")),
        fits(
            r"^[A-Z][a-z]{2},\s+\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}\s+\d{2}:\d{2}:\d{2}\s+[+-]\d{4}$",
            read("d MMM yyyy HH:mm:ss Z", without_weekday),
        ),
        fits(rf"^(?:{_MONTHS})\s+\d{{1,2}},\s+\d{{4}}$", read("MMM d, yyyy", F.regexp_replace(text, r"\s+", " "))),
        fits(rf"^\d{{1,2}}-(?:{_MONTHS})-\d{{4}}$", read("d-MMM-yyyy")),
        fits(r"^\d{10}$", F.timestamp_seconds(text.try_cast("bigint"))),
        fits(r"^\d{13}$", F.timestamp_millis(text.try_cast("bigint"))),
        fits(r"^\d{4}-\d{2}-\d{2}$", read("yyyy-MM-dd")),
        fits(r"^\d{2}/\d{2}/\d{4}$", read("dd/MM/yyyy")),
        fits(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?$", text.try_cast("timestamp")),
    )


def redacted(value: Column, limit: int | None = None) -> Column:
    """Text without secrets, file paths, internal addresses and connection strings."""
    text = F.regexp_replace(value, fixed.SECRET_TEXT, "$1=[REDACTED]")
    text = F.regexp_replace(text, fixed.WINDOWS_PATH, "[path]")
    text = F.regexp_replace(text, fixed.UNIX_PATH, "[path]")
    text = F.regexp_replace(text, WORD_START + fixed.INTERNAL_IP, "[internal]")
    for pattern, label in fixed.CONNECTION_STRINGS.items():
        text = F.regexp_replace(text, pattern, label)
    text = F.coalesce(text, F.lit(""))
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def availability(status: Column) -> Column:
    """What an HTTP status says about a source."""
    return (
        F.when(status.between(200, 299), "available")
        .when(status.isin(301, 302, 307, 308), "redirected")
        .when(status == 403, "access_denied")
        .when(status == 404, "not_found")
        .when(status == 401, "auth_required")
        .when(status == 429, "rate_limited")
        .when(status.between(500, 599), "temporarily_unavailable")
        .otherwise("unknown")
    )


def evidence_tier(method: Column) -> Column:
    return F.when(method == "api", "high").when(method == "direct_http", "medium").otherwise("low")


def page_title(html: Column) -> Column:
    """Text of the first title element; one with markup inside counts as none."""
    return trimmed(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title\s*>", 1))
