"""STIX 2.1 objects from entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed


def uuid5(name: Column, namespace: str = fixed.STIX_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def stix_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("--"), uuid5(F.concat(kind, F.lit(":"), value)))


def _named(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def to_stix(ents: DataFrame, rels: DataFrame, as_of: Column) -> DataFrame:
    """One row per STIX object: investigation_id, bundle_id, id, type, object (JSON).

    The objects of a bundle share its id; writing them by bundle gives one file set per investigation.
    """
    at = F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")
    inv = F.col("investigation_id")
    bundle = F.concat(F.lit("bundle--"), uuid5(F.concat(F.lit("bundle:"), inv)))
    kind = _named(fixed.STIX_OBJECT_TYPES, F.col("type"), "domain-name")
    typed = ents.withColumn("_kind", kind).withColumn(
        "_sid", stix_id(F.col("_kind"), F.concat_ws(":", inv, F.col("value")))
    )
    k, value = F.col("_kind"), F.col("value")
    identity, indicator = k == "identity", k == "indicator"
    number = F.coalesce(F.regexp_extract(F.upper(value), r"^AS(\d+)$", 1).try_cast("bigint"), F.lit(0))
    # to_json leaves null fields out, so every object shows only the fields of its type
    body = F.struct(
        k.alias("type"),
        F.lit("2.1").alias("spec_version"),
        F.col("_sid").alias("id"),
        at.alias("created"),
        at.alias("modified"),
        F.when(k.isin("domain-name", "ipv4-addr", "email-addr", "url"), value).alias("value"),
        F.when(k.isin("identity", "software", "autonomous-system"), value).alias("name"),
        F.when(identity, F.when(F.col("type") == "Person", "individual").otherwise("organization")).alias(
            "identity_class"
        ),
        F.when(k == "autonomous-system", number).alias("number"),
        F.when(indicator, F.concat(F.lit("[artifact:payload_bin = '"), value, F.lit("']"))).alias("pattern"),
        F.when(indicator, F.lit("stix")).alias("pattern_type"),
        F.when(indicator, at).alias("valid_from"),
        F.when(indicator, F.array(F.lit("malicious-activity"))).alias("indicator_types"),
        F.when(k == "x509-certificate", value).alias("serial_number"),
        F.floor(F.col("confidence") * 100 + F.lit(1e-9)).cast("int").alias("confidence"),
        F.concat(F.lit("Entity "), F.col("type"), F.lit(":"), value).alias("description"),
        inv.alias("x_investigation_id"),
        F.col("source_count").alias("x_source_count"),
    )
    objects = typed.select(inv, bundle.alias("bundle_id"), F.col("_sid").alias("id"), k.alias("type"),
                           F.to_json(body).alias("object"))
    ids = typed.select("investigation_id", F.col("id").alias("_id"), "_sid")
    ends = rels.where((F.col("source_id") != "") & (F.col("target_id") != ""))
    for end, name in (("source_id", "_src"), ("target_id", "_tgt")):
        found = ids.select("investigation_id", F.col("_id").alias(end), F.col("_sid").alias(name))
        ends = ends.join(found, ["investigation_id", end], "left").withColumn(name, F.coalesce(name, end))
    verb = _named(fixed.STIX_VERBS, F.lower("relationship_type"), "related-to")
    edge_id = stix_id(F.lit("relationship"), F.concat_ws(":", inv, F.col("_src"), verb, F.col("_tgt")))
    link = F.struct(
        F.lit("relationship").alias("type"),
        F.lit("2.1").alias("spec_version"),
        edge_id.alias("id"),
        at.alias("created"),
        at.alias("modified"),
        verb.alias("relationship_type"),
        F.col("_src").alias("source_ref"),
        F.col("_tgt").alias("target_ref"),
        F.floor(F.col("confidence") * 100 + F.lit(1e-9)).cast("int").alias("confidence"),
        F.concat(F.lit("Relationship "), F.lower("relationship_type")).alias("description"),
    )
    links = ends.select(inv, bundle.alias("bundle_id"), edge_id.alias("id"), F.lit("relationship").alias("type"),
                        F.to_json(link).alias("object"))
    return objects.unionByName(links)
