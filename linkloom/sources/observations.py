"""Reading stored observations and platform rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom import schemas


def read_observations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Observations with the fixed outer schema; the payload stays JSON text until an adapter parses it."""
    return spark.read.schema(schemas.OBSERVATIONS).format(fmt).load(path)


def read_platforms(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Enabled platform rules of JSON objects keyed by platform, by name; entries without name or URL are skipped.

    A file is one object, as small rule files are, or with ``lines`` has an object on every line, so that many tasks read
    it.
    """
    indicators = "STRUCT<status_codes ARRAY<INT>, body_contains ARRAY<STRING>, body_not_contains ARRAY<STRING>>"
    rule = (
        f"STRUCT<name STRING, url_pattern STRING, success_indicators {indicators}, "
        f"failure_indicators {indicators}, enabled BOOLEAN>"
    )
    whole = spark.read.text(path, wholetext=not lines)
    rows = whole.select(F.explode(F.from_json("value", f"MAP<STRING, {rule}>")).alias("key", "r"))
    usable = rows.where(
        F.col("r.name").isNotNull() & F.col("r.url_pattern").isNotNull() & F.coalesce("r.enabled", F.lit(True))
    )
    return usable.select(
        "key",
        "r.name",
        "r.url_pattern",
        F.col("r.failure_indicators.status_codes").alias("fail_codes"),
        F.col("r.failure_indicators.body_contains").alias("fail_body"),
        F.col("r.success_indicators.status_codes").alias("ok_codes"),
        F.col("r.success_indicators.body_contains").alias("must_have"),
        F.col("r.success_indicators.body_not_contains").alias("must_not"),
    ).orderBy("name")
