"""Storing report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ["json", "csv", "parquet", "orc"]


def write_report(df: DataFrame, path: str, fmt: str, log_path: str, now: Column | None = None) -> None:
    """Writes report rows and appends one metadata row per investigation: format, path, number of rows and bytes."""
    if fmt not in FORMATS:
        raise ValueError(f"report format {fmt!r} is not one of {FORMATS}")
    df.write.mode("overwrite").format(fmt).save(path)
    size = F.sum(F.length(F.to_json(F.struct("*")))).cast("bigint")
    now = now if now is not None else F.current_timestamp()
    meta = df.groupBy("investigation_id").agg(size.alias("file_size"), F.count("*").alias("rows"))
    meta.select(
        F.uuid().alias("id"),
        "investigation_id",
        F.lit(fmt).alias("format"),
        F.lit(path).alias("file_path"),
        "file_size",
        "rows",
        now.alias("created_at"),
    ).write.mode("append").parquet(log_path)
