"""Row numbers for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.session import cut_lineage


def first_rows(df: DataFrame, keys: list[str | Column], order: list[Column], n: int | None = 1) -> DataFrame:
    """The first ``n`` rows per key, or all. Spark prunes each task's rows to ``n`` per key before the shuffle."""
    if n is None:
        return df
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= n).drop("_n")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds the position (from 0) of a row in its group, without bringing a group into one task.

    Rows are range-partitioned by key and order, numbered inside their partition, and shifted by the rows of the same
    key in earlier partitions. ``order`` must tell all rows of a group apart.
    """
    cols = [F.col(k) for k in keys] + [F.col(o) for o in order]
    # A row's partition is only settled once it is written.
    placed = cut_lineage(df.repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = W.partitionBy(*keys, "_p").orderBy(*order)
    return (
        placed.withColumn("_n", F.row_number().over(inside))
        .join(shifts, [*keys, "_p"])
        .withColumn(out, (F.col("_n") + F.col("_shift") - 1).cast("bigint"))
        .drop("_n", "_p", "_shift")
    )
