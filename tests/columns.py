"""Applies column rules to plain values."""

from pyspark.sql import functions as F


def column(spark, values, build, kind="string"):
    """Applies a column rule to a list of values and returns the results in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    rows = df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]
