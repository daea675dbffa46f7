"""Written indexes: pages by key over range-ordered files, and pieces of text by grams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Code points of the longest gram; a shorter search text is a gram itself.
GRAM = 3
#: Parts of a table of pages that one task writes.
PARTS_PER_TASK = 64
#: Rows of a task that ``monotonically_increasing_id`` can count.
TASK_ROWS = 1 << 33


# --- pages by key ------------------------------------------------------------------------------------------------


def write_pages(rows: DataFrame, folder: str, time_col: str, id_col: str, rows_per_part: int = 100_000) -> None:
    """Writes the rows newest first, ties by falling id, into parts of neighbouring rows, and a table of the parts.

    ``id_col`` tells rows of one time apart. Rows without a time come last. Every part is a folder of its own, so a
    reader opens only the parts that a page touches.
    """
    spark = rows.sparkSession
    parts = max(1, -(-rows.count() // rows_per_part))
    order = [F.desc(time_col), F.desc(id_col)]
    # A task writes many parts: tasks, and what a range partitioning samples for each, are what the driver hears of.
    spread = rows.repartitionByRange(-(-parts // PARTS_PER_TASK), *order).sortWithinPartitions(*order)
    # A row's number is that of its task and, in the last 33 bits, its place in the task.
    numbered = spread.withColumn("_at", F.monotonically_increasing_id())
    place = F.col("_at").bitwiseAND(F.lit(TASK_ROWS - 1))
    part = F.col("_at") - place + F.floor(place / rows_per_part)
    placed = numbered.withColumn("_part", part).drop("_at")
    placed.sortWithinPartitions("_part", *order).write.mode("overwrite").partitionBy("_part").parquet(f"{folder}/rows")
    # An empty table has no part to read its columns from.
    rows.limit(0).write.mode("overwrite").parquet(f"{folder}/columns")
    key = F.struct(F.col(time_col).alias("t"), F.col(id_col).alias("id"))
    written = _written_pages(spark, folder)
    bounds = written.groupBy("_part").agg(F.count("*").alias("n"), F.min(key).alias("last"))
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")


def _written_pages(spark: SparkSession, folder: str, parts: list[int] | None = None) -> DataFrame:
    """The rows of all parts, or of some; only the folders of these are listed."""
    columns = spark.read.parquet(f"{folder}/columns").schema
    whole = StructType(columns.fields).add("_part", LongType())
    if parts is None:
        return spark.read.schema(whole).parquet(f"{folder}/rows")
    if not parts:
        return spark.createDataFrame([], whole)
    paths = [f"{folder}/rows/_part={k}" for k in parts]
    return spark.read.schema(whole).option("basePath", f"{folder}/rows").parquet(*paths)


def page_after(
    spark: SparkSession, folder: str, time_col: str, id_col: str, limit: int, after: tuple[Any, Any] | None = None
) -> DataFrame:
    """The next ``limit`` rows behind the key (time, id) of the last row seen, or the first ones.

    The table of parts, one row each, names the part where the page begins and those that it runs into. Parts before
    and behind are not opened, so a late page costs what the first one does.
    """
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    types = {f.name: f.dataType for f in spark.read.parquet(f"{folder}/columns").schema}
    parts = spark.read.parquet(f"{folder}/parts")
    key = None
    if after is not None:
        # Nulls are the least values of a struct, as they come last in falling order.
        key = F.struct(F.lit(after[0]).cast(types[time_col]).alias("t"), F.lit(after[1]).cast(types[id_col]).alias("id"))
        parts = parts.where(F.col("last") < key)
    # The first part may give as little as one row, so the page ends where the parts behind it have the others.
    nth = F.row_number().over(W.orderBy("_part"))
    behind = F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counted = parts.select("_part", nth.alias("k"), F.first("n").over(W.orderBy("_part")).alias("first"), behind.alias("b"))
    needed = counted.where((F.col("k") <= 2) | (F.col("b") - F.col("first") + 1 < limit))
    chosen = [r["_part"] for r in needed.select("_part").collect()]
    rows = _written_pages(spark, folder, chosen).where(F.col("_part").isin(chosen))
    if key is not None:
        rows = rows.where(F.struct(F.col(time_col).alias("t"), F.col(id_col).alias("id")) < key)
    return rows.drop("_part").orderBy(F.desc(time_col), F.desc(id_col)).limit(limit)


# --- pieces of text ----------------------------------------------------------------------------------------------


def _grams(text, size: int):
    """The distinct runs of ``size`` code points."""
    runs = F.transform(F.sequence(F.lit(1), F.char_length(text) - (size - 1)), lambda i: F.substr(text, i, F.lit(size)))
    return F.array_distinct(F.when(F.char_length(text) >= size, runs).otherwise(F.array().cast("array<string>")))


def _bucket(gram, buckets: int):
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def add_to_index(rows: DataFrame, folder: str, fields: list[str], keys: list[str], buckets: int = 64) -> None:
    """Appends grams of one to three code points of the lower-case texts to an index: (bucket, gram, field, keys).

    Null texts have no grams. A bucket is written by as many tasks as its rows need, sorted by gram, so that a reader
    of one gram opens only its row groups. ``buckets`` stays the same for all that an index is given.
    """
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("text")) for f in fields])
    texts = rows.select(*keys, F.inline(each)).where(F.col("text").isNotNull())
    grams = F.concat(*[_grams(F.col("text"), size) for size in range(1, GRAM + 1)])
    entries = texts.select(F.explode(grams).alias("gram"), "field", *keys)
    placed = entries.withColumn("bucket", _bucket(F.col("gram"), buckets)).hint("rebalance", F.col("bucket"))
    placed.sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(folder)


def containing(
    rows: DataFrame, folder: str, text: str, fields: list[str], keys: list[str], buckets: int = 64
) -> DataFrame:
    """The rows one of whose fields contains the text, whatever the case.

    Only the buckets of the text's grams are read; the keys that have all of them are joined with the rows, and the
    rows are compared with the text itself, so an index that knows former values gives no wrong row. A blank text
    finds all rows.
    """
    wanted = text.strip().lower()
    if not wanted:
        return rows
    size = min(GRAM, len(wanted))
    grams = sorted({wanted[i : i + size] for i in range(len(wanted) - size + 1)})
    spark = rows.sparkSession
    numbers = spark.range(1).select(F.array(*[_bucket(F.lit(g), buckets) for g in grams])).first()[0]
    entry = [StructField("gram", StringType()), StructField("field", StringType()), *[rows.schema[k] for k in keys]]
    entry = StructType(entry).add("bucket", IntegerType())
    index = spark.read.schema(entry).parquet(folder).where(F.col("bucket").isin(sorted(set(numbers))) & F.col("gram").isin(grams))
    hits = index.groupBy("field", *keys).agg(F.count_distinct("gram").alias("_n")).where(F.col("_n") == len(grams))
    found = rows.join(hits.select(*keys), keys, "left_semi")
    holds = [F.coalesce(F.contains(F.lower(F.col(f)), F.lit(wanted)), F.lit(False)) for f in fields]
    any_of = holds[0]
    for h in holds[1:]:
        any_of = any_of | h
    return found.where(any_of)
