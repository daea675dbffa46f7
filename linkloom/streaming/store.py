"""Tables that a stream adds to batch by batch, in one folder.

Every table is kept by batch and by bucket of investigations. A batch that runs twice replaces its own files, so nothing
counts twice; a reader of some investigations opens their buckets only, and in them, as files are sorted by
investigation, their row groups. ``compact`` puts all batches up to one into a base.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from linkloom.sources.tables import bucket_of


class BatchStore:
    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def save(self, df: DataFrame, name: str, batch: int, gather: bool = False) -> None:
        """Replaces what the batch has written into this table.

        Each task writes its own file per bucket; to ``gather`` the rows of a bucket costs a shuffle, which a table that
        stays is worth: it is written by as many tasks as the bucket needs, as one investigation may hold most rows.
        """
        rows = df.withColumn("bucket", bucket_of("investigation_id", self.buckets)).withColumn("batch", F.lit(batch))
        rows = rows.hint("rebalance", F.col("bucket")) if gather else rows
        placed = rows.sortWithinPartitions("bucket", "investigation_id")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(
            f"{self.folder}/{name}"
        )

    def rows(self, name: str, schema: StructType, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of all batches, with the column ``batch``: those in the base have a negative one."""
        whole = StructType(list(schema.fields)).add("batch", IntegerType()).add("bucket", IntegerType())
        if not self._batches(name):
            return self.spark.createDataFrame([], whole).drop("bucket")
        found = self.spark.read.schema(whole).parquet(f"{self.folder}/{name}")
        base = self._base()
        found = found.where((F.col("batch") > base) | (F.col("batch") == -base - 1) if base >= 0 else F.col("batch") >= 0)
        if upto is not None:
            found = found.where(F.col("batch") <= upto)
        if buckets is not None:
            found = found.where(F.col("bucket").isin(buckets))
        return found.drop("bucket")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _batches(self, name: str, prefix: str = "batch=") -> list[int]:
        """The numbers of a folder's subfolders; no data is read."""
        at, fs = self._fs(f"{self.folder}/{name}")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return [int(n[len(prefix) :]) for n in names if n.startswith(prefix)]

    def _base(self) -> int:
        """The last batch that is part of the base, or -1."""
        return max(self._batches("base", "upto="), default=-1)

    def compact(self, tables: dict[str, tuple[StructType, Callable[[DataFrame], DataFrame]]], upto: int) -> None:
        """Puts the batches up to ``upto`` of each table through its function and keeps the result as the base.

        The base counts once all tables have one, and only then do the old batches go; a run that breaks off before
        or after leaves tables that read the same.
        """
        for name, (schema, merge) in tables.items():
            self.save(merge(self.rows(name, schema, upto)).drop("batch"), name, -upto - 1, gather=True)
        at, fs = self._fs(f"{self.folder}/base/upto={upto}")
        fs.mkdirs(at)
        for name in tables:
            for old in self._batches(name):
                if -upto - 1 < old <= upto:
                    at, fs = self._fs(f"{self.folder}/{name}/batch={old}")
                    fs.delete(at, True)
