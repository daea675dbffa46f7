"""Session set-up and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Memory, executors and partition counts stay with whoever submits the job.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Large column expressions are built from Python; call-site capture would triple the time that takes.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "linkloom") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        # Small files still give every core a task.
        .config("spark.sql.files.minPartitionNum", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.files.openCostInBytes", "64k")
    )
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share."""
    context = spark.sparkContext
    folder = (
        context.getCheckpointDir()
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
    )
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


_SCOPES: list[list[str]] = []


def cut_lineage(df: DataFrame, by: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them back.

    The rows survive the loss of executors, and unlike a checkpointed plan the written table has a known size, so
    Spark can choose how to join it. Inside ``scratch`` the table goes when the scope ends; otherwise it stays with the
    application's other tables, in one folder. ``by`` names columns of few values by which the files are kept apart, so
    that a reader of one value reads only its files; a table to ``keep`` outlives the scope.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    if _SCOPES and not keep:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drops the tables that ``cut_lineage`` writes inside, once the results made from them have been written."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
