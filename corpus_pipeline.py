"""The training-data pipeline over ``documents``: a list of stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import bpe_tree, jaccard_join, repetition, secret_scan, templates
from linkloom.llm.common import table, written
from linkloom.session import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near copies share this percentage of their five-word shingles; op8 by itself is stricter (3 words, 90 percent).
SHINGLE, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go, among them those without words (null or empty texts). Rows are
    judged one by one; an empty table stays empty."""
    return repetition.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of rows with one id, one stays. A document
    without words links with nothing and stays, and so does every row without an id. Documents link by SHINGLE and
    PERCENT of this module."""
    return jaccard_join.one_of_each_group(docs, size=SHINGLE, percent=PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark``, as it is or with other numbers and names, go. Rows are judged one by
    one, also without an id; a null text stays."""
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and ``n_chars`` follows; all documents stay."""
    return secret_scan.redacted(docs, secret_scan.train(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text (doc_id, n_tokens, ids), one row per row; a null or empty text has none."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe_tree.encoded(docs, ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: SQL cannot express the secret and token stages; tests compare the rows with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        # What a stage writes for itself goes once its rows are written.
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), keep=True)
    return docs
