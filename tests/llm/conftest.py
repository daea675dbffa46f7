import pytest
from prose import prose
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, prose(60)),
        (2, None),
        (3, ""),
        (4, " \n\t "),
        (5, prose(30_000, 5)),
        (6, prose(60)),
        (6, prose(60)),
        (None, prose(40, 9)),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = {c: F.lit("x") for c in ("n", "g", "c", "key", "hash", "block", "label", "item_id", "score", "a", "b", "part", "_gone", "_twice", "_place", "_leaking", "gone", "leaking")}
    return df.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
