"""Hard negatives for anchors, by exact integer scores from float32 products.

Components are integers. Each matrix is taken modulo several small primes, centred around 0, so that products of
residues summed over a run of components stay below 2**24 and float32 holds them exactly; the products modulo each
prime give back the signed score by Chinese remaindering, with as many primes as the largest possible score needs.

Rows and anchors are dealt into blocks, and every pair of a block of rows and a block of anchors is one cell, a group of
its own. A cell keeps the few best rows of each of its anchors, and a window over the cells chooses among them: first
the positives, then, with the bounds that the positives' scores set, the negatives.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import query, table, written

#: Primes below this are the moduli; the largest come first.
BELOW = 256
#: Integers up to this are exact in float32.
EXACT = 1 << 24
BLOCK_ROWS, BLOCK_ANCHORS = 1_024, 1_024
#: Anchors whose scores a cell holds at a time.
STRIP = 128
SCALE = 256
NONE = np.iinfo(np.int64).min


def moduli(bound: int) -> list[int]:
    """The largest primes below BELOW whose product exceeds twice ``bound``, so that every score from -bound to bound is
    told apart."""
    primes = [p for p in range(BELOW - 1, 2, -1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    chosen, product = [], 1
    for p in primes:
        if product > 2 * bound:
            break
        chosen.append(p)
        product *= p
    if product <= 2 * bound or product >= 1 << 63:
        raise ValueError(f"scores of up to {bound} do not fit into 64 bits")
    return chosen


def residues(rows: np.ndarray, p: int) -> np.ndarray:
    """Integers modulo an odd prime, from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    half = p // 2
    return ((rows + half) % p - half).astype(np.float32)


def product_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p of centred residues, from 0 to p - 1; runs of components are summed in float32, and runs in
    integers."""
    run = EXACT // (p // 2) ** 2
    total = np.zeros((len(a), len(b)), np.int32)
    for k in range(0, a.shape[1], run):
        total += (a[:, k : k + run] @ b[:, k : k + run].T).astype(np.int32) % p
    return total % p


def remaindered(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers of least size that leave these remainders: digits in the mixed base of the primes, each found
    modulo its own prime."""
    digits: list[np.ndarray] = []
    for part, p in zip(parts, primes, strict=True):
        known, base = np.zeros_like(part), 1
        for digit, q in zip(digits, primes, strict=False):
            known = (known + digit * base) % p
            base = base * q % p
        digits.append((part - known) % p * pow(base, -1, p) % p)
    value = digits[-1].astype(np.int64)
    for k in range(len(digits) - 2, -1, -1):
        value = value * primes[k] + digits[k]
    product = math.prod(primes)
    return np.where(value > product // 2, value - product, value)


class Scores:
    """Exact inner products with the rows of one block."""

    def __init__(self, rows: np.ndarray, primes: list[int]):
        self.primes = primes
        self.rows = [residues(rows, p) for p in primes]

    def of(self, anchors: np.ndarray) -> np.ndarray:
        parts = [product_modulo(residues(anchors, p), r, p) for p, r in zip(self.primes, self.rows, strict=True)]
        return remaindered(parts, self.primes)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest scores of each row, of equal ones those further left; NONE never counts."""
    n = scores.shape[1]
    k = min(k, n)
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    r, c = np.nonzero((scores >= least[:, None]) & (scores != NONE))
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


def whole_components(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")))


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, c) of the rows that take part, one per id, ``c`` being whole numbers."""

    def finite(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    fine = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    rows = vectors.where(fine & F.forall("embedding", finite))
    rows = rows.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.struct(F.col("label"), whole_components(F.col("embedding"), scale).alias("c")).alias("r")
    )
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.c")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of equal width, filled up with zeros."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


BLOCK = [("ids", "binary"), ("labels", "binary"), ("c", "binary")]


def _packed(rows: DataFrame, key: str, width: int, kind: str, bounds: list[str] | None = None) -> DataFrame:
    """One row per block ``key``: ids, labels and components of its rows, by ascending id, as bytes of numpy arrays; of
    the columns ``bounds``, arrays of whole numbers of one length, as well."""
    bounds = bounds or []
    names = [key, *(x for x, _ in BLOCK), *bounds]
    schema = pa.schema([(key, pa.int64()), *((x, pa.binary()) for x in names[1:])])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        cells = [
            group.column("vec_id").to_numpy().astype("<i8").tobytes(),
            group.column("place").to_numpy().astype("<i8").tobytes(),
            _matrix(group.column("c"), width).astype(kind).tobytes(),
        ]
        for x in bounds:
            cells.append(group.column(x).combine_chunks().flatten().to_numpy().astype("<i8").tobytes())
        row = [group.column(key)[0].as_py(), *cells]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    columns = rows.select(key, "vec_id", "place", "c", *bounds)
    return columns.groupBy(key).applyInArrow(run, f"{key} bigint, " + ", ".join(f"{x} binary" for x in names[1:]))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _cells(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, run: Callable, ddl: str) -> DataFrame:
    """Every block of rows with every block of anchors, each pair in a group of its own."""
    left = rows.withColumn("j", F.explode(_numbers(n_anchors)))
    right = anchors.withColumn("i", F.explode(_numbers(n_rows)))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, ddl)


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    *,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of a table (vec_id, label,
    embedding) for which ``anchor``, a condition on vec_id and label, holds.

    A component x counts as floor(scale * x). An anchor's positives are the first rows of its label but itself, by
    descending inner product, then by id; of each positive, the negatives are the first rows of another label whose
    score is from ``low`` to ``high`` percent of the positive's; where there are fewer, all of them. All rows are compared
    with every anchor.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of rows that share an id
    the smallest by label and vector stands for all, so repeated rows count once. Vectors of different lengths are
    filled up with zeros; an empty vector scores 0. No rows, or no anchors, give no rows; other columns are not read.
    Scores that 64 bits may not hold are an error.
    """
    out_ddl = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    spark = vectors.sparkSession
    rows = written(usable(vectors, scale).withColumn("is_anchor", F.coalesce(anchor, F.lit(False))))
    labels = written(rows.select("label").distinct().withColumn("place", F.monotonically_increasing_id()))
    size = rows.agg(
        F.count("*"), F.sum(F.col("is_anchor").cast("int")), F.max(F.size("c")),
        F.max(F.greatest(F.abs(F.array_max("c")), F.abs(F.array_min("c")))),
    ).first()
    if not size[0] or not size[1]:
        return spark.createDataFrame([], out_ddl).select(
            "anchor_id", "positive_id", F.lit(1).alias("rank"), "negative_id", "positive_score", "negative_score"
        )
    width, most = max(1, size[2]), size[3] or 0
    primes = moduli(width * most * most or 1)
    kind = next(t for t in ("<i2", "<i4", "<i8") if most <= np.iinfo(t).max)
    n_rows, n_anchors = -(-size[0] // BLOCK_ROWS), -(-size[1] // BLOCK_ANCHORS)
    rows = rows.join(labels, "label")
    dealt = F.xxhash64("vec_id")
    row_blocks = written(_packed(rows.withColumn("i", F.pmod(dealt, F.lit(n_rows))), "i", width, kind))
    anchors = written(rows.where("is_anchor").withColumn("j", F.pmod(dealt, F.lit(n_anchors))))
    anchor_blocks = written(_packed(anchors, "j", width, kind))

    def block(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, of, c = (cell.column(x)[0].as_py() for x, _ in BLOCK)
        n = len(ids) // 8
        return np.frombuffer(ids, "<i8"), np.frombuffer(of, "<i8"), np.frombuffer(c, kind).reshape(n, width).astype(np.int64)

    def numbers(cell: pa.Table, name: str, n: int) -> np.ndarray:
        return np.frombuffer(cell.column(name)[0].as_py(), "<i8").reshape(n, positives)

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], []]
        if len(left) and len(right):
            (ids, of, c), (own, own_of, a) = block(left), block(right)
            scores = Scores(c, primes)
            for k in range(0, len(own), STRIP):
                some = slice(k, k + STRIP)
                all_ = scores.of(a[some])
                fits = (of == own_of[some, None]) & (ids != own[some, None])
                r, c_ = best(np.where(fits, all_, NONE), positives)
                for column, values in zip(found, (own[some][r], ids[c_], all_[r, c_]), strict=True):
                    column.append(values)
        names = ("anchor_id", "positive_id", "positive_score")
        return _table(names, found)

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        found: list[list[np.ndarray]] = [[] for _ in names]
        if len(left) and len(right):
            (ids, of, c), (own, own_of, a) = block(left), block(right)
            friends, points, least, top = (numbers(right, x, len(own)) for x in ("friends", "points", "least", "top"))
            scores = Scores(c, primes)
            for k in range(0, len(own), STRIP):
                some = slice(k, k + STRIP)
                all_ = scores.of(a[some])
                foreign = np.where(of != own_of[some, None], all_, NONE)
                for p in range(positives):
                    fits = (foreign >= least[some, p, None]) & (foreign <= top[some, p, None])
                    r, c_ = best(np.where(fits, foreign, NONE), negatives)
                    values = (own[some][r], friends[some][r, p], points[some][r, p], ids[c_], all_[r, c_])
                    for column, v in zip(found, values, strict=True):
                        column.append(v)
        return _table(names, found)

    close = _cells(row_blocks, n_rows, anchor_blocks, n_anchors, same, "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    close = written(close.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives))
    # Percentages of 64-bit scores need more than 64 bits. A missing positive has bounds that nothing fits.
    score = F.col("positive_score").cast("decimal(25,0)")
    least, top = (score * low / 100).alias("x"), (score * high / 100).alias("x")
    limit = F.lit((1 << 62)).cast("decimal(38,0)")

    def whole(x: Column) -> Column:
        return F.greatest(F.least(x.cast("decimal(38,0)"), limit), -limit).cast("bigint")

    bounds = close.withColumns({"least": whole(F.ceil(least)), "top": whole(F.floor(top))})
    at = F.struct("at", "positive_id", "positive_score", "least", "top")
    per = bounds.groupBy("anchor_id").agg(F.sort_array(F.collect_list(at)).alias("p"))

    def filled(field: str, missing: int) -> Column:
        gaps = F.array_repeat(F.lit(missing).cast("bigint"), positives - F.size("p"))
        return F.concat(F.transform("p", lambda x: x[field]), gaps)

    per = per.select(
        "anchor_id", filled("positive_id", 0).alias("friends"), filled("positive_score", 0).alias("points"),
        filled("least", 1).alias("least"), filled("top", 0).alias("top"),
    )
    bounded = anchors.join(per, F.col("vec_id") == F.col("anchor_id"))
    blocks = written(_packed(bounded, "j", width, kind, ["friends", "points", "least", "top"]))
    far = _cells(row_blocks, n_rows, blocks, n_anchors, other, out_ddl)
    order = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(names: tuple[str, ...], columns: list[list[np.ndarray]]) -> pa.Table:
    whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    return pa.table([pa.array(c, pa.int64()) for c in whole], names=list(names))


_ORACLE = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
    CAST(list_inner_product(a.c, r.c) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score,
    score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score
    AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 5
"""


@query("op13_residue_negatives", _ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
