"""Mixing sources to target weights, with DataFrame operations only.

Every source gets a target of words: its weight's part of the whole mix, but no more than a number of epochs over it.
What a source cannot give is reshared among the others by weight. Inside a source, documents stand in the order of a
hash of their id; the order is dealt into ranges of that hash, words are summed inside each range and over the ranges
before it, and the source is cut at its target to the word. Whole epochs come before the cut.

The hash is uniform, so equally wide ranges are equally full in every source, however large it is: with as many ranges
as the root of the number of rows, neither the rows of a range nor the ranges of a source outgrow that root.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.llm.common import query, table, written
from linkloom.operators.ordering import numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in their order, repeating; percent of all words that the mix takes; epochs over a source.
WEIGHTS, PERCENT, EPOCHS = (3, 1, 2), 150, 2
SEED = "mix"
#: Repeats of one row are written out in runs of this many.
RUN = 1_000


def n_words(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    """48 bits that look random and are the same in every run: from the id, or the text of a row without one."""
    name = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 12), 16, 10).cast("bigint")


def _named(source: Column) -> Column:
    """A source's name that is never null, in the order of code points with null behind all others."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def source_targets(
    sizes: DataFrame, *, weights: Sequence[float] | DataFrame = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS
) -> DataFrame:
    """Rows (source, source_size, weight, target) of a table (source, source_size), one row a source, no null source.

    ``weights`` are dealt to the sources in their order, or stand in a table (source, weight); a source that it lacks
    weighs nothing. The targets sum to ``percent`` of all sizes, or to all that the sources give in ``epochs`` epochs.
    The share of a unit of weight is found by raising it: sources above their bound give way, the rest is shared anew;
    each round sums one small table, and only three numbers reach the driver.
    """
    if isinstance(weights, DataFrame):
        known = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        placed = sizes.join(known, F.col("source") == F.col("_s"), "left").drop("_s")
        placed = placed.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    else:
        place = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
        dealt = F.get(F.array(*[F.lit(float(w)) for w in weights]), place).alias("weight")
        placed = numbered(sizes.withColumn("all", F.lit(0)), ["all"], ["source"], "place")
        placed = placed.select("source", "source_size", dealt)
    placed = written(placed)
    bound = epochs * F.col("source_size")
    share, total = 0.0, None
    while True:
        full = bound <= share * F.col("weight")
        found = placed.agg(
            F.sum("source_size"), F.sum(F.when(full, bound)), F.sum(F.when(~full & (F.col("weight") > 0), F.col("weight")))
        ).first()
        total = percent / 100 * (found[0] or 0)
        if not found[2]:
            share = math.inf
            break
        raised = (total - (found[1] or 0)) / found[2]
        if raised <= share:
            break
        share = raised
    part = F.lit(share) * F.col("weight") if math.isfinite(share) else bound.cast("double")
    target = F.when(F.col("weight") > 0, F.least(bound.cast("double"), part)).otherwise(0.0)
    return placed.select("source", "source_size", "weight", target.alias("target"))


def mixture(
    docs: DataFrame,
    *,
    weights: Sequence[float] | DataFrame = WEIGHTS,
    percent: int = PERCENT,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, source, size, source_size, target, taken), ``taken`` in words over all
    epochs.

    The words taken of a source sum to its target without the fraction. All documents of a source are taken so many
    whole times; once more come those before the cut, and of the one at the cut only its first words. A null or empty
    text has size 0 and is taken with 0 words; a null source is a source of its own and the last one; rows without an
    id take their place by their text. Rows that share an id are handled one by one; repeated rows stand side by side
    and are counted, not sorted, so that no number of them makes a large range. An empty table gives no rows; other
    columns are not read. The same table and seed give the same rows, however it is dealt over files.
    """
    text = F.col("text").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _named(F.col("source").cast("string")).alias("source"),
        n_words(text).alias("size"),
        random_key(F.col("doc_id"), text, seed).alias("key"),
    )
    rows = written(sized.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies")))
    words = F.col("size") * F.col("copies")
    bins = max(1, math.isqrt(rows.count()))
    sizes = written(rows.groupBy("source").agg(F.sum(words).alias("source_size")))
    targets = source_targets(sizes, weights=_named_weights(weights), percent=percent, epochs=epochs)
    # 32 bits of the key times the number of ranges: the whole part is the range.
    ranged = rows.withColumn("bin", F.shiftright(F.shiftright("key", 16) * bins, 32))
    sums = ranged.groupBy("source", "bin").agg(F.sum(words).alias("words"))
    before = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bin", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    starts = written(starts.join(targets, "source"))
    inside = W.partitionBy("source", "bin").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumn("at", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    placed = summed.join(starts.hint("merge"), ["source", "bin"])
    budget = F.floor("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = (budget - whole * F.col("source_size")).cast("bigint")
    placed = placed.select(
        "doc_id", "source", "size", "source_size", "target", "copies", whole.cast("bigint").alias("whole"),
        (rest - F.col("start") - F.col("at")).alias("left"),
    )
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {RUN}"))))
    last = F.least(F.col("copies") - 1, F.col("run") * RUN + RUN - 1)
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN, last)))
    part = F.least(F.greatest(F.col("left") - F.col("copy") * F.col("size"), F.lit(0)), F.col("size"))
    source = F.when(F.col("source").startswith("0"), F.expr("substr(source, 2)")).alias("source")
    taken = (F.col("whole") * F.col("size") + part).cast("bigint").alias("taken")
    return each.select("doc_id", source, "size", "source_size", "target", taken)


def _named_weights(weights: Sequence[float] | DataFrame) -> Sequence[float] | DataFrame:
    if not isinstance(weights, DataFrame):
        return weights
    return weights.select(_named(F.col("source")).alias("source"), "weight")


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: (doc_id, source, epoch, n_words, text), a row for each time that a document is taken.

    The document at a source's cut gives its first words there, with the white space before them. Documents that give
    no words are left out. Ids must be there and differ; a document without one, or with one of several rows, raises an
    error when the rows are read, as its text could not be told. Arguments as in ``mixture``.
    """
    plan = mixture(docs, **how).where("taken > 0")
    several = F.count("*").over(W.partitionBy("doc_id"))
    plan = plan.withColumn("_k", F.when(F.col("doc_id").isNull(), 2).otherwise(several))
    wrong = F.raise_error(F.lit("mixed_texts needs ids that differ"))
    times = F.when(F.col("_k") > 1, wrong.cast("bigint")).otherwise(F.ceil(F.col("taken") / F.col("size")).cast("bigint"))
    each = plan.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), times)))
    count = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    of = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_text"))
    found = each.select("doc_id", "source", "epoch", "size", count.alias("n_words")).join(of, F.col("doc_id") == F.col("_id"))
    words = F.regexp_extract_all("_text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    first = F.array_join(F.slice(words, 1, F.col("n_words").cast("int")), "")
    text = F.when(F.col("n_words") < F.col("size"), first).otherwise(F.col("_text")).alias("text")
    return found.select("doc_id", "source", "epoch", "n_words", text)


_SHARE = PERCENT / 100
_ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, text, '')), 1, 12) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
    {list(WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w FROM d GROUP BY source),
o AS (SELECT *, {_SHARE} * sum(source_size) OVER () - coalesce(sum({EPOCHS} * source_size) OVER (ORDER BY
      {EPOCHS}.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY {EPOCHS}.0 * source_size / w, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
l AS (SELECT max(rest::DOUBLE / weights::DOUBLE) AS share FROM o),
t AS (SELECT source, source_size, least({EPOCHS}.0::DOUBLE * source_size, share * w::DOUBLE) AS target FROM s, l),
p AS (SELECT d.doc_id, d.size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + least(greatest(budget % source_size - start, 0), size) END)::BIGINT AS taken FROM p
"""


@query("op11_source_mixture", _ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
