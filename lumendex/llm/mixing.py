"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source gets a share of all words in proportion to its weight, but at most
`epochs` times its own words; the excess of capped sources is shared out again by
weight until none is above its cap.  A document is repeated `floor(target /
source size)` times as a whole, and once more if its seeded hash is not above the
source's cut, which is set so that the words taken come as near the target as
whole documents allow.

Only a row per source is joined to the documents, broadcast while the sources are
counted to be few, so that texts are not shuffled however skewed the sources are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, saved, unused

#: Hash buckets of the first pass that looks for a source's cut: as many as three hex digits.
_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Water-filled `target` of each row (source, source_size); adds `weight`, `target`.

    Sources are ranked by code point with null last and weigh `weights`, repeating.
    In order of size by weight, the capped sources are those before the first whose
    cap reaches its part of what is left; as weights are integers, all tests are
    exact in whole numbers.  The table has one row per source.
    """
    common = 1
    for w in weights:
        common *= w
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank - 1) % len(weights) + 1).cast("long")
    order = Window.orderBy(F.col("source_size") * (F.lit(common) / F.col("weight")).cast("long"), F.col("source").asc_nulls_last())
    cap = F.col("source_size") * epochs
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = (
        sources.withColumn("weight", weight)
        .withColumn("_rest", F.sum("source_size").over(Window.partitionBy()) - before)
        .withColumn("_w", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_free", cap * F.col("_w") >= F.col("weight") * F.col("_rest"))
        .withColumn("_k", F.row_number().over(order))
    )
    everyone = Window.partitionBy()
    first = F.min(F.when(F.col("_free"), F.struct("_k", "_rest", "_w"))).over(everyone)
    shared = (F.col("weight") * F.col("_first._rest")).cast("double") / F.col("_first._w").cast("double")
    return laid.withColumn("_first", first).select(
        "source", "source_size", "weight", F.when(F.col("_k") < F.col("_first._k"), cap.cast("double")).otherwise(shared).alias("target")
    )


def _hash(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """One row per source: source, source_size, weight, target, whole, cut (null: no partial repetition)."""
    slim = saved(docs.select("source", _hash(seed).alias("h"), word_count(F.col("text")).alias("size")), "mix")
    per_bucket = slim.groupBy("source", F.substring("h", 1, _DIGITS).alias("b")).agg(F.sum("size").alias("n"))
    per_bucket = saved(per_bucket, "mix-buckets")  # at most 4096 rows a source
    goal = targets(per_bucket.groupBy("source").agg(F.sum("n").alias("source_size")), epochs, weights)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0).cast("long"))
    goal = saved(goal.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-goal")
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    by_bucket = Window.partitionBy("source").orderBy("b")
    crossing = (
        per_bucket.withColumn("upto", F.sum("n").over(by_bucket))
        .alias("l").join(goal.select("source", "need").alias("r"), same)
        .filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need")))
        .select("l.source", "b", (F.col("upto") - F.col("n")).alias("base"), "need")
    )
    crossing = broadcast_if_small(saved(crossing, "mix-crossing"))  # a row or two a source
    near = (
        slim.withColumn("b", F.substring("h", 1, _DIGITS)).alias("l")
        .join(crossing.alias("r"), same & (F.col("l.b") == F.col("r.b")))
        .select("l.source", "l.b", "h", "size", "base", "need")
        .withColumn("cum", F.col("base") + F.sum("size").over(Window.partitionBy("source", "b").orderBy("h")))
    )
    cuts = near.groupBy("source").agg(
        F.max(F.when(2 * F.col("cum") - F.col("size") <= 2 * F.col("need"), F.col("h"))).alias("inside"),
        F.max(F.when(F.col("base") <= F.col("need"), F.col("b"))).alias("b"),
    )
    return (
        goal.alias("l").join(cuts.alias("r"), same, "left")
        .select("l.source", "source_size", "weight", "target", "whole", F.when(F.col("need") > 0, F.coalesce("inside", "b")).alias("cut"))
    )


def mix(docs: DataFrame, epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """`docs` with size, source_size, target, repeats and taken (= size * repeats).

    doc_id, text and source are read; other columns pass through unchanged whatever
    their names, except that columns with the added names are replaced.  A null text
    has size 0, as an empty one; a very long text is only counted; null sources are
    one source, the last; documents with equal doc_id (repeated rows among them)
    share their decision, so ties do not matter; an empty table gives an empty one.
    The same table and seed always give the same result.
    """
    added = ("size", "source_size", "target", "repeats", "taken")
    docs = docs.drop(*added)
    h, of, whole, cut = unused([*docs.columns, *added], "h", "of", "whole", "cut")
    per_source = saved(plan(docs, epochs, weights, seed), "mix-plan")  # a row a source
    per_source = broadcast_if_small(per_source.select(F.col("source").alias(of), "source_size", "target", F.col("whole").alias(whole), F.col("cut").alias(cut)))
    left = docs.withColumn("size", word_count(F.col("text"))).withColumn(h, _hash(seed))
    once = F.coalesce((F.col(h) <= F.col(cut)).cast("long"), F.lit(0))
    joined = left.join(per_source, F.col("source").eqNullSafe(F.col(of))).withColumn("repeats", F.col(whole) + once)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own, "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def expand(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix repeats it."""
    (n,) = unused(mixed.columns, "n")
    return mixed.filter(F.col("repeats") > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).drop(n)


#: DuckDB SQL for the rows of `op9_mix`.
SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', coalesce(doc_id::VARCHAR, 'null'))) AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source
), w AS (SELECT *, ((rn - 1) % 3 + 1)::BIGINT AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY source_size * (6 // weight), rn) AS k,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY source_size * (6 // weight), rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (ORDER BY source_size * (6 // weight), rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM w
), f AS (SELECT k AS fk, rest AS frest, ws AS fws FROM o WHERE 3 * source_size * ws >= weight * rest ORDER BY k LIMIT 1
), g AS (
  SELECT source, source_size,
    CASE WHEN k < fk THEN (3 * source_size)::DOUBLE ELSE (weight * frest)::BIGINT::DOUBLE / fws::BIGINT::DOUBLE END AS target
  FROM o, f
), n AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size)::BIGINT, 3) ELSE 0 END AS whole FROM g
), c AS (
  SELECT d.*, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS cum
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
), t AS (
  SELECT *, max(CASE WHEN need > 0 AND 2 * cum - size <= 2 * need THEN h END) OVER (PARTITION BY source) AS cut FROM c
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN h <= cut THEN 1 ELSE 0 END))::BIGINT AS taken FROM t
"""
