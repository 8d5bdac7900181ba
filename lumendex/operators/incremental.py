"""What a new listing changes: files to read again, files that are gone, hashes that can be inherited."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import hashable


def changed(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `listing` (path, mtime, ...) whose path is new or whose time differs, either way, from the known one."""
    old = known.select("path", F.col("mtime").alias("_mtime"))
    return listing.join(old, "path", "left").filter(~F.col("_mtime").eqNullSafe(F.col("mtime"))).select(*listing.columns)


def stale(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `known` whose path is not listed any more."""
    return known.join(listing.select("path"), "path", "left_anti")


def leaders(files: DataFrame) -> DataFrame:
    """(sha256, leader_id, copies): the hashable copy, first by path, that is decoded for all copies of a content."""
    can = hashable(F.col("format"))
    found = files.groupBy("sha256").agg(F.min_by(F.when(can, F.col("id")), F.when(can, F.col("path"))).alias("leader_id"), F.count(F.lit(1)).alias("copies"))
    return found.filter(F.col("leader_id").isNotNull())


def inherited(files: DataFrame) -> DataFrame:
    """`files` (sha256, source_id, phash, dhash) where a photo without hashes has those of an equal content in the same or an earlier source.

    Sources are read one after the other, so a later one's hashes do not reach back.
    """
    found = files.filter(F.col("phash").isNotNull()).groupBy("sha256").agg(F.min(F.struct("source_id", "phash", "dhash")).alias("h"))
    joined = files.join(found, "sha256", "left")
    use = F.col("phash").isNull() & (F.col("h.source_id") <= F.col("source_id"))
    return joined.withColumn("dhash", F.when(use, F.col("h.dhash")).otherwise(F.col("dhash"))).withColumn("phash", F.when(use, F.col("h.phash")).otherwise(F.col("phash"))).select(*files.columns)


def group_breaks(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """`rows` with `breaks`: whether a row starts another group than the row before it in (group, order)."""
    first = F.lag(F.lit(False), 1, True).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("breaks", first)


def within_seconds(rows: DataFrame, key: str, time: str, name: str, seconds: int) -> DataFrame:
    """Pairs (key, a, b, gap) of rows with equal key at most `seconds` apart, a < b by `name`.

    Times fall into buckets of that length; each row meets its own bucket and the
    next, so the join is on equal keys and finds each pair once.
    """
    base = rows.select(F.col(key).alias("k"), F.col(name).alias("n"), F.col(time).alias("t"), F.floor(F.col(time) / seconds).alias("bucket"))
    left = base.select("k", F.col("n").alias("n1"), F.col("t").alias("t1"), "bucket")
    right = base.select("k", F.col("n").alias("n2"), F.col("t").alias("t2"), F.col("bucket").alias("own"), F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"))
    pairs = left.join(right, ["k", "bucket"]).filter((F.abs(F.col("t1") - F.col("t2")) <= seconds) & ((F.col("own") > F.col("bucket")) | (F.col("n1") < F.col("n2"))))
    a, b = F.least("n1", "n2"), F.greatest("n1", "n2")
    return pairs.select(F.col("k").alias(key), a.alias("a"), b.alias("b"), F.abs(F.col("t1") - F.col("t2")).alias("gap")).filter("a <> b")
