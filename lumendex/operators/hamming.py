"""Similarity self-join of 64-bit hashes without comparing all pairs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hamming


def block_keys(value: Column, most: int) -> Column:
    """Keys of which two values share at least one if they differ in at most `most` bits.

    The 64 bits are cut into most + 2 blocks; so many differing bits leave two
    blocks at least untouched, so every pair of blocks is a key.  With 3 bits that
    makes ten keys of about 26 bits: a key holds few of even a billion hashes.
    """
    count = most + 2
    edges = [round(i * 64 / count) for i in range(count + 1)]

    def block(i: int) -> Column:
        mask = (1 << (edges[i + 1] - edges[i])) - 1
        return F.shiftrightunsigned(value, edges[i]).bitwiseAND(F.lit(mask).cast("long"))

    keys = [
        F.shiftleft(block(i), edges[j + 1] - edges[j]).bitwiseOR(block(j)) * 64 + n for n, (i, j) in enumerate(combinations(range(count), 2))
    ]  # the number of the pair is part of the key
    return F.array(*keys)


def hamming_pairs(values: DataFrame, column: str, most: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (within..., a, b, distance) of distinct values a < b of `column` that differ in 1 to `most` bits.

    Values are made distinct first (per `within`), so that equal hashes, however
    many, cost nothing; expand by joining back.  Nulls never match.
    """
    distinct = values.filter(F.col(column).isNotNull()).select(*within, F.col(column).alias("h")).distinct()
    keyed = distinct.select(*within, "h", F.explode(block_keys(F.col("h"), most)).alias("_block"))
    a, b = keyed.withColumnRenamed("h", "a"), keyed.withColumnRenamed("h", "b")
    pairs = a.join(b, [*within, "_block"]).filter(F.col("a") < F.col("b"))
    pairs = pairs.withColumn("distance", hamming(F.col("a"), F.col("b"))).filter(F.col("distance") <= most)
    return pairs.select(*within, "a", "b", "distance").distinct()
