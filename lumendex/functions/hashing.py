"""Perceptual hashes and their distances as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NEAR_CERTAIN, PROBABLE

#: A grid has 8 rows of 9 values.
ROWS, COLS = 8, 9


def _bits(flags: Column) -> Column:
    """A bigint whose bit i is flags[i]; bit 63 is the sign."""
    picked = F.transform(flags, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def average_hash(grid: Column) -> Column:
    """64 bits: which of the left 8 values of each row reach their (whole) mean."""
    left = F.filter(grid, lambda x, i: i % COLS < COLS - 1)
    mean = F.call_function("div", F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(ROWS * (COLS - 1)).cast("long"))
    return _bits(F.transform(left, lambda x: x >= mean))


def average_hash_real(grid: Column) -> Column:
    """As average_hash over 64 real numbers, with a real mean."""
    mean = F.aggregate(grid, F.lit(0.0), lambda a, x: a + x) / 64
    return _bits(F.transform(grid, lambda x: x >= mean))


def difference_hash(grid: Column) -> Column:
    """64 bits: which values are above their right neighbour."""
    here = F.filter(grid, lambda x, i: i % COLS < COLS - 1)
    right = F.filter(grid, lambda x, i: i % COLS > 0)
    return _bits(F.zip_with(here, right, lambda a, b: a > b))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two bigints."""
    return F.bit_count(a.bitwiseXOR(b))


def confidence_of_distance(d: Column) -> Column:
    """Confidence level of a distance: near-certain up to 2, probable at 3, null above."""
    return F.when(d <= 2, NEAR_CERTAIN).when(d <= 3, PROBABLE)


def consensus(p1: Column, d1: Column, p2: Column, d2: Column) -> Column:
    """Confidence level of two photos by both hashes; by a stricter first one alone where a second is missing; null for no match."""
    first = confidence_of_distance(hamming(p1, p2))
    second = confidence_of_distance(hamming(d1, d2))
    both = d1.isNotNull() & d2.isNotNull()
    return F.when(both & first.isNotNull() & second.isNotNull(), F.least(first, second)).when(~both & (hamming(p1, p2) <= 2), first)


def strict_consensus(p1: Column, d1: Column, p2: Column, d2: Column) -> Column:
    """Whether two photos match within 2 bits on every hash both have."""
    return (hamming(p1, p2) <= 2) & F.coalesce(hamming(d1, d2) <= 2, F.lit(True))


def all_of(*conditions: Column) -> Column:
    """Conjunction."""
    return reduce(lambda a, b: a & b, conditions)
