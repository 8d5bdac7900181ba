"""Election of the best copy of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import tier


def rank_key() -> Column:
    """Order of copies, best first: format tier, larger size, earlier modification, lower id."""
    return F.struct(tier(F.col("format")), -F.col("size"), F.col("mtime"), F.col("id"))


def elect(members: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, source_of_truth_id): the best of each group's photos (group, id, format, size, mtime), by a map-side combined minimum."""
    return members.groupBy(group).agg(F.min_by("id", rank_key()).alias("source_of_truth_id"))
