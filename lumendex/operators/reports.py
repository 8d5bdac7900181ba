"""Reports over a catalogue: totals, sources, files, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GroupNotFound
from ..functions.paths import display_name, file_name, human_size, path_order, scanned_at
from ..schema import nested


def _long(c):
    return F.coalesce(c, F.lit(0)).cast("long")


def roles(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(photo_id, group_id, is_sot): each grouped photo's last group, and whether it is the best copy there."""
    joined = members.join(groups.select(F.col("id").alias("group_id"), "source_of_truth_id"), "group_id")
    last = F.max_by(F.struct("group_id", (F.col("photo_id") == F.col("source_of_truth_id")).alias("is_sot")), "group_id")
    return joined.groupBy("photo_id").agg(last.alias("g")).select("photo_id", "g.group_id", "g.is_sot")


def with_roles(photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """`photos` with group_id, is_sot (null outside groups), is_duplicate and eligible."""
    joined = photos.join(roles(groups, members).withColumnRenamed("photo_id", "id"), "id", "left")
    return joined.withColumn("is_duplicate", F.coalesce(~F.col("is_sot"), F.lit(False))).withColumn("eligible", ~F.col("is_duplicate"))


def overview(photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: photos, groups, duplicates, unique, disk_bytes, savings_bytes."""
    rows = with_roles(photos, groups, members)
    dup = F.col("is_duplicate")
    totals = rows.agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(dup).alias("duplicates"), _long(F.sum("size")).alias("disk_bytes"),
        _long(F.sum(F.when(dup, F.col("size")))).alias("savings_bytes"),
    )
    count = groups.agg(F.count(F.lit(1)).alias("groups"))
    return totals.join(F.broadcast(count)).select("photos", "groups", "duplicates", (F.col("photos") - F.col("duplicates")).alias("unique"), "disk_bytes", "savings_bytes")


def catalogue_stats(sources: DataFrame, photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """One row: sources, photos, groups, and duplicates as distinct members that are not their group's best copy."""
    pairs = members.join(groups.select(F.col("id").alias("group_id"), "source_of_truth_id"), "group_id")
    dup = pairs.filter("photo_id <> source_of_truth_id").agg(F.count_distinct("photo_id").alias("duplicates"))
    out = sources.agg(F.count(F.lit(1)).alias("sources"))
    for df, name in ((photos, "photos"), (groups, "groups")):
        out = out.join(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))
    return out.join(F.broadcast(dup)).select("sources", "photos", "groups", "duplicates")


def source_stats(photos: DataFrame) -> DataFrame:
    """(source_id, photo_count, total_size)."""
    return photos.groupBy("source_id").agg(F.count(F.lit(1)).alias("photo_count"), F.sum("size").cast("long").alias("total_size"))


def sources_report(sources: DataFrame, photos: DataFrame) -> DataFrame:
    """(id, name, photo_count, size, last_scanned) of every source, with those without photos."""
    joined = sources.join(source_stats(photos).withColumnRenamed("source_id", "id"), "id", "left")
    return joined.select(
        "id", display_name(F.col("path")).alias("name"), _long(F.col("photo_count")).alias("photo_count"),
        human_size(_long(F.col("total_size"))).alias("size"), scanned_at(F.col("last_scanned")).alias("last_scanned"),
    )


def files_report(sources: DataFrame, photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(id, name, source, format, size, group_id, role, eligible, path) of every file; `ordered_files` puts it in order."""
    names = sources.select(F.col("id").alias("source_id"), display_name(F.col("path")).alias("source"))
    rows = with_roles(photos, groups, members).join(names, "source_id", "left")
    role = F.when(F.col("is_sot"), "Best Copy").when(F.col("is_duplicate"), "Duplicate").otherwise("Unique")
    return rows.select(
        "id", file_name(F.col("path")).alias("name"), F.coalesce("source", F.lit("?")).alias("source"), "format", human_size(F.col("size")).alias("size"),
        "group_id", role.alias("role"), "eligible", "path",
    )


def ordered_files(report: DataFrame) -> DataFrame:
    """Grouped files by group, best copy first, then the others; each by path, component by component."""
    return report.orderBy(F.col("group_id").isNull(), "group_id", F.col("role") != "Best Copy", path_order(F.col("path")))


def group_listing(photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, confidence, members, total_size, best) of every group; best is `?` if its photo is gone."""
    joined = groups.withColumnRenamed("id", "group_id").join(members, "group_id").join(photos.select(F.col("id").alias("photo_id"), "path", "size"), "photo_id")
    best = F.max(F.when(F.col("photo_id") == F.col("source_of_truth_id"), F.col("path")))
    return joined.groupBy("group_id", "confidence").agg(
        F.count(F.lit(1)).alias("members"), F.sum("size").cast("long").alias("total_size"), F.coalesce(best, F.lit("?")).alias("best")
    )


def duplicate_groups(photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with their photos nested: (id, source_of_truth_id, confidence, members sorted by id)."""
    rows = nested(photos).withColumnRenamed("id", "photo_id")
    cols = [c for c in rows.columns if c != "photo_id"]
    struct = F.struct(F.col("photo_id").alias("id"), *cols)
    listed = members.join(rows, "photo_id").groupBy(F.col("group_id").alias("id")).agg(F.array_sort(F.collect_list(struct)).alias("members"))
    return groups.join(listed, "id").select("id", "source_of_truth_id", "confidence", "members")


def group_detail(photos: DataFrame, groups: DataFrame, members: DataFrame, group_id: int) -> DataFrame:
    """Photos of one group with a mark for the best copy; raises GroupNotFound."""
    head = groups.filter(F.col("id") == group_id)
    if head.isEmpty():
        raise GroupNotFound(str(group_id))
    mine = members.filter(F.col("group_id") == group_id).join(head.select(F.col("id").alias("group_id"), "source_of_truth_id", "confidence"), "group_id")
    rows = mine.join(photos.withColumnRenamed("id", "photo_id"), "photo_id")
    mark = F.when(F.col("photo_id") == F.col("source_of_truth_id"), "*").otherwise("")
    return rows.select("group_id", "confidence", "photo_id", mark.alias("best"), "path", "format", "size", "sha256")
