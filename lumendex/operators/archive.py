"""Plans of packs and exports; nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import asset_date
from ..functions.paths import content_path, export_path, file_name


def selected(photos: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Photos that are in no group, or the best copy of one."""
    alone = photos.join(members.select(F.col("photo_id").alias("id")), "id", "left_anti")
    best = photos.join(groups.select(F.col("source_of_truth_id").alias("id")), "id", "left_semi").join(members.select(F.col("photo_id").alias("id")), "id", "left_semi")
    return alone.unionByName(best)


def pack_plan(chosen: DataFrame, root: str) -> DataFrame:
    """(sha256, source, target, ...) of each content to keep; of several photos of one content the first by path."""
    cols = [F.col("path"), content_path(F.lit(root), F.col("sha256"), F.col("format")).alias("target"), F.col("format"), F.col("size"), F.col("exif_date"), F.col("exif_camera_make"), F.col("exif_camera_model")]
    first = chosen.groupBy("sha256").agg(F.min(F.struct(*cols)).alias("r")).select("sha256", "r.*")
    return first.withColumn("original_filename", file_name(F.col("path"))).withColumnRenamed("path", "source")


def export_plan(chosen: DataFrame, root: str) -> DataFrame:
    """(id, source, target): each photo's place by date."""
    date = asset_date(F.col("exif_date"), F.col("mtime"))
    return chosen.select("id", F.col("path").alias("source"), export_path(F.lit(root), date, F.col("path")).alias("target"))


def stale_files(manifest: DataFrame, plan: DataFrame, root: str) -> DataFrame:
    """(sha256, target) of manifest entries whose content is no longer wanted."""
    gone = manifest.join(plan.select("sha256"), "sha256", "left_anti")
    return gone.select("sha256", content_path(F.lit(root), F.col("sha256"), F.col("format")).alias("target"))


def missing_entries(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned contents that the manifest does not know."""
    return plan.join(manifest.select("sha256"), "sha256", "left_anti")
