"""Changes to catalogue tables, each as a new version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IntegrityError
from ..runtime import dense_ids


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """`df`, or IntegrityError if a key repeats."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise IntegrityError(f"{', '.join(keys)} must be unique")
    return df


def require_known(df: DataFrame, key: str, other: DataFrame, other_key: str = "id") -> DataFrame:
    """`df`, or IntegrityError if `key` points to no row of `other`."""
    if not df.join(other.select(F.col(other_key).alias(key)), key, "left_anti").isEmpty():
        raise IntegrityError(f"{key} has no {other_key}")
    return df


def upsert_photos(photos: DataFrame, incoming: DataFrame, high: int | None = None) -> DataFrame:
    """Photos after inserting or replacing by path: a known path keeps its id, new ones get ids above `high` by path."""
    if high is None:
        high = photos.agg(F.max("id")).first()[0] or 0
    fresh = incoming.drop("id")
    known = fresh.join(photos.select("id", "path"), "path")
    added = dense_ids(fresh.join(photos.select("path"), "path", "left_anti"), ["source_id", "path"], "id", high + 1)
    rest = photos.join(fresh.select("path"), "path", "left_anti")
    return rest.unionByName(known.select(*photos.columns)).unionByName(added.select(*photos.columns))


def drop_photos(photos: DataFrame, groups: DataFrame, members: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without photos `gone` (id): memberships go, and groups whose best copy is gone or that have no member left."""
    photo = gone.select(F.col("id").alias("photo_id"))
    left = photos.join(gone.select("id"), "id", "left_anti")
    dead = groups.join(photo.withColumnRenamed("photo_id", "source_of_truth_id"), "source_of_truth_id", "left_semi").select(F.col("id").alias("group_id"))
    kept = members.join(photo, "photo_id", "left_anti").join(dead, "group_id", "left_anti")
    alive = groups.join(kept.select(F.col("group_id").alias("id")).distinct(), "id", "left_semi")
    return left, alive, kept.select("group_id", "photo_id")


def clear_hashes(photos: DataFrame) -> DataFrame:
    """Photos without perceptual hashes."""
    none = F.lit(None).cast("long")
    return photos.withColumn("phash", none).withColumn("dhash", none)


def reset_mtimes(photos: DataFrame) -> DataFrame:
    """Photos with modification time 0, so that the next scan reads them again."""
    return photos.withColumn("mtime", F.lit(0).cast("long"))


def put_config(config: DataFrame, key: str, value: str) -> DataFrame:
    """Settings with one replaced or added."""
    return config.filter(F.col("key") != key).unionByName(config.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def replace_files(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """A pack's manifest after inserting or replacing by sha256; of several incoming rows the last by `seq` holds."""
    cols = [c for c in incoming.columns if c != "seq"]
    last = incoming.groupBy("sha256").agg(F.max_by(F.struct(*cols), "seq").alias("r")).select("r.*")
    return manifest.join(last.select("sha256"), "sha256", "left_anti").select(*manifest.columns).unionByName(last.select(*manifest.columns))
