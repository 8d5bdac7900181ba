"""Registered queries over the `assets` view and the `events` and `embeddings` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, hashing, paths
from ..operators import archive, dml, incremental, ranking, reports
from ..operators.components import components
from ..operators.hamming import hamming_pairs
from ..runtime import dense_ids, saved
from ..schema import confidence_name, format_of_extension, formats, has_exif, hashable
from . import matching
from .assets import assets, listed_assets, word_grid


def _text(*names: str) -> list:
    """Whole numbers that may be null, as text: readers differ in how they show such numbers."""
    return [F.col(n).cast("string").alias(n) for n in names]


def _photos(spark: SparkSession, sf: str) -> DataFrame:
    return assets(spark, sf)


def _sources(photos: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/media/src"), (F.col("id") - 1).cast("string"))
    scanned = F.when(F.col("id") % 3 != 0, F.lit(1700000000) + F.col("id"))
    return photos.select(F.col("source_id").alias("id")).distinct().select("id", path.alias("path"), scanned.cast("long").alias("last_scanned"))


def _idle(photos: DataFrame) -> DataFrame:
    """Beside every source one that has no photos yet."""
    return _sources(photos).withColumn("id", F.col("id") + 1000).withColumn("path", F.concat("path", F.lit("-new"))).withColumn("last_scanned", F.lit(None).cast("long"))


def _orphaned(photos: DataFrame) -> DataFrame:
    """All photos, those of every fourth source under an id that no source has."""
    return photos.withColumn("source_id", F.when(F.col("source_id") % 4 == 0, F.col("source_id") + 1000).otherwise(F.col("source_id")))


def _stored(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members of equal content, numbered by least id."""
    found = matching.exact_groups(photos)
    heads = dense_ids(found.groupBy("group").agg(F.min("confidence").alias("confidence")), ["group"], "group_id")
    members = found.join(heads.select("group", "group_id"), "group").select("group_id", F.col("id").alias("photo_id"))
    best = ranking.elect(members.join(photos.select(F.col("id").alias("photo_id"), "id", "format", "size", "mtime"), "photo_id"))
    groups = heads.join(best, "group_id").select(F.col("group_id").alias("id"), "source_of_truth_id", confidence_name(F.col("confidence")).alias("confidence"))
    return groups, members


def format_dim_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = listed_assets(spark.read.parquet(f"{sf}/documents.parquet")).select("id", "path")
    rows = rows.withColumn("format", format_of_extension(F.lower(paths.file_extension(F.col("path")))))
    return rows.join(F.broadcast(formats(spark)), "format").select("id", "format", "ext", "tier", "hashable", "is_raw")


def sha256_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return listed_assets(spark.read.parquet(f"{sf}/documents.parquet")).select("id", "sha256")


def ahash_dhash_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = word_grid(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).select("doc_id", "grid")
    return rows.select("doc_id", hashing.average_hash(F.col("grid")).alias("phash"), hashing.difference_hash(F.col("grid")).alias("dhash"))


def ahash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter(F.size("embedding") == 64)
    return rows.select("vec_id", hashing.average_hash_real(F.col("embedding").cast("array<double>")).alias("phash"))


def exact_groups(spark: SparkSession, sf: str) -> DataFrame:
    return matching.exact_groups(_photos(spark, sf))


def hash_inherit(spark: SparkSession, sf: str) -> DataFrame:
    can = hashable(F.col("format"))
    own = _photos(spark, sf).withColumn("phash", F.when(can, F.col("phash"))).withColumn("dhash", F.when(can, F.col("dhash")))
    return incremental.inherited(own.select("id", "source_id", "sha256", "phash", "dhash")).select("id", *_text("phash", "dhash"))


def leader_per_sha(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.leaders(listed_assets(spark.read.parquet(f"{sf}/documents.parquet")))


def exif_key_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = _photos(spark, sf).select("id", dates.exif_key(F.col("exif_date"), F.col("exif_camera_model")).alias("exif_key"))
    return rows.filter("exif_key IS NOT NULL").groupBy("exif_key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id")).filter("n >= 2")


def _date_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Capture dates in several spellings, some unreadable."""
    n, d = F.col("id") % 6, F.col("exif_date")
    text = (
        F.when(n == 0, F.translate(d, "-", ":")).when(n == 1, F.substring(d, 1, 10)).when(n == 2, F.concat(d, F.lit(":x")))
        .when(n == 5, F.concat(F.substring(d, 1, 11), F.lit("12:-5:00")))
        .when(n == 3, F.concat(F.lit("x-"), d)).when(n == 4, F.replace(d, F.lit("2024"), F.lit("1969"))).otherwise(d)
    )
    return _photos(spark, sf).select("id", "mtime", text.alias("taken"))


def exif_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return _date_texts(spark, sf).select("id", dates.exif_seconds(F.col("taken")).cast("string").alias("seconds"))


def exif_date_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _date_texts(spark, sf).select("id", dates.exif_date(F.col("taken")).alias("d")).select("id", "d.*").select("id", *_text("year", "month", "day"))


def asset_date(spark: SparkSession, sf: str) -> DataFrame:
    return _date_texts(spark, sf).select("id", dates.asset_date(F.col("taken"), F.col("mtime")).alias("d")).select("id", "d.year", "d.month", "d.day")


def exif_validated_members(spark: SparkSession, sf: str) -> DataFrame:
    return matching.capture_members(saved(_photos(spark, sf), "photos")).select(F.col("key").alias("exif_key"), "id", "validated", "hashed")


def exif_groups_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return matching.capture_groups(saved(_photos(spark, sf), "photos"))


def hamming_within_3(spark: SparkSession, sf: str) -> DataFrame:
    pairs = hamming_pairs(_photos(spark, sf), "phash", 3)
    return pairs.withColumn("confidence", hashing.confidence_of_distance(F.col("distance")))


def accepted_edges(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    grouped = matching.exact_groups(photos).unionByName(matching.capture_groups(photos))
    edges = matching.accepted_kinds(saved(matching.photo_kinds(photos, grouped), "kinds"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence").filter("a <> b")


def sequential_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return incremental.within_seconds(rows, "user_id", "t", "event_id", 60_000_000)


def perceptual_greedy_groups(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    grouped = saved(matching.exact_groups(photos).unionByName(matching.capture_groups(photos)), "early")
    return matching.perceptual_groups(photos, grouped)


def merged_groups(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    early = saved(matching.exact_groups(photos).unionByName(matching.capture_groups(photos)), "early")
    return matching.merge_groups(photos, early)


def final_groups(spark: SparkSession, sf: str) -> DataFrame:
    groups, members = matching.resolve_duplicates(saved(_photos(spark, sf), "photos"))
    return members.join(groups, "group_id").select("group_id", "photo_id", "source_of_truth_id", confidence_name(F.col("confidence")).alias("confidence"))


def components_exact_exif(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    found = matching.exact_groups(photos).unionByName(matching.capture_groups(photos))
    return components(found.select(F.col("group").alias("a"), F.col("id").alias("b")))


def elect_sot(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(saved(_photos(spark, sf), "photos"))[0]


def status_overview(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    return reports.overview(photos, *_stored(photos))


def db_stats_summary(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    return reports.catalogue_stats(_sources(photos), photos, *_stored(photos))


def source_stats(spark: SparkSession, sf: str) -> DataFrame:
    return reports.source_stats(_photos(spark, sf))


def sources_report(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    return reports.sources_report(_sources(photos).unionByName(_idle(photos)), photos)


def files_report(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    found = reports.files_report(_sources(photos), _orphaned(photos), *_stored(photos))
    return reports.ordered_files(found).withColumn("group_id", F.col("group_id").cast("string"))


def group_listing(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    return reports.group_listing(photos, *_stored(photos))


def group_detail(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    return reports.group_detail(photos, *_stored(photos), 1)


def grouped_photos(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    nested = reports.duplicate_groups(photos, *_stored(photos))
    flat = nested.select("id", "confidence", F.explode("members").alias("m"))
    return flat.select(F.col("id").alias("group_id"), "confidence", F.col("m.id").alias("photo_id"), "m.path", F.col("m.exif.date").alias("taken"))


def metadata_present(spark: SparkSession, sf: str) -> DataFrame:
    return _photos(spark, sf).select("id", has_exif().alias("present"))


def export_selection(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    return archive.selected(photos, *_stored(photos)).select("id", "path")


def content_paths(spark: SparkSession, sf: str) -> DataFrame:
    return archive.pack_plan(_photos(spark, sf), "/pack").select("sha256", "source", "target", "original_filename")


def export_paths(spark: SparkSession, sf: str) -> DataFrame:
    return archive.export_plan(_photos(spark, sf), "/export")


def _listing(photos: DataFrame) -> DataFrame:
    """A later listing: some files gone, some touched to an earlier or later time, some new."""
    moved = F.when(F.col("id") % 17 == 0, F.col("mtime") - 5).when(F.col("id") % 19 == 0, F.col("mtime") + 5).otherwise(F.col("mtime"))
    kept = photos.filter(F.col("id") % 13 != 0).withColumn("mtime", moved)
    new = photos.filter(F.col("id") % 23 == 0).withColumn("path", F.concat("path", F.lit(".new.jpg")))
    return kept.unionByName(new)


def incremental_changed(spark: SparkSession, sf: str) -> DataFrame:
    photos = listed_assets(spark.read.parquet(f"{sf}/documents.parquet")).select("id", "path", "mtime")
    return incremental.changed(_listing(photos).select("path", "mtime"), photos)


def incremental_stale(spark: SparkSession, sf: str) -> DataFrame:
    photos = listed_assets(spark.read.parquet(f"{sf}/documents.parquet")).select("id", "path", "mtime")
    return incremental.stale(_listing(photos), photos).select("id", "path")


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    incoming = _listing(photos.withColumn("size", F.col("size") + 1))
    return dml.upsert_photos(photos, incoming).select("id", "source_id", "path", "size", "mtime")


def cascade_delete_source(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    groups, members = _stored(photos)
    left, alive, kept = dml.drop_photos(photos, groups, members, photos.filter("source_id = 1").select("id"))
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "photos"), (alive, "groups"), (kept, "members"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))


def invalidate_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return dml.reset_mtimes(dml.clear_hashes(_photos(spark, sf))).select("id", *_text("phash", "dhash"), "mtime")


def _packed_before(photos: DataFrame) -> DataFrame:
    """All photos as they were at an earlier pack: some with another content since, some in another format."""
    other = F.when(F.col("id") % 3 == 0, F.sha2(F.concat(F.col("sha256"), F.lit("-before")).cast("binary"), 256)).otherwise(F.col("sha256"))
    return photos.withColumn("sha256", other).withColumn("size", F.col("size") + F.when(F.col("id") % 2 == 0, 7).otherwise(0))


def _manifest(photos: DataFrame) -> DataFrame:
    """One entry per content of the earlier pack."""
    return archive.pack_plan(_packed_before(photos), "/pack").select("sha256", "original_filename", "format", "size")


def manifest_replace(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    incoming = photos.select("sha256", paths.file_name(F.col("path")).alias("original_filename"), "format", "size", F.col("id").alias("seq"))
    return dml.replace_files(_manifest(photos), incoming)


def manifest_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    photos = saved(_photos(spark, sf), "photos")
    plan, manifest = archive.pack_plan(photos, "/pack"), _manifest(photos)
    gone = archive.stale_files(manifest, plan, "/pack").select("sha256", "target", F.lit("remove").alias("action"))
    return gone.unionByName(archive.missing_entries(manifest, plan).select("sha256", "target", F.lit("add").alias("action")))


def human_sizes(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    size = F.when(n % 4 == 0, n).when(n % 4 == 1, n * 1000 + 77).when(n % 4 == 2, n * 1_234_567).otherwise(n * 98_765_432_1)
    return listed_assets(spark.read.parquet(f"{sf}/documents.parquet")).select("id", paths.human_size(size.cast("long")).alias("text"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of the catalogue after resolving all duplicates."""
    photos = saved(_photos(spark, sf), "photos")
    groups, members = matching.resolve_duplicates(photos)
    stored = groups.select(F.col("group_id").alias("id"), "source_of_truth_id", confidence_name(F.col("confidence")).alias("confidence"))
    return reports.overview(photos, stored, members)


QUERIES = {
    f.__name__: f
    for f in (
        format_dim_join, sha256_fingerprint, ahash_dhash_words, ahash_embeddings, exact_groups, hash_inherit, leader_per_sha, exif_key_groups,
        exif_seconds, exif_date_parts, asset_date, exif_validated_members, exif_groups_confidence, hamming_within_3, accepted_edges, sequential_events,
        perceptual_greedy_groups, merged_groups, final_groups, components_exact_exif, elect_sot, status_overview, db_stats_summary, source_stats,
        sources_report, files_report, group_listing, group_detail, grouped_photos, metadata_present, export_selection, content_paths, export_paths,
        incremental_changed, incremental_stale, upsert_merge, cascade_delete_source, invalidate_hashes, manifest_replace, manifest_cleanup, human_sizes, flagship,
    )
}
