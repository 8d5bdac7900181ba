"""The catalogue: sources, scans, duplicate groups, packs and exports."""

from __future__ import annotations

import os
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .errors import ExportPathNotFound, PackPathNotFound, PackPathNotSet, SourceAlreadyExists, SourceNotDirectory, SourceNotFound, SourceNotRegistered
from .operators import archive, dml, reports
from .plans import matching
from .runtime import saved
from .sources import effects, listing, media
from .sources.store import Store

Progress = Callable[[str, dict], None]
TABLES = {"sources": schema.SOURCES, "photos": schema.PHOTOS, "groups": schema.GROUPS, "members": schema.MEMBERS, "config": schema.CONFIG}


def _silent(event: str, data: dict) -> None:
    """No progress."""


class Catalogue:
    """A catalogue in a folder; every method reads or makes a version of its tables."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalogue:
        """Open a catalogue, or make an empty one."""
        return cls(Store(spark, path, TABLES))

    @classmethod
    def temporary(cls, spark: SparkSession) -> Catalogue:
        """An empty catalogue in a folder of its own."""
        return cls.open(spark, "file://" + tempfile.mkdtemp(prefix="lumendex-catalogue-"))

    # tables

    def sources(self) -> DataFrame:
        """All sources."""
        return self.store.table("sources")

    def photos(self) -> DataFrame:
        """All photos."""
        return self.store.table("photos")

    def groups(self) -> DataFrame:
        """All duplicate groups."""
        return self.store.table("groups")

    def members(self) -> DataFrame:
        """All memberships."""
        return self.store.table("members")

    def known_mtimes(self, source_id: int) -> DataFrame:
        """(path, mtime) of a source's photos."""
        return self.photos().filter(F.col("source_id") == source_id).select("path", "mtime")

    def photo_mtime(self, path: str) -> int | None:
        """Stored modification time of one path, or None."""
        row = self.photos().filter(F.col("path") == path).select("mtime").first()
        return row["mtime"] if row else None

    def known_hashes(self, contents: DataFrame) -> DataFrame:
        """(sha256, phash, dhash) of those contents (sha256) that have hashes, each once."""
        rows = self.photos().filter("phash IS NOT NULL").join(contents.select("sha256").distinct(), "sha256", "left_semi")
        return rows.groupBy("sha256").agg(F.min_by(F.struct("phash", "dhash"), "id").alias("h")).select("sha256", "h.*")

    def get_config(self, key: str) -> str | None:
        """A setting, or None."""
        row = self.store.table("config").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def set_config(self, key: str, value: str) -> None:
        """Set a setting."""
        self.store.commit(config=dml.put_config(self.store.table("config"), key, value))

    # sources

    def add_source(self, path: str) -> int:
        """Register a folder; returns its id."""
        if not os.path.exists(path):
            raise SourceNotFound(path)
        if not os.path.isdir(path):
            raise SourceNotDirectory(path)
        real = os.path.realpath(path)
        if not self.sources().filter(F.col("path") == real).isEmpty():
            raise SourceAlreadyExists(real)
        new = self.store.mark("sources") + 1
        row = self.spark.createDataFrame([(new, real, None)], schema.SOURCES)
        self.store.commit({"sources": new}, sources=self.sources().unionByName(row))
        return new

    def remove_source(self, path: str) -> int:
        """Unregister a folder and drop its photos; returns how many. A folder that is gone is found by its name as given."""
        names = [os.path.realpath(path), path]
        row = self.sources().filter(F.col("path").isin(names)).first()
        if row is None:
            raise SourceNotRegistered(path)
        gone = self.photos().filter(F.col("source_id") == row["id"]).select("id")
        count = gone.count()
        photos, groups, members = dml.drop_photos(self.photos(), self.groups(), self.members(), gone)
        self.store.commit(sources=self.sources().filter(F.col("id") != row["id"]), photos=photos, groups=groups, members=members)
        return count

    # scan

    def scan(self, progress: Progress = _silent) -> dict[str, int]:
        """Read what is new or changed in all sources, drop what is gone, and resolve duplicates anew; counts of each."""
        photos = self.photos()
        config = self.store.table("config")
        if self.get_config("phash_version") != schema.PHASH_VERSION:
            photos = dml.reset_mtimes(dml.clear_hashes(photos))
            config = dml.put_config(config, "phash_version", schema.PHASH_VERSION)
        photos = saved(photos, "scan-photos")
        listed = self.spark.createDataFrame([], f"{listing.LISTED}, source_id long")
        sources = self.sources().orderBy("id").collect()  # a row a folder
        for s in sources:
            found = listing.list_folder(self.spark, s["path"]).withColumn("source_id", F.lit(s["id"]).cast("long"))
            progress("source", {"path": s["path"]})
            listed = listed.unionByName(found)
        listed = saved(listed, "scan-listed")
        stale = saved(photos.join(listed.select("path", "source_id"), ["path", "source_id"], "left_anti"), "scan-stale")
        # a file below two sources belongs to the later one
        owned = listed.join(listed.groupBy("path").agg(F.max("source_id").alias("source_id")), ["path", "source_id"])
        known = photos.select("path", "source_id", F.col("mtime").alias("_old"))
        work = owned.join(known, ["path", "source_id"], "left").filter(~F.col("_old").eqNullSafe(F.col("mtime"))).drop("_old")
        work = saved(work, "scan-work")
        fresh = saved(media.fingerprint(work), "scan-fresh")
        progress("fingerprinted", {"files": fresh.count()})
        fresh = saved(self._hashed(fresh, photos, stale, progress), "scan-hashed")
        left = photos.join(stale.select("id"), "id", "left_anti")
        # a path that moved to another source is listed there, and keeps its id
        moved = stale.join(fresh.select("path"), "path", "left_semi")
        high = self.store.mark("photos")
        after = saved(dml.upsert_photos(left.unionByName(moved), fresh, high), "scan-after")
        removed = stale.count() - moved.count()
        progress("removed", {"files": removed})
        groups, members = self._resolved(after)
        progress("resolved", {"groups": groups.count()})
        marks = {"photos": after.agg(F.max("id")).first()[0] or 0, "groups": groups.agg(F.max("id")).first()[0] or 0}
        now = F.lit(int(time.time())).cast("long")
        self.store.commit(marks, photos=after, groups=groups, members=members, config=config, sources=self.sources().withColumn("last_scanned", now))
        return {"read": fresh.count(), "removed": removed, "photos": after.count(), "groups": groups.count()}

    def _hashed(self, fresh: DataFrame, photos: DataFrame, stale: DataFrame, progress: Progress) -> DataFrame:
        """`fresh` with phash and dhash: known from equal contents, or else of each content's first hashable copy.

        Sources count as read in order of id: hashes found in one reach only itself and
        later ones, and those of a stale row only sources before its own.
        """
        cached = photos.filter("phash IS NOT NULL").join(stale.select("id").withColumn("gone", F.lit(True)), "id", "left")
        until = F.max(F.when(F.col("gone"), F.col("source_id") - 1).otherwise(F.lit((1 << 62))))
        cache = cached.groupBy("sha256").agg(F.min(F.struct("phash", "dhash")).alias("c"), until.alias("until"))
        rows = fresh.join(cache, "sha256", "left").withColumn("has", F.coalesce(F.col("source_id") <= F.col("until"), F.lit(False)))
        rows = saved(rows, "scan-cache")
        able = F.when(schema.hashable(F.col("format")), F.struct("source_id", "path", "format", "orientation"))
        leaders = rows.filter("NOT has").groupBy("sha256").agg(F.min(able).alias("l")).filter("l IS NOT NULL")
        leaders = saved(leaders.select("sha256", "l.*"), "scan-leaders")
        progress("analysing", {"contents": leaders.count()})
        made = media.perceptual_hashes(self.spark, leaders).join(leaders.select("sha256", F.col("source_id").alias("since")), "sha256")
        made = made.select("sha256", F.col("phash").alias("p"), F.col("dhash").alias("d"), "since")
        joined = rows.join(made, "sha256", "left")
        reach = F.col("since") <= F.col("source_id")
        joined = joined.withColumn("phash", F.when(F.col("has"), F.col("c.phash")).when(reach, F.col("p")))
        joined = joined.withColumn("dhash", F.when(F.col("has"), F.col("c.dhash")).when(reach, F.col("d")))
        return joined.withColumn("id", F.lit(None).cast("long")).select(*photos.columns)

    def _resolved(self, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
        groups, members = matching.resolve_duplicates(photos)
        base = self.store.mark("groups")
        stored = groups.select(
            (F.col("group_id") + base).alias("id"), "source_of_truth_id", schema.confidence_name(F.col("confidence")).alias("confidence")
        )
        return saved(stored, "groups"), saved(members.select((F.col("group_id") + base).alias("group_id"), "photo_id"), "members")

    def upsert_photos(self, rows: DataFrame) -> None:
        """Insert or replace photos by path, without resolving duplicates; sources must be known."""
        rows = dml.require_known(dml.require_unique(saved(rows, "upsert"), "path"), "source_id", self.sources())
        photos = saved(dml.upsert_photos(self.photos(), rows, self.store.mark("photos")), "upserted")
        self.store.commit({"photos": photos.agg(F.max("id")).first()[0] or 0}, photos=photos)

    def remove_photos(self, paths: DataFrame) -> int:
        """Drop photos by path, with their memberships and the groups that this ends; returns how many."""
        gone = saved(self.photos().join(paths.select("path").distinct(), "path", "left_semi").select("id"), "removed")
        photos, groups, members = dml.drop_photos(self.photos(), self.groups(), self.members(), gone)
        self.store.commit(photos=photos, groups=groups, members=members)
        return gone.count()

    def insert_group(self, photo_ids: list[int], best: int, confidence: str) -> int:
        """Add one group of known photos; returns its id."""
        new = self.store.mark("groups") + 1
        row = self.spark.createDataFrame([(new, best, confidence)], schema.GROUPS)
        rows = self.spark.createDataFrame([(new, i) for i in photo_ids], schema.MEMBERS)
        dml.require_known(rows.unionByName(row.select(F.col("id").alias("group_id"), F.col("source_of_truth_id").alias("photo_id"))), "photo_id", self.photos())
        dml.require_unique(rows, "group_id", "photo_id")
        self.store.commit({"groups": new}, groups=self.groups().unionByName(row), members=self.members().unionByName(rows))
        return new

    def clear_groups(self) -> None:
        """Drop all groups."""
        self.store.commit(groups=self.groups().limit(0), members=self.members().limit(0))

    def clear_hashes(self) -> int:
        """Drop all perceptual hashes; returns how many photos had them."""
        count = self.photos().filter("phash IS NOT NULL").count()
        self.store.commit(photos=dml.clear_hashes(self.photos()))
        return count

    def reset_mtimes(self) -> None:
        """Make the next scan read every file again."""
        self.store.commit(photos=dml.reset_mtimes(self.photos()))

    def replace_photos(self, photos: DataFrame) -> None:
        """Store a photo table and resolve its duplicates; paths and ids must be unique and sources known."""
        photos = saved(photos, "replace-photos")
        dml.require_unique(photos, "path")
        dml.require_unique(photos, "id")
        dml.require_known(photos, "source_id", self.sources())
        groups, members = self._resolved(photos)
        marks = {"photos": photos.agg(F.max("id")).first()[0] or 0, "groups": groups.agg(F.max("id")).first()[0] or 0}
        self.store.commit(marks, photos=photos, groups=groups, members=members)

    # reports

    def status(self) -> DataFrame:
        """Totals, one row."""
        return reports.overview(self.photos(), self.groups(), self.members())

    def stats(self) -> DataFrame:
        """Counts of sources, photos, groups and duplicates, one row."""
        return reports.catalogue_stats(self.sources(), self.photos(), self.groups(), self.members())

    def sources_report(self) -> DataFrame:
        """Sources with counts, sizes and scan times."""
        return reports.sources_report(self.sources(), self.photos())

    def files(self) -> DataFrame:
        """All files in report order."""
        return reports.ordered_files(reports.files_report(self.sources(), self.photos(), self.groups(), self.members()))

    def group_list(self) -> DataFrame:
        """All groups in order of id."""
        return reports.group_listing(self.photos(), self.groups(), self.members()).orderBy("group_id")

    def group(self, group_id: int) -> DataFrame:
        """Photos of one group; raises GroupNotFound."""
        return reports.group_detail(self.photos(), self.groups(), self.members(), group_id)

    # pack and export

    def set_pack_path(self, path: str) -> None:
        """Set the pack's folder, which becomes a source too."""
        real = os.path.realpath(path)
        if not os.path.isdir(real):
            raise PackPathNotFound(path)
        self.set_config("pack_path", real)
        try:
            self.add_source(real)
        except SourceAlreadyExists:
            pass

    def get_pack_path(self) -> str | None:
        """The pack's folder, or None."""
        return self.get_config("pack_path")

    def manifest(self, root: str) -> Store:
        """The manifest of a pack."""
        store = Store(self.spark, f"file://{root}/.lumendex", {"files": schema.PACK_FILES})
        with open(f"{root}/.lumendex/version.txt", "w", encoding="utf-8") as f:
            f.write(f"{schema.SCHEMA_VERSION}\n")
        return store

    def manifest_version(self, root: str) -> int:
        """Version of a pack's manifest."""
        return int(self.manifest(root).state()["schema_version"])

    def pack(self, progress: Progress = _silent) -> dict[str, int]:
        """Copy every content to keep into the pack, bring the manifest up to date, and delete what is no longer wanted."""
        root = self.get_pack_path()
        if root is None:
            raise PackPathNotSet("set a pack path first")
        if not os.path.isdir(root):
            raise PackPathNotFound(root)
        store = self.manifest(root)
        plan = saved(archive.pack_plan(archive.selected(self.photos(), self.groups(), self.members()), root), "pack-plan")
        progress("pack", {"total": plan.count()})
        done = saved(effects.copy_files(plan), "pack-done")
        manifest = store.table("files")
        entry = [
            "sha256", "original_filename", "format", "size", "exif_date", F.col("exif_camera_make").alias("camera_make"),
            F.col("exif_camera_model").alias("camera_model"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("added_at"), F.lit(1).alias("seq"),
        ]
        new = done.filter("status = 'copied'").unionByName(archive.missing_entries(manifest, done.filter("status = 'skipped'")))
        merged = saved(dml.replace_files(manifest, new.select(*entry)), "pack-manifest")
        stale = saved(archive.stale_files(merged, plan, root), "pack-stale")
        gone = saved(effects.delete_files(stale), "pack-gone")
        store.commit(files=merged.join(gone.select("sha256"), "sha256", "left_anti"))
        counts = {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}
        result = {"copied": counts.get("copied", 0), "skipped": counts.get("skipped", 0), "removed": gone.filter("status = 'removed'").count()}
        progress("packed", result)
        return result

    def export(self, path: str, quality: int = 85, encoder: effects.Encoder | None = None, progress: Progress = _silent) -> dict[str, int]:
        """Convert every photo to keep into a dated folder; existing targets are skipped, failures left out of the counts.

        Of photos with one target the first by id is converted, and the others count as skipped.
        """
        if not os.path.isdir(path):
            raise ExportPathNotFound(path)
        encoder = encoder or effects.find_encoder()
        plan = archive.export_plan(archive.selected(self.photos(), self.groups(), self.members()), os.path.realpath(path))
        first = F.min(F.struct("id", "source")).alias("r")
        plan = plan.groupBy("target").agg(first, F.count(F.lit(1)).alias("n")).select("r.*", "target", "n")  # equal names of a day share a place
        plan = saved(plan, "export-plan")
        progress("export", {"total": plan.count()})
        done = saved(effects.convert_files(plan, encoder, quality), "export-done")
        counts = {r["status"]: (r["first"], r["all"]) for r in done.groupBy("status").agg(F.count(F.lit(1)).alias("first"), F.sum("n").alias("all")).collect()}
        made, there = counts.get("copied", (0, 0)), counts.get("skipped", (0, 0))
        result = {"converted": made[0], "skipped": there[1] + made[1] - made[0]}
        progress("exported", result)
        return result

