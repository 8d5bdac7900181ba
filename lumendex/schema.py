"""Tables, formats and confidence levels."""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: Version of the perceptual hash; another stored one clears all hashes at the next scan.
PHASH_VERSION = "2"


class Format(NamedTuple):
    """A media format: display name, extension of its files, quality tier (0 best), perceptual hashing, raw."""

    format: str
    ext: str
    tier: int
    hashable: bool
    is_raw: bool


# Formats with their tiers, and the extensions they are recognised by.
FORMATS = (
    Format("CR2", "cr2", 0, False, True),
    Format("CR3", "cr3", 0, False, True),
    Format("NEF", "nef", 0, False, True),
    Format("ARW", "arw", 0, False, True),
    Format("ORF", "orf", 0, False, True),
    Format("RAF", "raf", 0, False, True),
    Format("RW2", "rw2", 0, False, True),
    Format("DNG", "dng", 0, False, True),
    Format("TIFF", "tiff", 1, True, False),
    Format("PNG", "png", 2, True, False),
    Format("JPEG", "jpg", 3, True, False),
    Format("HEIC", "heic", 4, False, False),
    Format("WebP", "webp", 5, True, False),
)
EXTENSIONS = {f.ext: f.format for f in FORMATS} | {"jpeg": "JPEG", "tif": "TIFF", "heif": "HEIC"}

# Confidence levels, least first.
CONFIDENCE = ("Low", "Probable", "High", "Near-Certain", "Certain")
LOW, PROBABLE, HIGH, NEAR_CERTAIN, CERTAIN = range(5)

# Table schemas as DDL.
SOURCES = "id bigint, path string, last_scanned bigint"
PHOTOS = (
    "id bigint, source_id bigint, path string, size bigint, format string, sha256 string, phash bigint, dhash bigint, mtime bigint, "
    "exif_date string, exif_camera_make string, exif_camera_model string, exif_gps_lat double, exif_gps_lon double, exif_width int, exif_height int"
)
GROUPS = "id bigint, source_of_truth_id bigint, confidence string"
MEMBERS = "group_id bigint, photo_id bigint"
CONFIG = "key string, value string"
PACK_FILES = (
    "sha256 string, original_filename string, format string, size bigint, exif_date string, camera_make string, camera_model string, added_at string"
)


def formats(spark: SparkSession) -> DataFrame:
    """The formats as a table of 13 rows."""
    return spark.createDataFrame(FORMATS, "format string, ext string, tier int, hashable boolean, is_raw boolean")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def tier(fmt: Column) -> Column:
    """Quality tier of a format name; unknown names count as JPEG."""
    return F.coalesce(F.try_element_at(_map({f.format: f.tier for f in FORMATS}), fmt), F.lit(3))


def hashable(fmt: Column) -> Column:
    """Whether a format can be hashed perceptually."""
    return F.coalesce(fmt.isin([f.format for f in FORMATS if f.hashable]), F.lit(False))


def extension(fmt: Column) -> Column:
    """Extension of a format name; an unknown name is its own."""
    return F.coalesce(F.try_element_at(_map({f.format: f.ext for f in FORMATS}), fmt), fmt)


def parse_format(name: Column) -> Column:
    """A known format name, or JPEG."""
    return F.when(name.isin([f.format for f in FORMATS]), name).otherwise(F.lit("JPEG"))


def format_of_extension(ext: Column) -> Column:
    """Format of a lower-cased extension, null if unsupported."""
    return F.try_element_at(_map(EXTENSIONS), ext)


def confidence_name(level: Column) -> Column:
    """Display form of a confidence level."""
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), level + 1)


def confidence_level(name: Column) -> Column:
    """Level of a display form; unknown ones are Low."""
    return F.coalesce(F.try_element_at(_map({c: i for i, c in enumerate(CONFIDENCE)}), name), F.lit(LOW))


def has_exif(prefix: str = "exif_") -> Column:
    """Whether stored metadata counts as present: by date, make, model or latitude."""
    parts = ("date", "camera_make", "camera_model", "gps_lat")
    return F.coalesce(*[F.col(prefix + p).isNotNull().cast("int") * F.when(F.col(prefix + p).isNotNull(), 1) for p in parts], F.lit(0)) == 1


def nested(photos: DataFrame) -> DataFrame:
    """Rows with the metadata as one struct, null where it counts as absent."""
    names = [c for c in photos.columns if c.startswith("exif_")]
    struct = F.struct(*[F.col(c).alias(c.removeprefix("exif_")) for c in names])
    return photos.select(*[c for c in photos.columns if c not in names], F.when(has_exif(), struct).alias("exif"))
