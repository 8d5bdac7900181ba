"""Paths, file names and display text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import extension


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    """Extension without the dot; null without one (a leading dot is part of the name)."""
    found = F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)
    return F.when(found != "", found)


def file_stem(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_extract(file_name(path), r"^(.+?)(\.[^.]*)?$", 1)


def display_name(path: Column) -> Column:
    """Last component that is not empty, or the whole path."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1)), path)


def content_path(root: Column, sha256: Column, fmt: Column) -> Column:
    """Content address in a pack: root, first two digits, digest and extension."""
    return F.concat_ws("/", root, F.substring(sha256, 1, 2), F.concat(sha256, F.lit("."), extension(fmt)))


def export_path(root: Column, date: Column, path: Column) -> Column:
    """Place of an exported copy, by date and name; equal names of a day share a place."""
    folder = F.format_string("%04d/%02d/%02d", date["year"], date["month"], date["day"])
    return F.concat_ws("/", root, folder, F.concat(file_stem(path), F.lit(".heic")))


def human_size(size: Column) -> Column:
    """Bytes as text in steps of 1024, with one decimal (ties to even) from KB on; GB is the largest unit."""
    def scaled(k: int, unit: str) -> Column:
        return F.format_string(f"%.1f {unit}", F.bround((size / F.lit(1024.0**k)).cast("decimal(38,18)"), 1).cast("double"))

    return (
        F.when(size < 1024, F.format_string("%d B", size.cast("long")))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def scanned_at(seconds: Column) -> Column:
    """Time of a scan as text; `never` for null, `unknown` outside years 0 to 9999."""
    inside = seconds.between(-62167219200, 253402300799)
    text = F.date_format(F.timestamp_seconds(F.when(inside, seconds)), "yyyy-MM-dd HH:mm:ss")
    return F.when(seconds.isNull(), "never").otherwise(F.coalesce(text, F.lit("unknown")))


def path_order(path: Column) -> Column:
    """Sort key that orders paths component by component."""
    return F.split(path, "/")
