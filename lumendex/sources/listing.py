"""File listings: supported media below a folder."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import file_extension
from ..schema import EXTENSIONS, format_of_extension

LISTED = "path string, size bigint, format string, mtime bigint"


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, format, mtime) of supported files below a folder, hidden ones too.

    Links are followed (each folder once); what cannot be read is skipped, and a
    folder that is missing lists as empty; mtime is whole seconds, 0 if unknown.
    The driver walks the folder; use `list_store` for stores that only Spark reads.
    """

    def walk() -> Iterator[tuple]:
        seen = set()
        for top, folders, names in os.walk(folder, followlinks=True):
            real = os.path.realpath(top)
            if real in seen:
                folders.clear()
                continue
            seen.add(real)
            for name in names:
                fmt = EXTENSIONS.get(os.path.splitext(name)[1][1:].lower())
                path = os.path.join(top, name)
                if fmt is None or not os.path.isfile(path):
                    continue
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                yield path, stat.st_size, fmt, max(0, int(stat.st_mtime))

    return spark.createDataFrame(list(walk()), LISTED)


def list_store(spark: SparkSession, folder: str) -> DataFrame:
    """As list_folder, by Spark's own distributed listing; files whose names begin with a dot or underscore are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    fmt = format_of_extension(F.lower(file_extension(F.col("path"))))
    rows = found.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), fmt.alias("format"),
        F.unix_seconds("modificationTime").alias("mtime"),
    )
    return rows.filter(F.col("format").isNotNull())
