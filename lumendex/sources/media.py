"""Media files to catalogue rows: digests, metadata and perceptual hashes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, spread
from ..schema import hashable
from . import exif, pixels

CHUNK = 1 << 16
_EXIF = "exif_date string, exif_camera_make string, exif_camera_model string, exif_gps_lat double, exif_gps_lon double, exif_width int, exif_height int"


def sha256_of(path: str) -> str | None:
    """Hex digest of a file, read in chunks; None if it cannot be read."""
    digest = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while block := f.read(CHUNK):
                digest.update(block)
    except OSError:
        return None
    return digest.hexdigest()


def metadata_of(path: str) -> exif.Exif | None:
    """Capture data of a file; None if it has none, or is damaged."""
    try:
        with open(path, "rb") as f:
            return exif.read(f)
    except (OSError, ValueError, IndexError, struct.error):
        return None


def fingerprint(files: DataFrame) -> DataFrame:
    """`files` (path, size, ...) with sha256, capture data and orientation; files that cannot be read are left out."""
    ship(files.sparkSession)
    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes) + f", sha256 string, {_EXIF}, orientation int"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in _EXIF.split(", ")] + ["orientation"]
        for frame in frames:
            frame = frame.assign(sha256=[sha256_of(p) for p in frame["path"]])
            frame = frame[frame["sha256"].notna()]
            found = [metadata_of(p) or exif.Exif() for p in frame["path"]]
            for i, name in enumerate(names):
                frame[name] = pd.Series([x[i] for x in found], index=frame.index, dtype=object)
            yield frame

    return spread(files).mapInPandas(run, schema)


def perceptual_hashes(spark: SparkSession, leaders: DataFrame) -> DataFrame:
    """(sha256, phash, dhash) of leaders (sha256, path, format, orientation); no row where decoding fails.

    Pictures are decoded by Spark's image source, and turned, reduced and hashed in
    numpy.  Formats it cannot read (WebP among them) have no hashes.
    """
    ship(spark)
    rows = leaders.filter(hashable(F.col("format")))
    paths = [r["path"] for r in rows.select("path").toLocalIterator()]
    none = "sha256 string, phash long, dhash long"
    if not paths:
        return spark.createDataFrame([], none)
    found = None
    for a in range(0, len(paths), 10_000):  # a plan names so many files at most
        part = spark.read.format("image").option("dropInvalid", True).load(paths[a : a + 10_000]).select("image.*")
        found = part if found is None else found.unionByName(part)
    local = found.withColumn("path", F.url_decode(F.regexp_replace(F.regexp_replace("origin", r"\+", "%2B"), "^file:/*", "/")))
    joined = local.join(rows.select("path", "sha256", "orientation"), "path").select("sha256", "orientation", "height", "width", "nChannels", "data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sha, turn, h, w, n, data in frame.itertuples(index=False):
                p = np.frombuffer(data, np.uint8).reshape(h, w, n)
                p = p[:, :, 0] if n == 1 else p[:, :, 2::-1]
                g = pixels.grid(pixels.orient(p, int(turn)))
                out.append((sha, pixels.average_hash(g), pixels.difference_hash(g)))
            yield pd.DataFrame(out, columns=["sha256", "phash", "dhash"])

    return joined.mapInPandas(run, none)
