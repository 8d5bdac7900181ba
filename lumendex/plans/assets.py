"""The `assets` view: a table of documents in the shape of a photo catalogue.

Content, size and capture data come from the documents; the pixel grid is a
72-cell word histogram, hashed by the same functions as images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import average_hash, difference_hash
from ..schema import extension, hashable


def word_grid(documents: DataFrame) -> DataFrame:
    """`documents` with grid: how many words fall into each of 72 cells, by first character and length."""
    words = F.filter(F.split(F.lower("text"), "[ \t\r\n]+"), lambda w: w != "")
    cells = F.transform(words, lambda w: F.pmod(F.ascii(w) * 31 + F.length(w), F.lit(72)))
    # the cells are bound to a lambda's variable, so that they are computed once and not for each count
    counts = F.transform(F.array(cells), lambda found: F.transform(F.sequence(F.lit(0), F.lit(71)), lambda k: F.size(F.filter(found, lambda c: c == k)).cast("long")))
    return documents.withColumn("grid", counts[0])


def listed_assets(documents: DataFrame) -> DataFrame:
    """Rows before hashing: all columns but phash and dhash, and the text."""
    n = F.col("doc_id") % 10
    fmt = F.when(n <= 5, "JPEG").when(n == 6, "PNG").when(n == 7, "HEIC").when(n == 8, "CR2").otherwise("TIFF")
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    taken = F.date_format(F.timestamp_seconds(start + F.col("n_chars")), "yyyy-MM-dd HH:mm:ss")
    rows = documents.withColumn("format", fmt)
    return rows.select(
        (F.col("doc_id") + 1).alias("id"),
        (F.regexp_extract("source", "[0-9]+", 0).cast("long") + 1).alias("source_id"),
        F.concat_ws("/", F.lit(""), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), extension(F.col("format")))).alias("path"),
        F.col("n_chars").alias("size"),
        "format",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        (F.lit(1700000000) + (F.col("doc_id") * 7919) % 1000000).alias("mtime"),
        F.when(F.col("doc_id") % 11 != 0, taken).alias("exif_date"),
        F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("exif_camera_model"),
        "text",
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as photos; each distinct content with a hashable copy is hashed once, and its copies share the hashes."""
    listed = listed_assets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    leaders = listed.filter(hashable(F.col("format"))).groupBy("sha256").agg(F.first("text").alias("text"))
    hashes = word_grid(leaders).select("sha256", average_hash(F.col("grid")).alias("phash"), difference_hash(F.col("grid")).alias("dhash"))
    return listed.drop("text").join(hashes, "sha256", "left").select(
        "id", "source_id", "path", "size", "format", "sha256", "phash", "dhash", "mtime", "exif_date",
        F.lit(None).cast("string").alias("exif_camera_make"), "exif_camera_model", F.lit(None).cast("double").alias("exif_gps_lat"),
        F.lit(None).cast("double").alias("exif_gps_lon"), F.lit(None).cast("int").alias("exif_width"), F.lit(None).cast("int").alias("exif_height"),
    )
