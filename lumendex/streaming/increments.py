"""Continuous scans: new files trigger incremental updates of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import Catalogue
from ..operators import dml
from ..schema import PHOTOS


def follow_folder(catalogue: Catalogue, folder: str, checkpoint: str, seconds: int = 60, once: bool = False) -> StreamingQuery:
    """Scan whenever files appear below a registered folder; `once` handles what is there and stops.

    The stream only notices files, by name and time; a scan reads what has changed.
    """
    listed = "path string, modificationTime timestamp, length long, content binary"
    stream = catalogue.spark.readStream.format("binaryFile").schema(listed).option("recursiveFileLookup", True).load(folder).select("path", "modificationTime")

    def batch(files: DataFrame, _: int) -> None:
        if not files.isEmpty():
            catalogue.scan()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def follow_rows(catalogue: Catalogue, folder: str, checkpoint: str) -> StreamingQuery:
    """Upsert catalogue rows that arrive as Parquet files, then resolve duplicates; handles what is there and stops."""
    stream = catalogue.spark.readStream.schema(PHOTOS).parquet(folder)

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.dropDuplicates(["path"])
        photos = dml.upsert_photos(catalogue.photos(), last, catalogue.store.mark("photos"))
        catalogue.replace_photos(photos)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
