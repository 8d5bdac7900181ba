"""Listings, metadata, pixels and hashes."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumendex.functions import hashing
from lumendex.runtime import spread
from lumendex.sources import exif, listing, media, pixels
from tests import images


def test_listing(spark, tmp_path):
    (tmp_path / "a/.hidden").mkdir(parents=True)
    for name in ("x.JPG", "a/y.heif", "a/.hidden/z.cr2", "note.txt", "noext", ".jpg"):
        (tmp_path / name).write_bytes(b"1234")
    os.symlink(tmp_path / "a", tmp_path / "a/loop")
    os.utime(tmp_path / "x.JPG", (1000.7, 1000.7))
    rows = {os.path.relpath(r["path"], tmp_path): r for r in listing.list_folder(spark, str(tmp_path)).collect()}
    assert {k: r["format"] for k, r in rows.items()} == {"x.JPG": "JPEG", "a/y.heif": "HEIC", "a/.hidden/z.cr2": "CR2"}
    assert (rows["x.JPG"]["size"], rows["x.JPG"]["mtime"]) == (4, 1000)
    assert listing.list_folder(spark, str(tmp_path / "gone")).count() == 0
    seen = {os.path.basename(r["path"]) for r in listing.list_store(spark, str(tmp_path)).collect()}
    assert {"x.JPG", "y.heif"} <= seen


def test_sha256(tmp_path):
    for data in (b"hello world", b"", b"x" * 200_000):
        (tmp_path / "f").write_bytes(data)
        assert media.sha256_of(str(tmp_path / "f")) == hashlib.sha256(data).hexdigest()
    assert media.sha256_of(str(tmp_path / "none")) is None


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    block = images.tiff_block(order, turn=6)
    jpeg = images.with_exif(b"\xff\xd8\xff\xd9", block)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(block)) + b"eXIf" + block + struct.pack(">I", zlib.crc32(b"eXIf" + block))
    webp = b"RIFF" + struct.pack("<I", 0) + b"WEBPEXIF" + struct.pack("<I", len(block)) + block
    for data in (block, jpeg, png, webp):
        found = exif.read(data)
        assert found[:3] == ("2024-01-15 12:00:00", "Canon", "EOS R5")
        assert found.gps_lat == pytest.approx(48.856666, abs=1e-5) and found.gps_lon == pytest.approx(-2.352222, abs=1e-5)
        assert found[5:] == (8192, 5464, 6)


@pytest.mark.parametrize(("version", "inside"), [(0, False), (1, False), (1, True), (2, False), (2, True)])
def test_heif_exif(version, inside):
    data = images.heif(images.tiff_block(">", turn=6), version, inside)
    found = exif.read(data)
    assert found[:3] == ("2024-01-15 12:00:00", "Canon", "EOS R5") and found[5:] == (8192, 5464, 6)
    for cut in range(0, len(data), 5):
        exif.read(data[:cut])
    assert exif.read(images.box(b"ftyp", b"heic") + images.box(b"meta", b"\0\0\0\0")) is None


def test_exif_far_into_files(tmp_path):
    far = b"\0" * (5 << 20)
    block = images.tiff_block()
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", len(far)) + b"IDAT" + far + b"\0" * 4 + struct.pack(">I", len(block)) + b"eXIf" + block
    # the same directory, moved behind the data: all places in it move too
    moved = images.tiff_block(base=8 + len(far))
    tiff = moved[:4] + struct.pack("<I", 8 + len(far)) + far + moved[8:]
    for name, data in (("a.png", png), ("a.tiff", tiff), ("a.heic", images.heif(block, lead=far))):
        (tmp_path / name).write_bytes(data)
        assert media.metadata_of(str(tmp_path / name))[:3] == ("2024-01-15 12:00:00", "Canon", "EOS R5"), name
    (tmp_path / "bad.tiff").write_bytes(b"II*\0\xff\xff\xff\xff")
    assert media.metadata_of(str(tmp_path / "bad.tiff")) is None and media.metadata_of(str(tmp_path / "none")) is None


def test_work_on_files_is_spread(spark):
    rows = spark.range(4000).select(F.col("id"), F.lit(1 << 24).alias("size"))
    merged = rows.join(rows.select("id"), "id")  # short rows, which an adaptive plan merges
    assert spread(merged).rdd.getNumPartitions() == (4000 << 24) >> 28
    assert spread(merged.drop("size"), 50).rdd.getNumPartitions() == 80
    assert spread(rows.limit(0)).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("data", [b"", b"not a picture", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xe1\xff\xff", b"II*\0\xff\xff\xff\xff", b"II*\0"])
def test_no_exif(data):
    assert exif.read(data) is None


def test_exif_damaged():
    block = images.tiff_block()
    for cut in range(0, len(block), 7):
        exif.read(block[:cut])
    assert exif.degrees([1.0, 2.0], "N") is None and exif.degrees(None, None) is None


@pytest.mark.parametrize(("turn", "want"), [(1, [[1, 2, 3], [4, 5, 6]]), (2, [[3, 2, 1], [6, 5, 4]]), (3, [[6, 5, 4], [3, 2, 1]]), (4, [[4, 5, 6], [1, 2, 3]]),
    (5, [[1, 4], [2, 5], [3, 6]]), (6, [[4, 1], [5, 2], [6, 3]]), (7, [[6, 3], [5, 2], [4, 1]]), (8, [[3, 6], [2, 5], [1, 4]]), (9, [[1, 2, 3], [4, 5, 6]])])
def test_orientation(turn, want):
    p = np.array([[1, 2, 3], [4, 5, 6]])
    assert pixels.orient(p, turn).tolist() == want
    assert pixels.orient(np.stack([p] * 3, axis=2), turn)[..., 1].tolist() == want


def test_hashes_agree_with_columns(spark):
    rng = np.random.default_rng(0)
    grids = [rng.integers(0, 256, 72).tolist() for _ in range(50)] + [[7] * 72, list(range(72)), list(range(72, 0, -1))]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "i int, g array<long>")
    for r in df.select("i", hashing.average_hash(F.col("g")).alias("p"), hashing.difference_hash(F.col("g")).alias("d")).collect():
        g = np.array(grids[r["i"]])
        assert (pixels.average_hash(g), pixels.difference_hash(g)) == (r["p"], r["d"])
    assert pixels.average_hash(np.full(72, 7)) == -1 and pixels.difference_hash(np.full(72, 7)) == 0


def test_small_and_flat_pictures():
    assert pixels.grid(np.full((3, 2, 3), 200, np.uint8)).tolist() == [200] * 72
    assert pixels.grid(np.full((100, 90), 9, np.uint8)).tolist() == [9] * 72


def test_perceptual_hashes(spark, tmp_path):
    picture = images.gradient(10)
    rows = []
    for kind, fmt in (("jpg", "JPEG"), ("png", "PNG"), ("tiff", "TIFF")):
        images.save(spark, picture, tmp_path / f"a b+{kind}.{kind}", kind)
        rows.append((kind, str(tmp_path / f"a b+{kind}.{kind}"), fmt, 1))
    (tmp_path / "bad.jpg").write_bytes(b"no picture")
    images.save(spark, np.rot90(picture, 1), tmp_path / "turned.png", "png")
    rows += [("bad", str(tmp_path / "bad.jpg"), "JPEG", 1), ("raw", str(tmp_path / "bad.jpg"), "CR2", 1), ("turned", str(tmp_path / "turned.png"), "PNG", 6)]
    found = {r["sha256"]: r for r in media.perceptual_hashes(spark, spark.createDataFrame(rows, "sha256 string, path string, format string, orientation int")).collect()}
    assert set(found) == {"jpg", "png", "tiff", "turned"}
    for k in ("jpg", "tiff", "turned"):
        assert ((found[k]["phash"] ^ found["png"]["phash"]) & (2**64 - 1)).bit_count() <= 2
        assert ((found[k]["dhash"] ^ found["png"]["dhash"]) & (2**64 - 1)).bit_count() <= 2
