"""EXIF metadata of JPEG, TIFF-based, PNG, WebP and HEIF files; only the parts that lead to it are read."""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator
from typing import Any, BinaryIO, NamedTuple


class Exif(NamedTuple):
    """Capture data of a file; every part may be missing."""

    date: str | None = None
    camera_make: str | None = None
    camera_model: str | None = None
    gps_lat: float | None = None
    gps_lon: float | None = None
    width: int | None = None
    height: int | None = None
    orientation: int = 1


# Tags and value types of the EXIF standard.
MAKE, MODEL, ORIENTATION, DATE_TIME, WIDTH, HEIGHT = 0x010F, 0x0110, 0x0112, 0x0132, 0x0100, 0x0101
EXIF_IFD, GPS_IFD, DATE_ORIGINAL, PIXEL_X, PIXEL_Y = 0x8769, 0x8825, 0x9003, 0xA002, 0xA003
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
KNOWN = {
    MAKE, MODEL, ORIENTATION, DATE_TIME, WIDTH, HEIGHT, EXIF_IFD, GPS_IFD, DATE_ORIGINAL, PIXEL_X, PIXEL_Y, LAT_REF, LAT, LON_REF, LON,
}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


class Region:
    """A part of an open file; slices are read where they lie, short ones where the part or the file ends."""

    def __init__(self, file: BinaryIO, start: int = 0, size: int | None = None):
        left = max(0, file.seek(0, os.SEEK_END) - start)
        self.file, self.start, self.size = file, start, left if size is None else max(0, min(size, left))

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        first, last = max(0, at.start or 0), self.size if at.stop is None else min(at.stop, self.size)
        if first >= last:
            return b""
        self.file.seek(self.start + first)
        return self.file.read(last - first)

    def number(self, at: int, size: int, order: str = "big") -> int:
        """A whole number without sign; what lies beyond the end is left out."""
        return int.from_bytes(self[at : at + size], order)

    def part(self, at: int, size: int | None = None) -> Region:
        """A region within this one."""
        at = min(at, self.size)
        return Region(self.file, self.start + at, self.size - at if size is None else min(size, self.size - at))


def _boxes(data: Region, at: int = 0) -> Iterator[tuple[bytes, Region]]:
    """(type, body) of the boxes of an ISO base media file or of a box; a damaged length ends them."""
    while at + 8 <= len(data):
        size, kind, head = data.number(at, 4), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = data.number(at + 8, 8), 16
        elif size == 0:
            size = len(data) - at
        if size < head:
            return
        yield kind, data.part(at + head, size - head)
        at += size


def _exif_item(info: Region) -> int | None:
    """The number of the item of type Exif in an item information box."""
    for kind, entry in _boxes(info, 6 if info.number(0, 1) == 0 else 8):
        wide = {2: 2, 3: 4}.get(entry.number(0, 1))
        if kind == b"infe" and wide and entry[6 + wide : 10 + wide] == b"Exif":
            return entry.number(4, wide)
    return None


def _item_extents(places: Region, item: int) -> tuple[int, list[tuple[int, int]]] | None:
    """(construction method, [(offset, length)]) of an item in an item location box; a length of 0 reaches to the end."""
    version, sizes = places.number(0, 1), places.number(4, 2)
    wide_offset, wide_length, wide_base, wide_index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
    wide = 4 if version == 2 else 2
    count, at = places.number(6, wide), 6 + wide
    for _ in range(count):
        if at >= len(places):
            return None
        found, at = places.number(at, wide), at + wide
        method = places.number(at, 2) & 15 if version else 0
        at += 4 if version else 2  # the method, and the number of the file that holds the data
        base, n = places.number(at, wide_base), places.number(at + wide_base, 2)
        at += wide_base + 2
        step = wide_index + wide_offset + wide_length
        if found == item:
            starts = range(at + wide_index, min(at + n * step, len(places)), step) if step else ()
            return method, [(base + places.number(a, wide_offset), places.number(a + wide_offset, wide_length)) for a in starts]
        at += n * step
    return None


def _heif_block(data: Region) -> Region | None:
    """The TIFF structure in the Exif item of a HEIF file."""
    meta = next((body for kind, body in _boxes(data) if kind == b"meta"), None)
    inside = dict(_boxes(meta, 4)) if meta else {}
    if b"iinf" not in inside or b"iloc" not in inside:
        return None
    item = _exif_item(inside[b"iinf"])
    found = None if item is None else _item_extents(inside[b"iloc"], item)
    holder = {0: data, 1: inside.get(b"idat")}.get(found[0]) if found else None
    if holder is None:
        return None
    body = b"".join(holder[a : a + n if n else None] for a, n in found[1])
    return Region(io.BytesIO(body), 4 + int.from_bytes(body[:4], "big"))


def tiff_block(data: Region) -> Region | None:
    """The TIFF structure that holds a file's metadata, wherever in the file it lies."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at : at + 1] == b"\xff":
            marker, size = data.number(at + 1, 1), data.number(at + 2, 2)
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data.part(at + 10, size - 8)
            if marker in (0xDA, 0xD9):
                return None
            at += 2 + size
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size = data.number(at, 4)
            if data[at + 4 : at + 8] == b"eXIf":
                return data.part(at + 8, size)
            at += 12 + size
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            size = data.number(at + 4, 4, "little")
            if data[at : at + 4] == b"EXIF":
                skip = 6 if data[at + 8 : at + 14] == b"Exif\0\0" else 0
                return data.part(at + 8 + skip, size - skip)
            at += 8 + size + size % 2
    elif data[4:8] == b"ftyp":
        return _heif_block(data)
    return None


def _fields(block: Region, at: int, order: str) -> dict[int, tuple[int, list[Any]]]:
    """tag -> (type, values) of one directory's known tags; damaged entries are left out."""
    found: dict[int, tuple[int, list[Any]]] = {}
    if at + 2 > len(block):
        return found
    count = struct.unpack(order + "H", block[at : at + 2])[0]
    table = block[at + 2 : at + 2 + 12 * count]
    for i in range(len(table) // 12):
        entry = table[12 * i : 12 * i + 12]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        size = SIZES.get(kind, 0) * count
        if not size or tag not in KNOWN:
            continue
        raw = entry[8 : 8 + size]
        if size > 4:
            start = struct.unpack(order + "I", entry[8:12])[0]
            raw = block[start : start + size] if start + size <= len(block) else b""
        if len(raw) < size:
            continue
        if kind == 2:
            values = [raw.split(b"\0")[0].decode("utf-8", "replace")]
        elif kind in (5, 10):
            parts = struct.unpack(order + ("II" if kind == 5 else "ii") * count, raw)
            values = [a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True)]
        elif kind in (3, 4, 9):
            values = list(struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw))
        else:
            values = list(raw)
        found[tag] = (kind, values)
    return found


def degrees(values: list[float] | None, ref: str | None) -> float | None:
    """Decimal degrees of degrees, minutes and seconds; negative to the south or west."""
    if values is None or len(values) < 3:
        return None
    total = values[0] + values[1] / 60 + values[2] / 3600
    return -total if ref and ("S" in ref or "W" in ref) else total


def read(data: bytes | BinaryIO) -> Exif | None:
    """Metadata of a file's bytes or of an open file, or None if it has none of date, make, model, latitude and width."""
    block = tiff_block(Region(io.BytesIO(data) if isinstance(data, bytes) else data))
    if block is None or len(block) < 8 or block[:2] not in (b"II", b"MM"):
        return None
    order = "<" if block[:2] == b"II" else ">"
    main = _fields(block, struct.unpack(order + "I", block[4:8])[0], order)

    def sub(tag: int) -> dict[int, tuple[int, list[Any]]]:
        return _fields(block, main[tag][1][0], order) if tag in main and main[tag][0] == 4 else {}

    exif, gps = sub(EXIF_IFD), sub(GPS_IFD)

    def text(*places: tuple[dict, int]) -> str | None:
        return next((f[t][1][0] for f, t in places if t in f and f[t][0] == 2), None)

    def number(*places: tuple[dict, int]) -> int | None:
        f, t = next(((f, t) for f, t in places if t in f), ({}, 0))
        return int(f[t][1][0]) if f and f[t][0] in (3, 4) else None

    def rationals(tag: int) -> list[float] | None:
        return gps[tag][1] if tag in gps and gps[tag][0] == 5 else None

    def plain(value: str | None) -> str | None:
        return None if value is None else value.strip('"')

    date = text((exif, DATE_ORIGINAL), (main, DATE_TIME))
    if date is not None and len(date) >= 10 and date[4] == date[7] == ":":
        date = f"{date[:4]}-{date[5:7]}-{date[8:]}"
    found = Exif(
        date, plain(text((main, MAKE))), plain(text((main, MODEL))), degrees(rationals(LAT), text((gps, LAT_REF))),
        degrees(rationals(LON), text((gps, LON_REF))), number((exif, PIXEL_X), (main, WIDTH)), number((exif, PIXEL_Y), (main, HEIGHT)),
        number((main, ORIENTATION)) or 1,
    )
    return found if any(x is not None for x in (found.date, found.camera_make, found.camera_model, found.gps_lat, found.width)) or found.orientation != 1 else None
