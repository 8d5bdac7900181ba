"""Pictures for tests, written by the JVM's image library."""

import struct

import numpy as np


def gradient(base, size=64):
    y, x = np.mgrid[0:size, 0:size]
    return np.stack([(base + 3 * x) % 256, (base + 3 * y) % 256, (base + 2 * (x + y)) % 256], axis=2).astype(np.uint8)


def checkers(block, a, b, size=64):
    y, x = np.mgrid[0:size, 0:size]
    return np.where((((x // block) + (y // block)) % 2)[..., None] == 0, np.array(a), np.array(b)).astype(np.uint8)


def save(spark, pixels, path, kind):
    """Write RGB rows as jpg, png or tiff bytes, under any name."""
    jvm = spark._jvm
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    flat = (pixels[..., 0].astype(int) << 16) | (pixels[..., 1].astype(int) << 8) | pixels[..., 2]
    values = spark.sparkContext._gateway.new_array(jvm.int, h * w)
    for i, v in enumerate(flat.reshape(-1).tolist()):
        values[i] = v
    image.setRGB(0, 0, w, h, values, 0, w)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))
    return path


def tiff_block(order="<", date="2024:01:15 12:00:00", make="Canon", model="EOS R5", turn=1, gps=(48, 51, 24, "N"), size=(8192, 5464), base=8):
    """A metadata block with the usual fields, whose directories begin at `base`."""
    mark = b"II*\0" if order == "<" else b"MM\0*"
    extra, out = b"", b""

    def text(s):
        return 2, len(s) + 1, s.encode() + b"\0"

    def rationals(*xs):
        return 5, len(xs), b"".join(struct.pack(order + "II", round(x * 1000), 1000) for x in xs)

    dirs = [
        {0x10F: text(make), 0x110: text(model), 0x112: (3, 1, struct.pack(order + "H", turn)), 0x132: text("1999:01:01 00:00:00"), 0x8769: None, 0x8825: None},
        {0x9003: text(date), 0xA002: (4, 1, struct.pack(order + "I", size[0])), 0xA003: (3, 1, struct.pack(order + "H", size[1]))},
        {1: text(gps[3]), 2: rationals(*gps[:3]), 3: text("W"), 4: rationals(2, 21, 8)},
    ]
    starts, at = [], base
    for d in dirs:
        starts.append(at)
        at += 2 + 12 * len(d) + 4
    for d in dirs:
        out += struct.pack(order + "H", len(d))
        for tag, v in sorted(d.items()):
            kind, count, raw = (4, 1, struct.pack(order + "I", starts[1 if tag == 0x8769 else 2])) if v is None else v
            if len(raw) > 4:
                place, extra = struct.pack(order + "I", at + len(extra)), extra + raw
            else:
                place = raw.ljust(4, b"\0")
            out += struct.pack(order + "HHI", tag, kind, count) + place
        out += b"\0\0\0\0"
    return mark + struct.pack(order + "I", base) + out + extra


def with_exif(jpeg, block):
    """A JPEG's bytes with a metadata segment."""
    body = b"Exif\0\0" + block
    return jpeg[:2] + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + jpeg[2:]


def box(kind, body):
    """A box of an ISO base media file."""
    return struct.pack(">I", len(body) + 8) + kind + body


def heif(block, version=1, inside=False, lead=b""):
    """A HEIF file whose Exif item holds a metadata block, in two extents after the boxes or in the item data box."""
    item = struct.pack(">I", 6) + b"Exif\0\0" + block
    wide = ">I" if version == 2 else ">H"
    infe = box(b"infe", bytes([3 if version == 2 else 2, 0, 0, 0]) + struct.pack(wide, 7) + b"\0\0Exif\0")
    other = box(b"infe", b"\2\0\0\0" + struct.pack(">H", 1) + b"\0\0hvc1\0")
    iinf = box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 2) + other + infe)

    def meta(at):
        half = len(item) // 2
        extents = [(0, len(item))] if inside else [(at, half), (at + half, len(item) - half)]
        method = b"" if version == 0 else struct.pack(">H", int(inside))
        iloc = bytes([version, 0, 0, 0, 0x44, 0x40]) + struct.pack(wide, 2)
        for number, parts in ((1, [(0, 1)]), (7, extents)):
            iloc += struct.pack(wide, number) + method + b"\0\0" + struct.pack(">IH", 0, len(parts))
            iloc += b"".join(struct.pack(">II", *p) for p in parts)
        return box(b"meta", b"\0\0\0\0" + box(b"hdlr", b"\0" * 20) + iinf + box(b"iloc", iloc) + (box(b"idat", item) if inside else b""))

    front = box(b"ftyp", b"heic\0\0\0\0mif1heic") + (box(b"free", lead) if lead else b"")
    return front + meta(len(front) + len(meta(0)) + 8) + box(b"mdat", b"" if inside else item)
