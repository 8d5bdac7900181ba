"""Column functions, joins and table changes on small hand-made rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumendex import schema
from lumendex.functions import dates, hashing, paths
from lumendex.operators import archive, dml, incremental, ranking, reports, resolve
from lumendex.operators.components import components
from lumendex.operators.hamming import block_keys, hamming_pairs
from lumendex.runtime import dense_ids


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_human_size(spark):
    values = [0, 1023, 1024, 1280, 1536, 1_500_000, 2_500_000_000, 2**40]
    assert column(spark, values, "long", paths.human_size) == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.5 KB", "1.4 MB", "2.3 GB", "1024.0 GB"]


def test_exif_dates(spark):
    values = ["2024-01-15 12:00:00", "2024:01:15 12:00:00", "2024-01-15", "garbage", "1969-01-01", "2101-01-01", "2024-13-01", "2024-01-32", "2024-02-31", "", None, " 2024-1-5 x"]
    got = column(spark, values, "string", dates.exif_date)
    assert [tuple(d) if d else None for d in got] == [(2024, 1, 15)] * 3 + [None] * 5 + [(2024, 2, 31), None, None, (2024, 1, 5)]


def test_exif_seconds(spark):
    day = (2024 * 365 + 506 + 31 + 15) * 86400
    values = ["2024-01-15 00:00:01", "2024:01:15 00:00:01", "x-2024-01-15 00:00:01:9", "2024-01-15", "2024-01 00:00:00", "2024-01-15 00:01", None]
    assert column(spark, values, "string", dates.exif_seconds) == [day + 1, day + 1, day + 1, None, None, None, None]


def test_asset_date(spark):
    rows = spark.createDataFrame([("bad", 0), (None, 86400 * 365), ("2020-05-06 x", 0), (None, -1)], "d string, m long")
    got = [tuple(r["y"]) for r in rows.select(dates.asset_date(F.col("d"), F.col("m")).alias("y")).collect()]
    assert got == [(1970, 1, 1), (1971, 1, 1), (2020, 5, 6), (1969, 12, 31)]


def test_paths(spark):
    values = ["/a/b.c.JPG", "/a/.hidden", "/a/noext", "x.png", "/a.d/y", "/a/b.", "/"]
    assert column(spark, values, "string", paths.file_extension) == ["JPG", None, None, "png", None, None, None]
    assert column(spark, values[:4], "string", paths.file_stem) == ["b.c", ".hidden", "noext", "x"]
    assert column(spark, values, "string", paths.display_name)[-1] == "/" and column(spark, ["/a/b/"], "string", paths.display_name) == ["b"]
    order = spark.createDataFrame([("/a.b",), ("/a/b",), ("/a",)], "p string").orderBy(paths.path_order(F.col("p")))
    assert [r["p"] for r in order.collect()] == ["/a", "/a/b", "/a.b"]
    assert column(spark, [None, 0, 10**15], "long", paths.scanned_at) == ["never", "1970-01-01 00:00:00", "unknown"]


def test_formats_and_levels(spark):
    names = ["CR2", "TIFF", "PNG", "JPEG", "HEIC", "WebP", "odd", None]
    assert column(spark, names, "string", schema.tier) == [0, 1, 2, 3, 4, 5, 3, 3]
    assert column(spark, names, "string", schema.hashable) == [False, True, True, True, False, True, False, False]
    assert column(spark, names, "string", schema.extension) == ["cr2", "tiff", "png", "jpg", "heic", "webp", "odd", None]
    assert column(spark, names, "string", schema.parse_format)[-2:] == ["JPEG", "JPEG"]
    assert column(spark, ["Certain", "Near-Certain", "?", None], "string", schema.confidence_level) == [4, 3, 0, 0]
    assert column(spark, range(5), "int", schema.confidence_name) == list(schema.CONFIDENCE)
    assert len(schema.EXTENSIONS) == 16 and schema.formats(spark).count() == 13


def test_levels_of_distances(spark):
    assert column(spark, [0, 2, 3, 4], "int", hashing.confidence_of_distance) == [3, 3, 1, None]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3), st.integers(1, 3))
def test_block_keys_in_plain_numbers(value, flips, most):
    other = value
    for b in flips[:most]:
        other ^= 1 << b
    count = most + 2
    edges = [round(i * 64 / count) for i in range(count + 1)]
    blocks = [[(v >> a) & ((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])] for v in (value, other)]
    assert sum(x == y for x, y in zip(*blocks, strict=True)) >= 2


@pytest.mark.parametrize("most", [2, 3])
def test_hamming_pairs(spark, most):
    rng = random.Random(most)
    base = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(60)] + [0, -1]
    values = base + [v ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) * rng.randint(0, 1) ^ (1 << rng.randrange(63)) * rng.randint(0, 1) for v in base for _ in range(3)]
    values += values[:20] + [None, None]
    want = {(a, b, ((a ^ b) & (2**64 - 1)).bit_count()) for a in values if a is not None for b in values if b is not None and a < b}
    df = spark.createDataFrame([(v,) for v in values], "h long")
    assert {tuple(r) for r in hamming_pairs(df, "h", most).collect()} == {x for x in want if x[2] <= most}
    assert "NestedLoop" not in hamming_pairs(df, "h", most)._jdf.queryExecution().toString()
    assert df.select(F.size(block_keys(F.col("h"), 3))).first()[0] == 10


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        moved = False
        for a, b in edges:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
        if not moved:
            break
    assert dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect())) == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)], "k int, v string")
    rows = dense_ids(df, ["k"], "n", 5).orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(5, 105))
    assert dense_ids(df.limit(0), ["k"], "n").count() == 0


def test_within_seconds(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(1000)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, k int, t long")
    want = {(k, a, b, abs(s - t)) for a, k, s in rows for b, l, t in rows if k == l and a < b and abs(s - t) <= 60}
    got = [tuple(r) for r in incremental.within_seconds(df, "k", "t", "i", 60).collect()]
    assert set(got) == want and len(got) == len(want)


def test_ranking(spark):
    rows = [(1, 1, "JPEG", 9, 1), (1, 2, "CR2", 1, 9), (2, 3, "PNG", 1, 1), (2, 4, "PNG", 2, 9), (3, 5, "PNG", 2, 9), (3, 6, "PNG", 2, 8), (4, 8, "PNG", 1, 1), (4, 7, "PNG", 1, 1)]
    df = spark.createDataFrame(rows, "group_id long, id long, format string, size long, mtime long")
    assert dict(map(tuple, ranking.elect(df).collect())) == {1: 2, 2: 4, 3: 6, 4: 7}


def _tables(spark):
    cols = "id long, source_id long, path string, size long, format string, sha256 string, mtime long, exif_date string, exif_camera_make string, exif_camera_model string"
    photos = spark.createDataFrame([(i, 1 + i % 2, f"/s/{i}.jpg", s, "JPEG", f"{i:064d}", 0, None, None, None) for i, s in ((1, 5000), (2, 3000), (3, 4000), (4, 2000))], cols)
    groups = spark.createDataFrame([(10, 1, "Certain"), (11, 3, "High")], schema.GROUPS)
    return photos, groups, spark.createDataFrame([(10, 1), (10, 2), (10, 3), (11, 3), (11, 2)], schema.MEMBERS)


def test_reports_with_a_photo_in_two_groups(spark):
    photos, groups, members = _tables(spark)
    roles = {r["photo_id"]: (r["group_id"], r["is_sot"]) for r in reports.roles(groups, members).collect()}
    assert roles == {1: (10, True), 2: (11, False), 3: (11, True)}  # the last group holds
    row = reports.overview(photos, groups, members).first()
    assert row.asDict() == {"photos": 4, "groups": 2, "duplicates": 1, "unique": 3, "disk_bytes": 14000, "savings_bytes": 3000}
    sources = spark.createDataFrame([(1, "/x/one", None), (2, "/two", 0), (3, "/three/", 5)], schema.SOURCES)
    assert reports.catalogue_stats(sources, photos, groups, members).first()["duplicates"] == 2  # distinct members that are not best in some group
    assert {r["id"] for r in archive.selected(photos, groups, members).collect()} == {1, 3, 4}
    report = {r["id"]: tuple(r)[1:] for r in reports.sources_report(sources, photos).collect()}
    assert report[3] == ("three", 0, "0 B", "1970-01-01 00:00:05") and report[1][3] == "never"
    empty = photos.limit(0)
    assert reports.overview(empty, groups.limit(0), members.limit(0)).first()["savings_bytes"] == 0


def test_drop_photos(spark):
    photos, groups, members = _tables(spark)
    left, alive, kept = dml.drop_photos(photos, groups, members, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 3 and [r["id"] for r in alive.collect()] == [11] and {tuple(r) for r in kept.collect()} == {(11, 2), (11, 3)}


def test_replace_files_and_breaks(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "sha256 string, original_filename string")
    new = spark.createDataFrame([("b", "n1", 1), ("b", "n2", 2), ("c", "z", 1)], "sha256 string, original_filename string, seq int")
    assert {tuple(r) for r in dml.replace_files(old, new).collect()} == {("a", "x"), ("b", "n2"), ("c", "z")}
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "g int, o int")
    assert [r["breaks"] for r in incremental.group_breaks(rows, "g", "o").orderBy("g", "o").collect()] == [True, False, True]


def test_merge_rules():
    h = {1: 0, 2: 1, 3: -1, 4: None}
    near, far = ((1, 1), {1, 2}, 4), ((1, 2), {2, 3}, 3)
    assert resolve.merge([near, far], h) == [near, far]  # what is not shared is far apart: two groups, one photo in both
    assert resolve.merge([near, ((1, 2), {2, 4}, 3)], h) == [((1, 2), {1, 2, 4}, 3)]  # nothing to compare
    assert resolve.merge([((1, 1), {1, 2}, 4), ((2, 1), {1, 2, 3}, 2)], h) == [((2, 1), {1, 2, 3}, 2)]  # a part of the other
    chain = [((1, i), {i, i + 1}, 4 - i) for i in (1, 2, 3)]
    assert resolve.merge(chain, dict.fromkeys(range(1, 5), 7)) == [((1, 3), {1, 2, 3, 4}, 1)]
