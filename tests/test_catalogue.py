"""Catalogues over real folders: scans, removals, packs, exports, streams, command line."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumendex import cli, errors, schema
from lumendex.catalogue import TABLES, Catalogue
from lumendex.operators import dml
from lumendex.sources.store import Store
from lumendex.streaming import increments
from tests import images


@pytest.fixture
def library(spark, tmp_path):
    """Two folders: a picture as JPEG, PNG and a byte-equal raw file, another twice, and one alone."""
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    (two / "sub").mkdir(parents=True)
    first, second = images.gradient(10), images.checkers(8, (255, 0, 0), (0, 0, 255))
    images.save(spark, first, one / "a.jpg", "jpg")
    images.save(spark, first, two / "a.png", "png")
    shutil.copy(one / "a.jpg", two / "a.cr2")
    images.save(spark, second, one / "b.png", "png")
    shutil.copy(one / "b.png", two / "sub/c.png")
    rng = np.random.default_rng(1)
    images.save(spark, np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8), two / "alone.png", "png")
    return one, two


def groups(c):
    photos = {r["id"]: os.path.basename(r["path"]) for r in c.photos().collect()}
    found = {}
    for r in c.members().collect():
        found.setdefault(r["group_id"], set()).add(photos.get(r["photo_id"]))
    best = {r["id"]: (photos[r["source_of_truth_id"]], r["confidence"]) for r in c.groups().collect()}
    return sorted((sorted(names), *best[g]) for g, names in found.items())


WANT = [(["a.cr2", "a.jpg", "a.png"], "a.cr2", "Near-Certain"), (["b.png", "c.png"], "b.png", "Certain")]


def test_scan_change_remove(spark, library):
    one, two = library
    c = Catalogue.temporary(spark)
    assert c.scan() == {"read": 0, "removed": 0, "photos": 0, "groups": 0}
    assert (c.add_source(str(one)), c.add_source(str(two))) == (1, 2)
    events = []
    assert c.scan(lambda e, d: events.append(e)) == {"read": 6, "removed": 0, "photos": 6, "groups": 2}
    assert events == ["source", "source", "fingerprinted", "analysing", "removed", "resolved"]
    assert groups(c) == WANT
    raw = c.photos().filter(F.col("format") == "CR2").first()
    assert raw["phash"] is not None  # its bytes were hashed under another name in an earlier source
    ids = {r["path"]: r["id"] for r in c.photos().collect()}
    assert c.scan()["read"] == 0 and groups(c) == WANT
    assert c.groups().agg(F.min("id")).first()[0] == 3  # group ids are new with every scan

    os.utime(one / "a.jpg", (5, 5))  # an earlier time counts as a change too
    (two / "sub/c.png").unlink()
    shutil.copy(one / "b.png", two / "d.png")
    assert c.scan() == {"read": 2, "removed": 1, "photos": 6, "groups": 2}
    now = {r["path"]: r["id"] for r in c.photos().collect()}
    assert all(now[p] == i for p, i in ids.items() if p in now) and now[str(two / "d.png")] == 7

    overview = c.status().first()
    assert (overview["photos"], overview["groups"], overview["duplicates"], overview["unique"]) == (6, 2, 3, 3)
    assert c.stats().first().asDict() == {"sources": 2, "photos": 6, "groups": 2, "duplicates": 3}
    assert [r["role"] for r in c.files().collect()][0] == "Best Copy"
    assert c.group_list().count() == 2 and c.group(c.group_list().first()["group_id"]).count() >= 2
    with pytest.raises(errors.GroupNotFound):
        c.group(999)

    assert c.remove_source(str(two)) == 4
    assert groups(c) == [(["b.png"], "b.png", "Certain")]  # the raw best copy took its group along; the other keeps one member
    with pytest.raises(errors.SourceNotRegistered):
        c.remove_source(str(two))
    shutil.rmtree(one)
    assert c.scan() == {"read": 0, "removed": 2, "photos": 0, "groups": 0}


def test_hash_version(spark, library):
    one, two = library
    c = Catalogue.temporary(spark)
    c.add_source(str(one))
    c.scan()
    c.set_config("phash_version", "0")
    assert c.scan()["read"] == 2 and c.get_config("phash_version") == schema.PHASH_VERSION
    assert c.photos().filter("phash IS NULL").isEmpty()


def test_raw_before_its_copy_has_no_hash(spark, library):
    one, two = library
    c = Catalogue.temporary(spark)
    c.add_source(str(two))
    c.add_source(str(one))
    c.scan()
    assert c.photos().filter(F.col("format") == "CR2").first()["phash"] is None
    assert groups(c)[0][0] == ["a.cr2", "a.jpg", "a.png"]


def test_nested_sources(spark, library):
    one, two = library
    c = Catalogue.temporary(spark)
    c.add_source(str(two))
    c.add_source(str(two / "sub"))
    c.scan()
    c.scan()
    assert {os.path.basename(r["path"]): r["source_id"] for r in c.photos().collect()}["c.png"] == 2
    assert c.photos().count() == 4


def test_source_errors(spark, library, tmp_path):
    one, _ = library
    c = Catalogue.temporary(spark)
    c.add_source(str(one))
    for path, error in ((str(one), errors.SourceAlreadyExists), (str(one) + "/.", errors.SourceAlreadyExists), (str(tmp_path / "no"), errors.SourceNotFound), (str(one / "a.jpg"), errors.SourceNotDirectory)):
        with pytest.raises(error):
            c.add_source(path)


def test_heif_joins_the_group_of_its_capture(spark, tmp_path):
    block = images.tiff_block()
    images.save(spark, images.gradient(10), tmp_path / "plain.jpg", "jpg")
    (tmp_path / "a.jpg").write_bytes(images.with_exif((tmp_path / "plain.jpg").read_bytes(), block))
    (tmp_path / "plain.jpg").unlink()
    shutil.copy(tmp_path / "a.jpg", tmp_path / "b.jpg")
    (tmp_path / "c.heic").write_bytes(images.heif(block))
    (tmp_path / "d.heic").write_bytes(images.heif(images.tiff_block(date="2023:01:01 00:00:00")))
    c = Catalogue.temporary(spark)
    c.add_source(str(tmp_path))
    c.scan()
    assert [names for names, *_ in groups(c)] == [["a.jpg", "b.jpg", "c.heic"]]


def test_export_counts_photos_of_one_target(spark, tmp_path):
    for folder, base in (("x", 10), ("y", 90), ("z", 170)):
        (tmp_path / "in" / folder).mkdir(parents=True)
        images.save(spark, images.checkers(4 + base // 20, (base, 0, 0), (0, 255, base)), tmp_path / "in" / folder / "same.png", "png")
        os.utime(tmp_path / "in" / folder / "same.png", (1e9, 1e9))
    (tmp_path / "out").mkdir()
    c = Catalogue.temporary(spark)
    c.add_source(str(tmp_path / "in"))
    c.scan()
    n = c.photos().count() - c.members().count() + c.groups().count()
    assert n > 1

    def copy(source, target, quality):
        shutil.copy(source, target)

    assert c.export(str(tmp_path / "out"), encoder=copy) == {"converted": 1, "skipped": n - 1}
    assert c.export(str(tmp_path / "out"), encoder=copy) == {"converted": 0, "skipped": n}


def test_pack_and_export(spark, library, tmp_path):
    one, two = library
    pack, out = tmp_path / "pack", tmp_path / "out"
    pack.mkdir()
    out.mkdir()
    c = Catalogue.temporary(spark)
    with pytest.raises(errors.PackPathNotSet):
        c.pack()
    with pytest.raises(errors.PackPathNotFound):
        c.set_pack_path(str(tmp_path / "no"))
    c.add_source(str(one))
    c.add_source(str(two))
    c.scan()
    c.set_config("pack_path", str(pack))
    assert c.pack() == {"copied": 3, "skipped": 0, "removed": 0}
    files = sorted(os.path.splitext(f)[1] for _, _, names in os.walk(pack) for f in names if len(os.path.splitext(f)[0]) == 64)
    assert files == [".cr2", ".png", ".png"]
    assert c.pack() == {"copied": 0, "skipped": 3, "removed": 0}
    manifest = c.manifest(str(pack)).table("files")
    assert manifest.count() == 3 and set(manifest.columns) >= {"sha256", "added_at"}
    (two / "alone.png").unlink()
    c.scan()
    assert c.pack() == {"copied": 0, "skipped": 2, "removed": 1}
    assert c.manifest(str(pack)).table("files").count() == 2 and c.manifest_version(str(pack)) == 1

    def encoder(source, target, quality):
        if source.endswith("b.png"):
            raise errors.ConversionFailed("no")
        shutil.copyfile(source, target)

    assert c.export(str(out), encoder=encoder) == {"converted": 1, "skipped": 0}
    assert c.export(str(out), encoder=encoder) == {"converted": 0, "skipped": 1}
    with pytest.raises(errors.ExportPathNotFound):
        c.export(str(tmp_path / "no"), encoder=encoder)
    if not any(shutil.which(x) for x in ("sips", "heif-enc")):
        with pytest.raises(errors.EncoderNotAvailable):
            c.export(str(out))
    c.set_pack_path(str(pack))
    assert c.sources().count() == 3
    c.set_pack_path(str(pack))


def test_store(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store = Store(spark, root, TABLES)
    rows = spark.createDataFrame([("a", "1")], schema.CONFIG)
    store.commit({"x": 4}, config=rows)
    store.commit({"x": 2}, config=dml.put_config(store.table("config"), "a", "2"))
    store.commit(config=dml.put_config(store.table("config"), "b", "3"))
    again = Store(spark, root, TABLES)
    assert again.mark("x") == 4 and sorted(map(tuple, again.table("config").collect())) == [("a", "2"), ("b", "3")]
    state = again.state()
    again._swap(state | {"schema_version": "odd"})
    assert Store(spark, root, TABLES).state()["schema_version"] == schema.SCHEMA_VERSION
    again._swap(state | {"schema_version": 99})
    with pytest.raises(errors.SchemaTooNew):
        Store(spark, root, TABLES)


def test_table_changes(spark, tmp_path):
    c = Catalogue.temporary(spark)
    c.add_source(str(tmp_path))
    rows = spark.createDataFrame([(None, 1, f"/p/{i}", i, "JPEG", "s" if i < 3 else f"s{i}", 7 if i == 2 else None, None, 100 + i, *[None] * 7) for i in range(1, 5)], schema.PHOTOS)
    c.upsert_photos(rows)
    c.upsert_photos(rows.filter("size = 4").withColumn("mtime", F.lit(9).cast("long")))
    assert [(r["id"], r["mtime"]) for r in c.photos().orderBy("id").collect()] == [(1, 101), (2, 102), (3, 103), (4, 9)]
    assert c.photo_mtime("/p/3") == 103 and c.photo_mtime("/none") is None
    assert [tuple(r) for r in c.known_hashes(rows).collect()] == [("s", 7, None)]
    first, second = c.insert_group([1, 2], 1, "Certain"), c.insert_group([3, 4], 4, "High")
    for ids in ([1, 99], [1, 1]):
        with pytest.raises(errors.IntegrityError):
            c.insert_group(ids, 1, "Low")
    assert (first, second) == (1, 2) and c.clear_hashes() == 1 and c.photos().filter("phash IS NOT NULL").isEmpty()
    assert c.remove_photos(spark.createDataFrame([("/p/4",), ("/p/4",), ("/none",)], "path string")) == 1
    assert [r["id"] for r in c.groups().collect()] == [1] and c.members().count() == 2
    c.reset_mtimes()
    c.clear_groups()
    assert c.groups().count() == c.members().count() == 0 and c.photo_mtime("/p/1") == 0
    assert c.insert_group([1, 2], 2, "Low") == 3  # ids are not used again


def test_integrity(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x")], "id long, path string")
    with pytest.raises(errors.IntegrityError):
        dml.require_unique(a, "path")
    with pytest.raises(errors.IntegrityError):
        dml.require_known(a, "id", spark.createDataFrame([(1,)], "id long"))


def test_streams(spark, library, tmp_path):
    one, _ = library
    c = Catalogue.temporary(spark)
    c.add_source(str(one))
    increments.follow_folder(c, str(one), str(tmp_path / "cp1"), once=True).awaitTermination()
    assert c.photos().count() == 2
    rows = c.photos().withColumn("path", F.concat("path", F.lit(".2.jpg")))
    rows.write.parquet(str(tmp_path / "in"))
    increments.follow_rows(c, str(tmp_path / "in"), str(tmp_path / "cp2")).awaitTermination()
    assert c.photos().count() == 4 and c.groups().count() == 2


def test_command_line(spark, library, tmp_path, capsys):
    one, _ = library
    base = ["--catalog", str(tmp_path / "cat")]
    for args in (["add", str(one)], ["scan"], ["status"], ["ls"], ["ls", "--dupes"]):
        assert cli.main([*base, *args]) == 0
    out = capsys.readouterr().out
    assert "added source 1" in out and "photos       2" in out and "a.jpg" in out
    assert cli.main([*base, "ls", "--dupes", "77"]) == 1 and "GroupNotFound" in capsys.readouterr().err
    assert cli.main([*base, "rm", str(one)]) == 0 and "removed 2 photos" in capsys.readouterr().out


def test_command_line_lists_every_row(spark, capsys):
    class Many:
        def files(self):
            return spark.range(1500).select("id", F.when(F.col("id") != 3, F.concat(F.lit("a\n"), F.col("id"))).alias("name")).orderBy("id")

        group_list = files

        def group(self, _):
            return self.files()

        def sources_report(self):
            return self.files().orderBy(F.desc("id"))

        def status(self):
            return spark.sql("SELECT 1 photos, 1 unique, 0 groups, 0 duplicates, 5L disk_bytes, 0L savings_bytes")

        def get_pack_path(self):
            return None

    for args in (["ls"], ["ls", "--dupes"], ["ls", "--dupes", "1"], ["status"]):
        cli.run(Many(), cli.parser().parse_args(args))
        rows = [[v.strip() for v in x.split("|")[1:-1]] for x in capsys.readouterr().out.splitlines() if x.startswith("|")]
        assert rows == [["id", "name"]] + [[str(i), f"a\\n{i}" if i != 3 else "NULL"] for i in range(1500)]
