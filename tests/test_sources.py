"""Catalogue, archive, playlist, sheet and journal readers, and the stream of files."""

import hashlib
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import catalogs, catalogue_format, files
from shelfmark.streaming import watch

XML = """<?xml version="1.0"?><datafile><header><name>Base</name><version>1</version></header>
<game name="Foo (USA)"><description>Foo</description><category>Games</category><rom name="Foo (USA).rom" size="12" crc="ABC" md5="" sha1="FF"/></game>
<machine name="Bar"><description>Bar</description><rom name="b1.rom" size="x" crc="00000001"/><rom name="b2.rom" size="7" crc="2"/></machine></datafile>"""
TEXT = 'clrmamepro ( name "Base" version "2" )\ngame ( name "Otter (USA)" region "USA"\n rom ( name "Otter (USA).nes" size 10 crc ABCD1234 crc 0 md5 AA sha1 BB serial X )\n rom ( name "A \\"B\\".unh" size 12 crc 2 ) )\nresource ( name "r" )\n'


def test_catalogues(spark, tmp_path):
    (tmp_path / "Base (TOSEC-v2024-01-02_CM).dat").write_text(XML)
    rows = {r.name: r for r in catalogs.read_xml(spark, str(tmp_path)).collect()}
    assert rows["Foo (USA).rom"].crc == "00000abc" and rows["Foo (USA).rom"].category == "Games" and rows["b1.rom"].size == 0 and rows["b2.rom"].game == "Bar"
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "t.dat").write_text(TEXT)
    rows = {r.name: r for r in catalogs.read_text(spark, str(tmp_path / "text")).collect()}
    assert rows["Otter (USA).nes"].crc == "abcd1234" and rows["Otter (USA).nes"].set_name == "Otter (USA)" and 'A "B".unh' in rows and len(rows) == 2
    (tmp_path / "text" / "t.dat").write_text('game ( name "open')
    with pytest.raises(Exception, match="open string"):
        catalogs.read_text(spark, str(tmp_path / "text")).collect()
    heads = spark.createDataFrame([(XML,), (TEXT,), ("nothing",)], "h string").select(catalogs.kind_of(F.col("h")).alias("k")).collect()
    assert [r.k for r in heads] == ["xml", "text", None]
    paths = spark.createDataFrame([("d/A (TOSEC-v2023-01-01_CM).dat",), ("d/A (TOSEC-v2024-05-01_CM).dat",), ("d/B.dat",)], "path string")
    assert {r.dat: r.version for r in catalogs.newest_files(paths).collect()} == {"A": "2024-05-01", "B": ""}


def test_files_and_archives(spark, tmp_path):
    data = bytes(range(256)) * 6
    (tmp_path / "a.rom").write_bytes(b"h" * 512 + data[:1024])
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("m.rom", data)
        z.writestr("dir/", "")
    (tmp_path / "bad.zip").write_bytes(b"no")
    row = files.read_files(spark, str(tmp_path), "*.rom").first()
    assert row.sha1 == hashlib.sha1(b"h" * 512 + data[:1024]).hexdigest() and row.crc == f"{zlib.crc32(b'h' * 512 + data[:1024]):08x}"
    members = {r.path.rpartition("/")[2]: r for r in files.read_zip_members(spark, str(tmp_path)).collect()}
    assert members["z.zip"].crc == f"{zlib.crc32(data):08x}" and members["bad.zip"].error
    content = spark.read.format("binaryFile").load(str(tmp_path / "a.rom"))
    found = {v.variant: (v.size, v.sha1) for v in content.select(files.variants(F.col("content"), F.col("length")).alias("v")).first().v}
    assert found["header512"] == (1024, hashlib.sha1(data[:1024]).hexdigest()) and set(found) == {"whole", "header512"}
    clean = bytes.fromhex("80371240") + data[:1021]
    swap16 = b"".join(clean[i : i + 2][::-1] for i in range(0, 1024, 2)) + clean[1024:]
    swap32 = b"".join(clean[i : i + 4][::-1] for i in range(0, 1024, 4)) + clean[1024:]
    kinds = {}
    for name, raw in (("n", b"NES\x1a" + b"h" * 12 + data), ("swap16", swap16), ("swap32", swap32), ("clean", clean)):
        (tmp_path / f"{name}.bin").write_bytes(raw)
        content = spark.read.format("binaryFile").load(str(tmp_path / f"{name}.bin"))
        kinds[name] = {v.variant: (v.size, v.sha1) for v in content.select(files.variants(F.col("content"), F.col("length")).alias("v")).first().v}
    assert kinds["n"]["header16"] == (len(data), hashlib.sha1(data).hexdigest())
    assert kinds["swap16"]["swap16"] == kinds["swap32"]["swap32"] == (1025, hashlib.sha1(clean).hexdigest()) and set(kinds["clean"]) == {"whole"}
    listing = "Path = a.7z\n\n----------\nPath = x.rom\nSize = 0\nCRC = \n\nPath = y.rom\nSize = 5\nCRC = AB12\n"
    got = spark.createDataFrame([(listing,)], "t string").select(files.listed_members(F.col("t")).alias("m")).first().m
    assert [tuple(x) for x in got] == [("x.rom", 0, "00000000"), ("y.rom", 5, "ab12")]


def test_sheets_playlists_and_journals(spark, tmp_path):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(files.frames, "01:02:03") == 4653 and one(files.frames, "12") == 12 and one(files.frames, "1:2") == 4650
    tracks = one(files.gdi_tracks, '2\r\n1 0 4 2352 "track 01.bin" 0\r\n2 450 0 2352 t2.raw 0\r\n')
    assert [(t.number, t.lba, t.file) for t in tracks] == [(1, 0, "track 01.bin"), (2, 450, "t2.raw")] and one(files.gdi_tracks, "3\n1 0 4 2352 a 0") is None
    cue = one(files.cue_tracks, 'FILE "a b.bin" BINARY\n  TRACK 01 MODE1/2352\n    INDEX 01 00:00:00\nFILE c.bin BINARY\n  TRACK 02 AUDIO\n    INDEX 00 00:00:00\n    INDEX 01 00:02:00\n')
    assert [(t.file, t.number, t.type, t.start) for t in cue] == [("a b.bin", 1, "MODE1/2352", 0), ("c.bin", 2, "AUDIO", 150)]
    (tmp_path / "p.m3u").write_text(f"{files.OWN_MARK}\nd1.adf|Disk 1\n# note\nz.zip#d2.adf\n\n")
    lines = files.read_playlists(spark, str(tmp_path)).orderBy("nth").collect()
    assert [(r.own, r.entry, r.member, r.label) for r in lines] == [(True, "d1.adf", "", "Disk 1"), (True, "z.zip", "d2.adf", "")]
    steps = [{"version": 3, "root": "/r", "started": "x"}, {"i": 1, "op": "move", "src": "a", "dst": "b"}, {"i": 2, "op": "move", "src": "c", "dst": "d"}, {"i": 2, "op": "failed"}, {"i": 3, "op": "end"}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, steps)))
    assert [r.src for r in files.read_journal(spark, str(tmp_path / "log.jsonl")).collect()] == ["a"]


def test_new_files_are_hashed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rom").write_bytes(b"a")
    seen = []
    run = lambda: watch.keep_hashes(watch.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "at"), lambda rows, n: seen.append(rows.count())).awaitTermination(60)
    run()
    (tmp_path / "in" / "b.rom").write_bytes(b"b")
    run()
    assert seen == [1, 1]
    assert {r.sha1 for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {hashlib.sha1(x).hexdigest() for x in (b"a", b"b")}


def test_windowed_counts(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0), ("2024-01-01 03:00:00", "y", 4.0)], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = watch.counts_by_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.event_type, r.n, r.total) for r in spark.table("counts").collect()} == {("x", 2, 3.0), ("y", 1, 4.0)}


def test_catalogue_format(spark, tmp_path):
    """XML, text and zipped catalogues alike; header, file order, machines among games, several encodings."""
    mixed = XML.replace("<machine name", "<machine name", 1) + ""
    (tmp_path / "Own name (TOSEC-v2024-01-02_CM).dat").write_text(mixed.replace("<name>Base</name>", ""))
    (tmp_path / "text.dat").write_bytes(TEXT.replace("Otter", "Öt").encode("cp1252"))
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("in/a.dat", XML)
        z.writestr("in/b.txt", TEXT)
        z.writestr("in/", "")
    catalogue_format.register(spark)
    rows = spark.read.format("catalogue").load(str(tmp_path)).orderBy("file", "ord").collect()
    by = {}
    for r in rows:
        by.setdefault(r.file.rpartition("/")[2].rpartition("::")[2] if "::" not in r.file else r.file.rpartition("::")[2], []).append(r)
    assert {f: ({r.dat for r in x}, {r.version for r in x}, [r.name for r in x], [r.ord for r in x]) for f, x in by.items()} == {
        "Own name (TOSEC-v2024-01-02_CM).dat": ({"Own name"}, {"1"}, ["Foo (USA).rom", "b1.rom", "b2.rom"], [0, 1, 2]),
        "text.dat": ({"Base"}, {"2"}, ["Öt (USA).nes", 'A "B".unh'], [0, 1]),
        "in/a.dat": ({"Base"}, {"1"}, ["Foo (USA).rom", "b1.rom", "b2.rom"], [0, 1, 2]),
        "in/b.txt": ({"Base"}, {"2"}, ["Otter (USA).nes", 'A "B".unh'], [0, 1]),
    }
    first = by["text.dat"][0]
    assert (first.size, first.crc, first.md5, first.set_name, first.game) == (10, "abcd1234", "aa".zfill(32), "Öt (USA)", "Öt (USA)")
    assert by["in/a.dat"][0].category == "Games" and by["in/a.dat"][0].set_name is None and by["in/a.dat"][1].size == 0
    games = spark.read.format("catalogue").option("sets", "game").option("glob", "*.zip").load(str(tmp_path)).where("file like '%a.dat'")
    assert [r.set_name for r in games.orderBy("ord").collect()] == ["Foo (USA)", "Bar", "Bar"]
    (tmp_path / "none.dat").write_text("nothing")
    with pytest.raises(Exception, match="no catalogue"):
        spark.read.format("catalogue").load(str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("catalogue").load(str(tmp_path / "empty")).count() == 0
