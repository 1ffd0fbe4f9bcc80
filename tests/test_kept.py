"""Results that are kept: totals by digest, and the hash table of a stream with variants that weren't found."""

import hashlib

from pyspark.sql import functions as F

from shelfmark.functions import sheets
from shelfmark.operators import disc_units, library, totals
from shelfmark.streaming import watch


def test_totals_are_computed_once(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "dat string, n int")
    listing = spark.createDataFrame([("A", "1"), ("B", "1"), ("none", "1")], "dat string, version string")
    asked = []

    def compute(catalogues):
        asked.append(sorted(r.dat for r in catalogues.collect()))
        return rows.join(catalogues, "dat").groupBy("dat").agg(F.sum("n").alias("n"))

    def get(listing, rules):
        return {(r.dat, r.n) for r in totals.kept_totals(listing, rules, compute, str(tmp_path / "t")).collect()}

    en, all_ = library.Profile(languages=["En"]), library.Profile(languages=[])
    assert get(listing, en) == {("A", 3), ("B", 3)} and asked == [["A", "B", "none"]]
    # nothing is computed again, not even of the catalogue without rows
    assert get(listing, en) == {("A", 3), ("B", 3)} and len(asked) == 1
    newer = listing.withColumn("version", F.when(F.col("dat") == "A", "2").otherwise(F.col("version")))
    assert get(newer, en) == {("A", 3), ("B", 3)} and asked[1:] == [["A"]]
    assert get(listing, all_) == {("A", 3), ("B", 3)} and asked[2:] == [["A", "B", "none"]]
    assert get(listing.where("dat = 'B'"), en) == {("B", 3)} and len(asked) == 3
    assert totals.signature(en) == totals.signature(library.Profile(languages=["En"])) != totals.signature(all_)


def test_hash_table_of_a_stream(spark, tmp_path):
    data = bytes(range(256)) * 4
    schema = "path string, size long, mtime long, content binary"
    source, table, at = (str(tmp_path / x) for x in ("in", "table", "at"))

    def arrive(*files):
        spark.createDataFrame([(p, len(c), t, c) for p, t, c in files], schema).coalesce(1).write.mode("append").parquet(source)
        watch.keep_variants(spark.readStream.schema(schema).parquet(source), table, at).awaitTermination(120)
        return {(r.path, r.variant): r.sha1 for r in watch.current(spark, table).collect()}

    sha = lambda c: hashlib.sha1(c).hexdigest()
    first = arrive(("a", 1, b"h" * 512 + data), ("b", 1, b"plain"))
    assert first["a", "whole"] == sha(b"h" * 512 + data) and first["a", "header512"] == sha(data) and first["a", "header16"] is None
    assert {v for (p, v), s in first.items() if p == "b" and s is None} == set(watch.VARIANTS) - {"whole"}
    # b is as it was, a has changed twice, c is new
    second = arrive(("b", 1, b"plain"), ("a", 2, b"old"), ("a", 3, b"new"), ("c", 1, b""))
    assert second["a", "whole"] == sha(b"new") and second["a", "header512"] is None and second["b", "whole"] == sha(b"plain") and second["c", "whole"] == sha(b"")
    batches = {(r.path, r.batch) for r in spark.read.parquet(table).select("path", "batch").distinct().collect()}
    assert batches == {("a", 0), ("b", 0), ("a", 1), ("c", 1)}
    files = spark.createDataFrame([("b", 5, 1), ("b", 5, 2), ("d", 1, 1)], "path string, size long, mtime long")
    assert {(r.path, r.mtime) for r in watch.unknown(files, watch.current(spark, table)).collect()} == {("b", 2), ("d", 1)}
    catalogue = spark.createDataFrame([("plain.rom", 5, sha(b"plain")), ("no.rom", 6, sha(b"plain"))], "name string, size long, sha1 string")
    assert [tuple(r) for r in watch.matched_variants(watch.current(spark, table), catalogue).collect()] == [("b", "whole", "plain.rom")]


def test_words_and_track_files_of_sheets(spark):
    lines = {'FILE "Tony\'s Game.bin" BINARY': ["FILE", "Tony's Game.bin", "BINARY"], "a\tb''c  d": ["a", "bc", "d"], "pre\"a b\"post '' x": ["prea bpost", "", "x"], "": [], "  ": [], 'open "a b': ["open", "a b"]}
    rows = spark.createDataFrame([(k,) for k in lines], "l string").select("l", sheets.words(F.col("l")).alias("w"), sheets.area_mark(F.col("l")).alias("m")).collect()
    assert {r.l: r.w for r in rows} == lines and {r.m for r in rows} == {""}
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(sheets.gdi_files, "2\n1 0 4 2352 'a b.bin' 0\n\n2 4 0 2352 c.raw 0\n") == ["a b.bin", "c.raw"]
    assert one(sheets.gdi_files, "2\n1 0 4 2352 a 0\n") is None and one(sheets.gdi_files, "1\n1 0 4\n") is None
    assert one(sheets.cue_files, "FILE a BINARY\nTRACK 01 AUDIO\nFILE b BINARY\n TRACK 02 AUDIO") == ["a", "b"]
    assert one(sheets.cue_files, "FILE a BINARY\nTRACK 01 AUDIO\nTRACK 02 AUDIO") is None and one(sheets.cue_files, "file a BINARY") is None
    cue = "REM SINGLE-DENSITY AREA\nFILE a BINARY\nTRACK 01 MODE1\nREM HIGH-DENSITY AREA\nFILE b BINARY\nTRACK 02 AUDIO\n"
    sizes = lambda a, b: F.create_map(F.lit("a"), F.lit(a), F.lit("b"), F.lit(b))
    got = [one(lambda t: sheets.gdi_of_cue(t, sizes(a, b)), c) for c, a, b in ((cue, 4704, 2352), (cue, 4705, 2352), (cue, 2352 * 45_001, 2352), (cue.replace("FILE b", "FILE c"), 2352, 2352), (cue.replace("TRACK 02", "TRACK 03"), 2352, 2352), (cue.replace("FILE b BINARY\n", ""), 2352, 2352))]
    assert got[0].text == '2\n1 0 4 2352 "a" 0\n2 45000 0 2352 "b" 0\n' and got[0].problem is None
    assert [g.problem for g in got[1:]] == ["a is no whole number of sectors", "the single-density tracks are too long", "track file missing: c", "track numbers are not 1 to n", "several tracks in one file"]


def test_units_of_folders(spark):
    paths = ["top.chd", "top-side.txt", "_unmatched/x.chd", "_unmatched/xy.txt", "g/one.chd", "g/deep/f.bin", "g/in/two.chd", "g/in/s.txt", "s/a.gdi", "s/b.cue", "s/t/c.cue", "s/t/u.bin", "m/p.cue", "m/pp.cue", "m/p1.bin", "m/pp1.bin", "m/q.bin", "i/only.iso"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    named = spark.createDataFrame([("m/p.cue", "m/q.bin"), ("m/p.cue", "m/none.bin"), ("s/b.cue", "m/q.bin")], "sheet string, path string")
    found = disc_units.discovered(files, named)
    got = {}
    for r in found.collect():
        got.setdefault((r.unit, r.kind, r.folder), set()).add(r.path)
    assert got == {
        ("top.chd", "image", None): {"top.chd", "top-side.txt"},
        ("_unmatched/x.chd", "image", None): {"_unmatched/x.chd", "_unmatched/xy.txt"},
        ("g/one.chd", "image", "g"): {"g/one.chd", "g/deep/f.bin"},
        ("g/in/two.chd", "image", "g/in"): {"g/in/two.chd", "g/in/s.txt"},
        ("s/a.gdi", "sheet", "s"): {"s/a.gdi", "s/b.cue", "s/t/c.cue", "s/t/u.bin"},
        ("m/p.cue", "sheet", None): {"m/p.cue", "m/p1.bin", "m/q.bin"},
        ("m/pp.cue", "sheet", None): {"m/pp.cue", "m/pp1.bin"},
        ("i/only.iso", "sheet", "i"): {"i/only.iso"},
    }
    assert disc_units.unclaimed(files, found).count() == 0
