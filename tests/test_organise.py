"""Plans for folders, chains of moves, playlists."""

from pyspark.sql import functions as F

from shelfmark.operators import changes, organise, playlists
from shelfmark.sources.files import OWN_MARK

FILES = "path string, dat string, unit string, form string, name string, raw boolean, archive boolean, members int, matched int, link boolean, problem string, content string"


def file(path, unit=None, name=None, raw=True, archive=False, members=1, matched=None, link=False, problem=None, content=None):
    return (path, "Cat" if unit else None, unit, "", name, raw, archive, members, int(unit is not None) if matched is None else matched, link, problem, content or path)


CASES = [
    (file("_converted_originals/a.sfc", "u1", "a.sfc"), ("_converted_originals/a.sfc", "ok", "")),
    (file("_unmatched/_converted_originals/b.sfc"), ("_converted_originals/b.sfc", "move", "")),
    (file("z/two.zip", members=2, matched=1, archive=True), ("z/two.zip", "skip", "")),
    (file("z/none.zip", members=2, matched=0, archive=True), ("_unmatched/z/none.zip", "move", "")),
    (file("link.rom", "u2", "l.rom", link=True), ("link.rom", "skip", "")),
    # the loose exact copy outside of reserved folders is kept, then its place
    (file("x/c.zip", "u3", "c.rom", archive=True), ("_duplicates/x/c.zip", "move", "duplicate")),
    (file("x/longer/c.rom", "u3", "c.rom"), ("Cat/c.rom", "move", "")),
    (file("_duplicates/c.rom", "u3", "c.rom"), ("_duplicates/c.rom", "ok", "duplicate")),
    (file("x/alt.rom", "u3", "c.rom", raw=False), ("_duplicates/x/alt.rom", "move", "duplicate")),
    (file("other cat/f.bin"), ("other cat/f.bin", "skip", "")),
    (file("images/shot.png"), ("_unmatched/images/shot.png", "move", "")),
    (file("_incomplete/d.adf"), ("_incomplete/d.adf", "ok", "")),
    # the same content is at the target already, and another content wants it
    (file("Cat/e.rom", "u4", "e.rom", content="E"), ("Cat/e.rom", "ok", "")),
    (file("y/e.rom", "u5", "e.rom", content="E"), ("y/e.rom", "duplicate", "")),
    (file("y/e2.rom", "u6", "E.rom", content="F"), ("y/e2.rom", "conflict", "")),
    # numbers that occur are passed over
    (file("gone.rom", "u7", "g.rom"), ("_excluded/gone (3).rom", "move", "excluded")),
    (file("_excluded/gone.rom"), ("_excluded/gone.rom", "ok", "")),
    (file("_excluded/gone (2).rom"), ("_excluded/gone (2).rom", "ok", "")),
]


def test_plan(spark):
    files = spark.createDataFrame([f for f, _ in CASES], FILES)
    decisions = spark.createDataFrame([("gone.rom", "excluded", "(Demo)"), ("x/longer/c.rom", "keep", "")], "path string, action string, detail string")
    rows = {r.path: r for r in organise.plan(files, decisions, ["Other Cat"]).collect()}
    assert {p: (r.target, r.status, r.code) for p, r in rows.items()} == {f[0]: want for f, want in CASES}
    assert rows["_duplicates/c.rom"].reason == "duplicate of x/longer/c.rom, already there"
    assert rows["gone.rom"].reason == "(Demo), renamed to gone (3).rom: the name is taken there" and rows["gone.rom"].folder == "_excluded"
    flat = {r.path: r.target for r in organise.plan(files.where("path like 'images%' or path like 'x/l%'"), None, [], True).collect()}
    assert flat == {"images/shot.png": "images/shot.png", "x/longer/c.rom": "c.rom"}
    assert organise.plan(files.where("false")).count() == 0


def test_long_chains_of_moves(spark):
    """One job for each doubling of the distance, not for each link."""
    n = 50_000
    rows = spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("a"), "id").alias("source"), F.concat(F.lit("a"), F.when(F.col("id") == n - 1, F.lit("0")).otherwise((F.col("id") + 1).cast("string"))).alias("target"))
    assert {r.status: r["count"] for r in changes.resolved(rows).groupBy("status").count().collect()} == {"move": n}
    blocked = rows.withColumn("target", F.when(F.col("key") == n - 1, F.col("source")).otherwise(F.col("target")))
    assert {r.status: r["count"] for r in changes.resolved(blocked).groupBy("status").count().collect()} == {"conflict": n - 1, "ok": 1}


def test_paths_of_playlists(spark):
    rows = spark.createDataFrame([("a/b/", "a/b/c"), ("a/b/", "a/x/c"), ("a/b/", "c"), ("", "a/c"), ("a/", "b/c")], "d string, f string")
    assert [r.x for r in rows.select(changes.relative(F.col("d"), F.col("f")).alias("x")).collect()] == ["c", "../x/c", "../../c", "a/c", "../b/c"]
    paths = ["a/./b//c", "a/../b", "../a", "a/../../b", "/x/../y", "../../a/.."]
    assert [r.x for r in spark.createDataFrame([(p,) for p in paths], "p string").select(playlists.normal(F.col("p")).alias("x")).collect()] == ["a/b/c", "b", "../a", "../b", "/y", "../.."]
    text = f"{OWN_MARK}\n a #1.adf |Disk\n#note\nz.ZIP#m#2.adf\n|only\n../up.adf"
    assert [(r.own, r.entry) for r in playlists.entries(spark.createDataFrame([("d/p.m3u", text)], "path string, text string")).collect()] == [(True, "d/a #1.adf"), (True, "d/z.zip"), (True, "up.adf")]


def test_stale_playlists(spark):
    def text(*lines, mark=OWN_MARK):
        return "\n".join([mark, *lines])

    there = [("p/gone.m3u", text("no.adf", "1.adf")), ("p/moves.m3u", text("1.adf", "2.adf")), ("p/twin.m3u", text("3.adf", "1.adf", "3.adf")), ("p/fine.m3u", text("1.adf")), ("p/theirs.m3u", text("2.adf", mark="#EXTM3U")), ("p/planned.m3u", text("no.adf")), ("p/empty.m3u", text())]
    planned = spark.createDataFrame([("q/new.m3u", text("../p/1.adf", "../p/3.adf")), ("P/planned.m3u", text("1.adf"))], "path string, content string").where("path <> 'x'")
    files = spark.createDataFrame([("p/1.adf", False), ("p/2.adf", True), ("p/3.adf", False)], "path string, moving boolean")
    got = {r.path: (r.status, r.reason) for r in playlists.stale(spark.createDataFrame(there, "path string, text string"), planned, files).collect()}
    assert got == {"p/gone.m3u": ("stale", "1 of its disks are gone or move"), "p/moves.m3u": ("stale", "1 of its disks are gone or move"), "p/twin.m3u": ("stale", "replaced by q/new.m3u"), "p/theirs.m3u": ("skip", "1 of its disks move"), "p/fine.m3u": ("stale", "replaced by P/planned.m3u")}
