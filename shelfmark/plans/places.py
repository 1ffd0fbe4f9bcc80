"""Queries of folders, target names and catalogue listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import places
from shelfmark.operators import catalogues, changes, organise, playlists, totals
from shelfmark.plans.library import _literal
from shelfmark.sources import catalogue_format
from shelfmark.sources.tables import table
from shelfmark.sources.work import new_folder, saved

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Paths and, by hand: reserved folder, legacy, set aside, duplicate, converted, protected, path without the folder, and where it goes as superseded.
PATHS = [
    ("game.rom", None, False, False, False, False, False, "game.rom", "_superseded/game.rom"),
    ("Cart/game.rom", None, False, False, False, False, False, "Cart/game.rom", "_superseded/Cart/game.rom"),
    ("_Excluded/Cart/game.rom", "_excluded", False, True, False, False, False, "Cart/game.rom", "_superseded/Cart/game.rom"),
    ("_unmatched/_superseded/Cart/game.rom", "_superseded", True, True, False, False, False, "Cart/game.rom", "_superseded/Cart/game.rom"),
    ("_unmatched/_superseded", "_unmatched", False, False, False, False, False, "_superseded", "_superseded/_superseded"),
    ("_duplicates/game.rom", "_duplicates", False, True, True, False, False, "game.rom", "_superseded/game.rom"),
    ("_unmatched/_Duplicates/game.rom", "_duplicates", True, True, True, False, False, "game.rom", "_superseded/game.rom"),
    ("_converted_originals/a/b/c.rom", "_converted_originals", False, False, False, True, False, "a/b/c.rom", "_superseded/a/b/c.rom"),
    ("kickstarts/k.rom", None, False, False, False, False, True, "kickstarts/k.rom", "_superseded/kickstarts/k.rom"),
    ("_excluded", None, False, False, False, False, False, "_excluded", "_superseded/_excluded"),
    ("_incomplete/_excluded/x", "_incomplete", False, True, False, False, False, "_excluded/x", "_superseded/_excluded/x"),
]


@query(f"""
WITH c(nth, path, folder, legacy, aside, duplicate, converted, protected, core, destination) AS (VALUES {", ".join("(" + ", ".join(map(_literal, (i, *x))) + ")" for i, x in enumerate(PATHS))})
SELECT p_partkey, c.* EXCLUDE (nth) FROM part JOIN c ON c.nth = p_partkey % {len(PATHS)}
""")
def folder_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each part, and what its folders say."""
    path = F.get(F.array(*[F.lit(x[0]) for x in PATHS]), (F.col("p_partkey") % len(PATHS)).cast("int"))
    p = F.col("path")
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).select(
        "p_partkey", "path", places.reserved_folder(p).alias("folder"), places.is_legacy(p).alias("legacy"), places.is_set_aside(p).alias("aside"), places.is_set_aside_duplicate(p).alias("duplicate"), places.is_converted_original(p).alias("converted"), places.is_protected(p).alias("protected"), places.core_path(p).alias("core"),
        places.reason_destination(p, F.lit("superseded")).alias("destination"),
    )


#: rom, set, game, file, via, byte order, archive and, by hand, the target, form, convertible.
TARGETS = [
    ("Game: One (USA).rom", "", "Game One", "x.rom", "raw", "", None, "Game_ One (USA).rom", "", False),
    ("Game.sfc", "Game", "g", "game.sfc", "headerless", "", None, "Game.smc", "", True),
    ("Game.sfc", "", "g", "game.SWC", "headerless", "", None, "Game.SWC", "", True),
    ("Game.z64", "Set", "g", "a.v64", "byteswapped", "n64", None, "Set.n64", "", True),
    ("Game.z64", "Set", "g", "a.bin", "byteswapped", "", None, "Set.bin", "", True),
    ("Game.iso", "", "g", "a.rvz", "container", "", None, "Game.rvz", "", False),
    ("Game.unh", "Set", "g", "a.unh", "raw", "", None, "Game.unh", "headerless", False),
    ("Game.v64", "Set", "g", "a.v64", "raw", "", None, "Game.v64", "", True),
    ("Game.rom", "Set?", "g", "a.zip", "raw", "", ".zip", "Set_.zip", "", False),
    ("Game.rom", "", "The Game", "a.7z", "raw", "", ".7z", "The Game.7z", "", False),
    ("con.rom", "", "g", "a.rom", "raw", "", None, "_con.rom", "", False),
    ("é" * 200 + ".rom", "", "g", "a.rom", "raw", "", None, "é" * 125 + ".rom", "", False),
]


@query(f"""
WITH c(nth, rom, set_name, game, source, via, byte_order, archive, target, form, convertible) AS (VALUES {", ".join("(" + ", ".join(map(_literal, (i, *x))) + ")" for i, x in enumerate(TARGETS))}),
r AS (SELECT p_partkey, c.*, CASE WHEN p_partkey % 5 = 0 THEN target ELSE source END AS name, 'Cart ' || p_brand AS dat FROM part JOIN c ON c.nth = p_partkey % {len(TARGETS)})
SELECT p_partkey, rom, target, form, convertible, name = target OR (archive IS NULL AND via = 'raw' AND name = rom) AS named, p_partkey % 10 = 0 AS placed FROM r
""")
def target_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match for each part: its target name, whether the file has it, and whether it is in its place."""
    fields = ["rom", "set_name", "game", "source", "via", "byte_order", "archive"]
    one = F.get(F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(fields, x, strict=False)]) for x in TARGETS]), (F.col("p_partkey") % len(TARGETS)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Cart "), "p_brand").alias("dat"), one.alias("m")).select("p_partkey", "dat", "m.*")
    c = F.col
    rows = rows.withColumn("target", places.target_name(c("rom"), c("set_name"), c("game"), c("source"), c("via"), c("byte_order"), c("archive")))
    rows = rows.withColumn("name", F.when(c("p_partkey") % 5 == 0, c("target")).otherwise(c("source"))).withColumn("path", F.when(c("p_partkey") % 10 == 0, F.concat_ws("/", places.canonical_folder(c("dat")), "name")).otherwise(F.concat(F.lit("other/"), "name")))
    members = F.when(c("archive").isNotNull(), 1)
    return rows.select(
        "p_partkey", "rom", "target", places.header_form(c("rom"), c("via")).alias("form"), places.is_convertible(c("rom"), c("via")).alias("convertible"), places.is_named(c("name"), c("target"), c("rom"), c("via"), places.archive_stem(c("set_name"), c("game")), members).alias("named"),
        places.is_placed(c("path"), places.canonical_folder(c("dat")), c("target")).alias("placed"),
    )


FILE = "concat('/dats/', s_name, case s_suppkey % 3 when 0 then ' - Games' when 1 then ' - Demos' else '' end, case when s_suppkey % 4 = 3 then '' else concat(' (TOSEC-v20', cast(10 + s_nationkey % 15 as string), '-01-', cast(10 + s_suppkey % 20 as string), '_CM)') end, case when s_suppkey % 7 = 6 then '.txt' else '.dat' end)"
NAME = "concat('Supplier ', cast(s_suppkey % 40 as string), case s_suppkey % 3 when 0 then ' - Games' when 1 then ' - Demos' else '' end)"


@query(f"""
WITH f AS (SELECT {NAME.replace("as string", "as varchar")} AS dat, CASE WHEN s_suppkey % 4 = 3 THEN '' ELSE '20' || (10 + s_nationkey % 15) || '-01-' || (10 + s_suppkey % 20) END AS version, s_suppkey FROM supplier WHERE s_suppkey % 7 <> 6),
l AS (SELECT dat, max(version) AS version FROM f GROUP BY dat),
p AS (SELECT DISTINCT 'P' || s_nationkey % 5 AS platform, {NAME.replace("as string", "as varchar")} AS dat FROM supplier)
SELECT platform, count(*) AS wanted, count(l.dat) AS present, max(l.version) AS newest FROM p LEFT JOIN l USING (dat) GROUP BY platform
""")
def catalogue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest file of each catalogue, and how many of each platform's catalogues are there."""
    supplier = table(spark, sf_dir, "supplier").withColumn("s_name", F.expr("concat('Supplier ', cast(s_suppkey % 40 as string))"))
    listing = catalogues.listed(supplier.select(F.expr(FILE).alias("path")))
    platforms = supplier.select(F.expr("concat('P', cast(s_nationkey % 5 as string))").alias("platform"), F.expr(NAME).alias("dat")).distinct().withColumn("priority", F.lit(0))
    return catalogues.platform_summary(platforms, listing)


#: Moves that wait for each other in chains, claims of one target, and files that stay.
MOVE = {"source": "concat('d/a', cast(p_partkey as string))", "target": "concat('d/a', cast(case when p_partkey % 7 = 0 then p_partkey when p_partkey % 5 = 0 then p_partkey % 50 else p_partkey + 1 end as string))"}


@query(f"""
WITH RECURSIVE m AS (SELECT p_partkey AS key, {", ".join(f"{x.replace('as string', 'as varchar')} AS {n}" for n, x in MOVE.items())} FROM part),
s AS (SELECT *, CASE WHEN source = target THEN 'ok' WHEN row_number() OVER (PARTITION BY lower(target) ORDER BY source = target DESC, source <> target, lower(source), key) = 1 THEN 'move' ELSE 'conflict' END AS first FROM m),
w AS (SELECT s.*, h.key AS holder FROM s LEFT JOIN s h ON lower(h.source) = lower(s.target) AND h.key <> s.key),
f AS (SELECT key FROM w WHERE first <> 'move' UNION SELECT w.key FROM w JOIN f ON w.holder = f.key)
SELECT key, target, CASE WHEN first = 'move' AND key IN (SELECT key FROM f) THEN 'conflict' ELSE first END AS status FROM w
""")
def move_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves along chains: a move is a conflict if the file at its target stays, however far along the chain."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), *[F.expr(x).alias(n) for n, x in MOVE.items()])
    return changes.resolved(rows).select("key", "target", "status")


@query("""
WITH m AS (SELECT 'z' || l_orderkey AS path, l_linenumber AS member, CASE WHEN l_partkey % 6 > 0 THEN 'dat' || l_suppkey % 2 END AS dat, 'g' || l_partkey % 3 AS unit FROM lineitem),
c AS (SELECT path, count(DISTINCT member) AS members, count(DISTINCT CASE WHEN dat IS NOT NULL THEN member END) AS matched FROM m GROUP BY path),
u AS (SELECT path, dat, unit, count(DISTINCT member) AS n FROM m WHERE dat IS NOT NULL GROUP BY ALL),
w AS (SELECT path, min((dat, unit)) AS u FROM u JOIN c USING (path) WHERE n = members GROUP BY path)
SELECT path, members, matched, u[1] AS dat, u[2] AS unit FROM c LEFT JOIN w USING (path)
""")
def archive_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives whose members are all of one game."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.expr("concat('z', cast(l_orderkey as string))").alias("path"), F.col("l_linenumber").alias("member"), F.expr("case when l_partkey % 6 > 0 then concat('dat', cast(l_suppkey % 2 as string)) end").alias("dat"), F.expr("concat('g', cast(l_partkey % 3 as string))").alias("unit"))
    return changes.archive_units(rows)


@query(f"""
WITH d AS (SELECT DISTINCT o_orderkey AS set, 'Set ' || o_custkey % 9 AS name, 'games/' || o_orderkey % 4 || '/' AS dir, l_linenumber AS slot, l_linenumber > 3 AS packed FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
f AS (SELECT *, CASE WHEN packed THEN 'Pack ' || set || CASE WHEN set % 11 = 0 THEN '.lha' ELSE '.zip' END ELSE 'Disk ' || set || '-' || slot || '.adf' END AS file FROM d),
s AS (SELECT set, name, dir, '{changes.MARK}' || chr(10) || string_agg(file || CASE WHEN packed THEN '#m' || slot ELSE '' END || '|' || CASE WHEN slot = 1 THEN 'Boot' ELSE 'Disk ' || slot END, chr(10) ORDER BY slot) || chr(10) AS content, NOT bool_or(packed AND set % 11 = 0) AS usable FROM f GROUP BY set, name, dir),
n AS (SELECT *, row_number() OVER (PARTITION BY dir, name ORDER BY set) AS nth FROM s),
p AS (SELECT set, dir || name || CASE WHEN nth > 1 THEN ' (' || nth || ')' ELSE '' END || '.m3u' AS path, content, usable FROM n)
SELECT set, path, content, usable, CASE set % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'write' ELSE 'conflict' END AS status FROM p
UNION ALL SELECT NULL, 'games/old/' || r_regionkey || '.m3u', NULL, NULL, 'stale' FROM region
""")
def playlist_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists of sets of disks with their names and lines, against the files that are there."""
    pairs = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_custkey", F.col("l_linenumber").alias("slot")).distinct()
    packed = F.col("slot") > 3
    key = F.col("o_orderkey").cast("string")
    name = F.when(packed, F.concat(F.lit("Pack "), key, F.when(F.col("o_orderkey") % 11 == 0, ".lha").otherwise(".zip"))).otherwise(F.concat(F.lit("Disk "), key, F.lit("-"), F.col("slot").cast("string"), F.lit(".adf")))
    disks = pairs.select(
        F.col("o_orderkey").alias("set"), F.expr("concat('Set ', cast(o_custkey % 9 as string))").alias("name"), "slot", F.concat(F.expr("concat('games/', cast(o_orderkey % 4 as string), '/')"), name).alias("file"), F.when(packed, F.concat(F.lit("m"), F.col("slot").cast("string"))).alias("member"), F.when(packed, 9).alias("members"), F.when(F.col("slot") == 1, "Boot").alias("label")
    )
    planned = saved(changes.playlists(disks), "playlists")
    text = F.when(F.col("set") % 3 == 0, F.replace(F.col("content"), F.lit("\n"), F.lit("\r\n"))).when(F.col("set") % 6 == 1, F.lit(changes.MARK + "\nolder")).when(F.col("set") % 3 == 2, F.lit("someone else's"))
    there = planned.select("path", text.alias("text")).where("text is not null")
    old = table(spark, sf_dir, "region").select(F.expr("concat('games/old/', cast(r_regionkey as string), '.m3u')").alias("path"), F.lit(changes.MARK).alias("text"))
    return changes.playlist_states(planned, there.unionByName(old)).select("set", "path", "content", "usable", "status")


@query("""
WITH i AS (SELECT l_partkey AS game, l_suppkey % 4 AS platform, CASE l_returnflag WHEN 'R' THEN 'superseded' WHEN 'A' THEN 'excluded' ELSE CASE WHEN l_quantity < 25 THEN 'keep' ELSE 'incomplete' END END AS action FROM lineitem),
g AS (SELECT platform, game, min(CASE action WHEN 'keep' THEN 0 WHEN 'incomplete' THEN 1 WHEN 'excluded' THEN 2 END) AS r FROM i GROUP BY platform, game)
SELECT platform, count(*) AS games, count(*) FILTER (r = 0) AS have, count(*) FILTER (r = 1) AS incomplete, count(*) FILTER (r = 2) AS excluded, round(count(*) FILTER (r = 0) * 100.0 / count(*), 2) AS percent FROM g WHERE r IS NOT NULL GROUP BY platform
""")
def owned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of owned games, the best of their items, and their shares by platform."""
    action = F.when(F.col("l_returnflag") == "R", "superseded").when(F.col("l_returnflag") == "A", "excluded").when(F.col("l_quantity") < 25, "keep").otherwise("incomplete")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("game"), (F.col("l_suppkey") % 4).alias("platform"), action.alias("action"))
    return totals.shares(totals.owned_states(items, ["platform", "game"]), ["platform"], "state")


#: Files of ten kinds by the last digit of their number: in place, elsewhere, spare, excluded, set aside, unknown and so on.
#: decade is the number without that digit; a decade's file 0 is in its place.
FILE_KINDS = {
    "decade": "p_partkey - p_partkey % 10",
    "dat": "concat('Cat ', cast(cast(p_partkey / 10 as int) % 3 as string))",
    "path": "case p_partkey % 10 when 0 then concat('Cat ', cast(cast(p_partkey / 10 as int) % 3 as string), '/g', cast(p_partkey as string), '.rom') when 1 then concat('new/', p_brand, '-', cast(p_partkey as string), '.rom') when 2 then concat('spare/', p_name, '/s', cast(p_partkey as string), '.rom') when 3 then concat('old/x', cast(p_partkey as string), '.rom') when 4 then concat('_superseded/', p_name, cast(p_partkey as string), '.rom') when 5 then concat('misc/', p_type, cast(p_partkey as string), '.bin') when 6 then concat('saves/', p_name, cast(p_partkey as string), '.SRM') when 7 then concat('_unmatched/_excluded/l', cast(p_partkey as string), '.rom') when 8 then concat('again/', cast(p_partkey as string), '.rom') else case when p_partkey % 20 = 19 then concat('_duplicates/old/x', cast(p_partkey - 6 as string), '.rom') else concat('broken/', cast(p_partkey as string)) end end",
}
FILE_SQL = ", ".join(f"{x.replace('as string', 'as varchar').replace('cast(p_partkey / 10 as int)', 'cast(floor(p_partkey / 10) as int)')} AS {n}" for n, x in FILE_KINDS.items())


@query(f"""
WITH f AS (SELECT p_partkey AS key, p_partkey % 10 AS kind, p_partkey % 20 = 19 AS twice, {FILE_SQL} FROM part),
p AS (SELECT f.*, h.path AS held, h.path IS NOT NULL AS has_held, e.key IS NOT NULL AS renamed FROM f
  LEFT JOIN f h ON h.key = f.decade AND h.kind = 0 LEFT JOIN f e ON f.kind = 3 AND e.key = f.key + 6 AND e.twice)
SELECT path,
  CASE kind WHEN 1 THEN concat(dat, '/g', key, '.rom') WHEN 2 THEN CASE WHEN has_held THEN concat('_duplicates/', path) ELSE concat(dat, '/g', decade, '.rom') END
    WHEN 3 THEN concat('_excluded/old/x', key, CASE WHEN renamed THEN ' (2)' ELSE '' END, '.rom') WHEN 5 THEN concat('_unmatched/', path) WHEN 7 THEN concat('_excluded/l', key, '.rom')
    WHEN 8 THEN CASE WHEN has_held THEN path ELSE concat(dat, '/g', decade, '.rom') END WHEN 9 THEN CASE WHEN twice THEN concat('_excluded/old/x', key - 6, '.rom') ELSE path END ELSE path END AS target,
  CASE WHEN kind IN (0, 4) THEN 'ok' WHEN kind = 6 THEN 'skip' WHEN kind = 8 AND has_held THEN 'conflict' WHEN kind = 9 AND NOT twice THEN 'skip' ELSE 'move' END AS status,
  CASE WHEN kind = 2 AND has_held THEN 'duplicate' WHEN kind IN (3, 7) OR twice THEN 'excluded' WHEN kind = 4 THEN 'superseded' ELSE '' END AS code,
  CASE kind WHEN 2 THEN CASE WHEN has_held THEN concat('duplicate of ', held) ELSE '' END WHEN 3 THEN concat('(Beta)', CASE WHEN renamed THEN concat(', renamed to x', key, ' (2).rom: the name is taken there') ELSE '' END) WHEN 4 THEN 'superseded by a newer one, already there'
    WHEN 5 THEN 'no catalogue matches' WHEN 6 THEN 'file of another program' WHEN 7 THEN 'no catalogue matches, moved out of _unmatched'
    WHEN 8 THEN CASE WHEN has_held THEN concat('target also wanted by ', held) ELSE '' END WHEN 9 THEN CASE WHEN twice THEN '(Beta)' ELSE 'could not be read: damaged' END ELSE '' END AS reason
FROM p WHERE decade > 0
""")
def plan_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for files of all kinds: duplicates, decisions, places, unknown files, numbered names and conflicts."""
    return _composed(spark, sf_dir).drop("folder")


def _composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kind, number = F.col("p_partkey") % 10, lambda c: F.col(c).cast("string")
    rows = part.select("p_partkey", *[F.expr(x).alias(n) for n, x in FILE_KINDS.items()]).where(F.col("decade") > 0)
    spare = kind == 2
    known = kind.isin(0, 1, 2, 3, 4, 8) | (F.col("p_partkey") % 20 == 19)
    files = rows.select(
        "path",
        "dat",
        F.when(known, F.concat(F.lit("u"), F.when(spare, number("decade")).otherwise(number("p_partkey")))).alias("unit"),
        F.lit("").alias("form"),
        F.concat(F.lit("g"), F.when(kind.isin(2, 8), number("decade")).otherwise(number("p_partkey")), F.lit(".rom")).alias("name"),
        F.lit(True).alias("raw"),
        F.lit(False).alias("archive"),
        F.lit(1).alias("members"),
        known.cast("int").alias("matched"),
        F.lit(False).alias("link"),
        F.when((kind == 9) & ~known, "damaged").alias("problem"),
        F.concat(F.lit("c"), number("p_partkey")).alias("content"),
    )
    gone = rows.where((kind == 3) | (F.col("p_partkey") % 20 == 19)).select("path", F.lit("excluded").alias("action"), F.lit("(Beta)").alias("detail"))
    older = rows.where(kind == 4).select("path", F.lit("superseded").alias("action"), F.lit("superseded by a newer one").alias("detail"))
    return organise.plan(files, gone.unionByName(older))


PLAN_SQL = ORACLE_SQL["plan_composition"]


@query(f"""
WITH plan AS ({PLAN_SQL}), r AS (SELECT CASE WHEN status IN ('conflict', 'skip') THEN status WHEN code <> '' THEN CASE WHEN status = 'move' THEN CASE code WHEN 'duplicate' THEN 'duplicates' ELSE code END END
  WHEN target LIKE '\\_unmatched/%' ESCAPE '\\' THEN CASE WHEN status = 'move' THEN 'unmatched' END ELSE 'kept' END AS reason FROM plan),
m AS (SELECT 'moved' AS reason FROM plan WHERE status = 'move' AND code = '' AND target LIKE 'Cat%')
SELECT v.reason, count(x.reason) AS n FROM (VALUES ('kept'), ('renamed'), ('moved'), ('excluded'), ('superseded'), ('incomplete'), ('duplicates'), ('unmatched'), ('conflict'), ('skip')) v(reason)
LEFT JOIN (SELECT * FROM r UNION ALL SELECT * FROM m) x ON x.reason = v.reason GROUP BY v.reason
""")
def plan_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the plan for files of all kinds changes, by reason."""
    return organise.reason_counts(_composed(spark, sf_dir))


#: Playlists of orders: those there name parts from the last line to the first, those planned the other way round.
@query(f"""
WITH l AS (SELECT DISTINCT l_orderkey AS set, l_partkey AS part FROM lineitem),
t AS (SELECT set, count(*) AS n, count(*) FILTER (part % 50 = 0 OR part % 47 = 0) AS gone, count(*) FILTER (part % 50 <> 0 AND part % 47 = 0) AS moves, list_sort(list(part)) AS parts FROM l GROUP BY set),
w AS (SELECT parts, min(concat('new/o', set, '.m3u')) AS twin FROM t WHERE set % 5 = 0 GROUP BY parts)
SELECT concat('old/o', set, '.m3u') AS path, CASE WHEN set % 3 = 0 THEN 'skip' ELSE 'stale' END AS status,
  CASE WHEN set % 3 = 0 THEN concat(moves, ' of its disks move') WHEN gone > 0 THEN concat(gone, ' of its disks are gone or move') ELSE concat('replaced by ', twin) END AS reason
FROM t LEFT JOIN w USING (parts) WHERE CASE WHEN set % 3 = 0 THEN moves > 0 ELSE gone > 0 OR twin IS NOT NULL END
""")
def playlist_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlists whose disks are gone or move, or that another one replaces with the same disks in another order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    sets = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    key = F.col("l_orderkey").cast("string")
    lines = lambda parts: F.array_join(F.transform(parts, lambda p: F.concat(F.lit("../d/./P"), p.cast("string"), F.lit(".adf|Disk"))), "\n")
    own = F.when(F.col("l_orderkey") % 3 == 0, "#EXTM3U").otherwise(changes.MARK)
    there = sets.select(F.concat(F.lit("old/o"), key, F.lit(".m3u")).alias("path"), F.concat_ws("\n", own, lines(F.reverse("parts"))).alias("text"))
    planned = sets.where("l_orderkey % 5 = 0").select(F.concat(F.lit("new/o"), key, F.lit(".m3u")).alias("path"), F.concat_ws("\n", F.lit(changes.MARK), lines(F.col("parts"))).alias("content"))
    number = F.col("p_partkey")
    files = table(spark, sf_dir, "part").where(number % 50 != 0).select(F.concat(F.lit("d/p"), number.cast("string"), F.lit(".adf")).alias("path"), (number % 47 == 0).alias("moving"))
    return playlists.stale(there, planned, files)


@query("""
SELECT 'Cat ' || p_brand AS dat, '2024-01-' || (10 + p_size % 20) AS version, 'g' || p_partkey || '.rom' AS name, p_partkey AS size, lpad(lower(to_hex(p_partkey)), 8, '0') AS crc, 'Game ' || p_partkey AS game,
  CASE WHEN p_brand LIKE '%1' THEN NULL ELSE 'g' || p_partkey END AS set_name, row_number() OVER (PARTITION BY p_brand, p_size % 20 ORDER BY p_partkey) - 1 AS ord FROM part
""")
def catalogue_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues written from parts, XML ones and text ones, and read back by their format with name and version of each."""
    part = table(spark, sf_dir, "part").withColumn("v", F.col("p_size") % 20)
    key, crc = F.col("p_partkey").cast("string"), F.lower(F.hex("p_partkey"))
    xml = F.concat(F.lit('<game name="Game '), key, F.lit('"><rom name="g'), key, F.lit('.rom" size="'), key, F.lit('" crc="0x'), crc, F.lit('"/></game>'))
    text = F.concat(F.lit('game ( name "Game '), key, F.lit('" rom ( name "g'), key, F.lit('.rom" size '), key, F.lit(" crc "), crc, F.lit(" ) )"))
    is_xml = F.endswith("p_brand", F.lit("1"))
    rows = part.select("p_brand", "v", is_xml.alias("x"), F.struct("p_partkey", F.when(is_xml, xml).otherwise(text).alias("t")).alias("r"))
    files = rows.groupBy("p_brand", "v", "x").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").alias("body"))
    version = F.concat(F.lit("2024-01-"), (F.col("v") + 10).cast("string"))
    as_xml = F.concat(F.lit("<?xml version='1.0'?><datafile><header><name>Cat "), "p_brand", F.lit("</name><version>"), version, F.lit("</version></header>"), "body", F.lit("</datafile>"))
    as_text = F.concat(F.lit('clrmamepro ( name "Cat '), "p_brand", F.lit('" version "'), version, F.lit('" )\n'), "body")
    folder = new_folder(spark, "catalogues")
    files.select(F.concat_ws("-", "p_brand", "v").alias("file"), F.when(F.col("x"), as_xml).otherwise(as_text).alias("value")).repartition("file").write.partitionBy("file").text(folder)
    catalogue_format.register(spark)
    found = spark.read.format("catalogue").load(folder)
    return found.select("dat", "version", "name", "size", "crc", "game", "set_name", "ord")
