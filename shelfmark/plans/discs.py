"""Queries of discs, system files and result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import sheets
from shelfmark.operators import disc_units as units
from shelfmark.operators import discs, serve
from shelfmark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


DISC_SQL = """
t AS (SELECT l_orderkey AS unit, list({'n': l_linenumber, 's': CAST(l_quantity AS BIGINT), 'h': md5(CAST(l_partkey % 3 AS VARCHAR))} ORDER BY l_linenumber, l_quantity, md5(CAST(l_partkey % 3 AS VARCHAR))) AS x FROM lineitem GROUP BY l_orderkey),
u AS (SELECT unit, list_transform(x, lambda e: e.s) AS sizes, list_transform(x, lambda e: e.h) AS hashes FROM t),
g AS (SELECT * FROM u WHERE unit % 2 = 0),
f AS (SELECT u.unit, (SELECT min(g.unit) FROM g WHERE g.sizes = u.sizes AND g.hashes = u.hashes) AS same, (SELECT count(*) FROM g WHERE g.sizes = u.sizes) AS n, (SELECT min(g.unit) FROM g WHERE g.sizes = u.sizes) AS one FROM u),
l AS (SELECT unit, coalesce(same, CASE WHEN n = 1 THEN one END) AS game, CASE WHEN same IS NOT NULL THEN 'verified' WHEN n = 1 THEN 'identified' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS level, n AS candidates FROM f)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.struct(F.col("l_linenumber").alias("number"), F.col("l_quantity").cast("bigint").alias("size"), F.md5((F.col("l_partkey") % 3).cast("string")).alias("hash"))
    units = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.collect_list(track).alias("tracks"))
    return discs.identified(units, units.where("unit % 2 = 0").withColumnRenamed("unit", "game"))


@query(f"WITH {DISC_SQL} SELECT * FROM l")
def disc_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as discs, their lines as tracks; the even ones are the games."""
    return _found(spark, sf_dir)


@query(f"WITH {DISC_SQL} SELECT game, CASE WHEN bool_or(level = 'verified') THEN 'verified' ELSE 'identified' END AS level, count(*) AS units FROM l WHERE game IS NOT NULL GROUP BY game")
def disc_game_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.game_levels(_found(spark, sf_dir))


@query(f"WITH {DISC_SQL} SELECT v.level, count(l.unit) AS units FROM (VALUES ('verified'), ('identified'), ('ambiguous'), ('unknown')) v(level) LEFT JOIN l USING (level) GROUP BY v.level")
def disc_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discs.level_counts(_found(spark, sf_dir))


@query("""
WITH w AS (SELECT 'bios' || p_partkey % 40 || '.rom' AS filename, md5(p_name) AS md5 FROM part WHERE p_partkey % 3 = 0),
f AS (SELECT 'dir' || p_partkey % 9 || '/' || p_partkey || '/' || n AS path, n AS name, md5 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'BIOS' || p_partkey % 40 || '.rom' ELSE 'x' || p_partkey % 5 END AS n, CASE WHEN p_partkey % 5 = 0 THEN md5(p_name) ELSE 'other' END AS md5 FROM part)),
r AS (SELECT w.filename, min(CASE WHEN lower(f.name) = lower(w.filename) THEN path END) AS own, min(CASE WHEN lower(f.name) <> lower(w.filename) THEN path END) AS elsewhere FROM w JOIN f USING (md5) GROUP BY w.filename)
SELECT DISTINCT w.filename, CASE WHEN own IS NOT NULL THEN 'ok' WHEN elsewhere IS NOT NULL THEN 'copy' WHEN EXISTS (SELECT 1 FROM f WHERE lower(f.name) = lower(w.filename)) THEN 'wrong' ELSE 'missing' END AS status, coalesce(own, elsewhere) AS source
FROM w LEFT JOIN r USING (filename)
""")
def system_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System files wanted by name and content, among files that are there."""
    part = table(spark, sf_dir, "part")
    wanted = part.where("p_partkey % 3 = 0").select(F.expr("concat('bios', cast(p_partkey % 40 as string), '.rom')").alias("filename"), F.md5("p_name").alias("md5"))
    name = F.expr("case when p_partkey % 2 = 0 then concat('BIOS', cast(p_partkey % 40 as string), '.rom') else concat('x', cast(p_partkey % 5 as string)) end")
    there = part.select(F.concat(F.expr("concat('dir', cast(p_partkey % 9 as string), '/', cast(p_partkey as string), '/')"), name).alias("path"), name.alias("name"), F.when(F.col("p_partkey") % 5 == 0, F.md5("p_name")).otherwise("other").alias("md5"))
    return discs.system_files(wanted, there)


@query("""
WITH r AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE lower(p_type) IN ('economy', 'small') AND len(list_intersect(string_split(lower(p_name), ' '), ['red', 'small', 'hot', 'blue'])) > 0 AND contains(lower(p_name || chr(10) || p_brand), 'g'))
SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY lower(p_name), p_partkey LIMIT 50 OFFSET 5
""")
def results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of parts by facet filters, search text and order, with the number of all that pass."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", F.split("p_name", " ").alias("words"))
    found = serve.results(rows, {"p_type": ["Economy", "SMALL"], "words": ["Red", "small", "HOT", "blue"], "p_brand": []}, "g", ["p_name", "p_brand"], [F.lower("p_name").asc(), F.col("p_partkey").asc()], 5, 50)
    return found.drop("words")


@query("""
WITH r AS (SELECT *, lower(p_type) IN ('economy', 'small') AS a, len(list_intersect(string_split(lower(p_name), ' '), ['red', 'blue'])) > 0 AS b, contains(lower(p_name || chr(10) || p_brand), 'e') AS c FROM part),
v AS (SELECT 'p_type' AS facet, p_type AS value FROM r WHERE b AND c UNION ALL SELECT 'words', unnest(list_distinct(string_split(p_name, ' '))) FROM r WHERE a AND c UNION ALL SELECT 'p_brand', p_brand FROM r WHERE a AND b AND c)
SELECT facet, value, count(*) AS n, (facet = 'p_type' AND lower(value) IN ('economy', 'small')) OR (facet = 'words' AND lower(value) IN ('red', 'blue')) AS chosen FROM v GROUP BY facet, value
""")
def facets_beside_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of three facets beside a page, each counted under all filters but its own."""
    rows = table(spark, sf_dir, "part").select("p_type", "p_brand", "p_name", F.split("p_name", " ").alias("words"))
    return serve.facets_beside(rows, {"p_type": ["Economy", "SMALL"], "words": ["Red", "blue"], "p_brand": []}, ["p_type", "words", "p_brand"], "E", ["p_name", "p_brand"])


#: Ten files in each folder: one image with all below it and a nested one, two images, one sheet with a nested one, two sheets.
IMAGE_FILE = """case cast(floor(p_partkey / 10) as int) % 4
  when 0 then case p_partkey % 10 when 0 then 'disc.chd' when 9 then 'in/n.chd' when 8 then 'in/side.txt' when 7 then 'in/more/deep.bin' else concat('extra/', p_brand, '-', cast(p_partkey as string), '.bin') end
  when 1 then case p_partkey % 10 when 0 then 'ab.chd' when 1 then 'abc.CHD' when 2 then 'ab-notes.txt' when 3 then 'abcd.txt' when 4 then 'zz.txt' else concat('abc', p_brand, cast(p_partkey as string)) end
  when 2 then case p_partkey % 10 when 0 then 'x.cue' when 9 then 'sub/y.cue' else concat('t', cast(p_partkey as string), '.bin') end
  else case p_partkey % 10 when 0 then 'p.cue' when 1 then 'pq.cue' when 2 then 'p (Track 1).bin' when 3 then 'pq.bin' when 4 then 'sub/far.bin' else concat('other', cast(p_partkey as string), '.iso') end end"""


@query(f"""
WITH f AS (SELECT cast(floor(p_partkey / 10) as int) AS g, p_partkey % 10 AS k, concat('games/', cast(floor(p_partkey / 10) as int)) AS folder, {IMAGE_FILE.replace("as string", "as varchar")} AS file FROM part WHERE p_partkey >= 10),
u AS (SELECT folder || '/' || CASE g % 4 WHEN 0 THEN CASE WHEN k >= 7 THEN 'in/n.chd' ELSE 'disc.chd' END WHEN 1 THEN CASE WHEN k IN (0, 2) THEN 'ab.chd' WHEN k = 4 THEN NULL ELSE 'abc.CHD' END WHEN 2 THEN 'x.cue'
    ELSE CASE WHEN k IN (0, 2) THEN 'p.cue' WHEN k IN (1, 3, 4) THEN 'pq.cue' END END AS unit,
  CASE WHEN g % 4 < 2 THEN 'image' ELSE 'sheet' END AS kind, CASE g % 4 WHEN 0 THEN CASE WHEN k >= 7 THEN folder || '/in' ELSE folder END WHEN 2 THEN folder END AS folder, folder || '/' || file AS path, g, k FROM f),
m AS (SELECT g FROM f GROUP BY g HAVING count(*) = 10)
SELECT unit, kind, folder, path FROM u WHERE unit IS NOT NULL AND g IN (SELECT g FROM m)
""")
def disc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of disc images and sheets by folders, nested folders and names that begin alike."""
    group = F.floor(F.col("p_partkey") / 10)
    part = table(spark, sf_dir, "part").where("p_partkey >= 10")
    whole = part.groupBy(group.alias("g")).agg(F.count(F.lit(1)).alias("n")).where("n = 10")
    rows = part.withColumn("g", group).join(whole, "g", "left_semi")
    folder = F.concat(F.lit("games/"), F.col("g").cast("string"), F.lit("/"))
    files = rows.select("p_partkey", folder.alias("folder"), F.concat(folder, F.expr(IMAGE_FILE)).alias("path"), "g")
    far = files.where("g % 4 = 3 and p_partkey % 10 = 4").select(F.concat("folder", F.lit("pq.cue")).alias("sheet"), "path")
    return units.discovered(files.select("path"), far)


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS disc, l_linenumber AS n, first_value(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity) AS sectors FROM lineitem),
c AS (SELECT *, count(*) OVER (PARTITION BY disc) AS tracks, max(n) OVER (PARTITION BY disc) AS last, min(n) OVER (PARTITION BY disc) AS least FROM l),
p AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE 45000 END + coalesce(sum(sectors) OVER (PARTITION BY disc, n < 3 ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lba FROM c)
SELECT disc, CASE WHEN disc % 7 <> 0 AND tracks = last THEN tracks || chr(10) || string_agg(n || ' ' || lba || ' ' || CASE WHEN n = 2 THEN '0' ELSE '4' END || ' 2352 "It''s ' || n || '.bin" 0', chr(10) ORDER BY n) || chr(10) END AS gdi,
  CASE WHEN disc % 7 = 0 OR least > 1 THEN 'no marks of its areas' WHEN tracks <> last THEN 'track numbers are not 1 to n' END AS problem FROM p GROUP BY disc, tracks, last, least
""")
def sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as discs: cue sheets of their lines as tracks, turned into GDI sheets by area marks and sizes."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("disc"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").cast("long").alias("sectors"))
    number = F.col("n").cast("string")
    file = F.concat(F.lit("It's "), number, F.lit(".bin"))
    mark = F.when(F.col("disc") % 7 == 0, "").when(F.col("n") == 1, "REM SINGLE-DENSITY AREA\n").when(F.col("n") == 3, "REM HIGH-DENSITY AREA\n").otherwise("")
    text = F.concat(mark, F.lit('FILE "'), file, F.lit('" BINARY\r\n  TRACK 0'), number, F.when(F.col("n") == 2, " AUDIO").otherwise(" MODE1/2352"), F.lit("\n"))
    one = F.struct("n", text.alias("text"), file.alias("file"), (F.col("sectors") * sheets.SECTOR).alias("bytes"))
    discs_ = line.groupBy("disc").agg(F.array_sort(F.collect_list(one)).alias("t"))
    rows = discs_.select("disc", F.array_join(F.transform("t", lambda t: t["text"]), "").alias("cue"), F.map_from_arrays(F.transform("t", lambda t: t["file"]), F.transform("t", lambda t: t["bytes"])).alias("sizes"))
    return rows.withColumn("g", sheets.gdi_of_cue(F.col("cue"), F.col("sizes"))).select("disc", F.col("g.text").alias("gdi"), "g.problem")
