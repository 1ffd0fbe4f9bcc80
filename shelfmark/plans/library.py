"""Queries of whole selections, version groups, archives, flags and ratings.

Names are put together from columns of ``part``; the SQL works on these columns and never reads a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import archives, flags, keys, tags
from shelfmark.operators import disk_sets, library, ratings, reports
from shelfmark.sources.tables import spread, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _part(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", *[F.expr(x).alias(n) for n, x in columns.items()]))


#: Attributes of cartridges, in an expression that both engines read.
CART = {
    "dat": "concat('Cart ', cast(p_size % 3 as string))",
    "title": "concat(p_name, ' ', lower(p_type))",
    "region": "case p_partkey % 5 when 0 then 'USA' when 1 then 'Europe' when 2 then 'Japan' when 3 then 'Germany' else 'USA, Europe' end",
    "told": "case p_partkey % 7 when 0 then 'En,Fr' when 1 then 'De' else '' end",
    "version": "case p_size % 4 when 0 then '' when 1 then 'Rev 1' when 2 then 'v1.2' else 'v1.10' end",
    "beta": "p_size > 45",
    "alt": "p_partkey % 11 = 0",
    "bad": "p_partkey % 13 = 0",
}
CART_NAME = "concat(title, ' (', region, ')', case when told = '' then '' else concat(' (', told, ')') end, case when version = '' then '' else concat(' (', version, ')') end, case when beta then ' (Beta)' else '' end, case when alt then ' (Alt)' else '' end, case when bad then '[b1]' else '' end)"


def _sql_columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{x.replace('as string', 'as varchar')} AS {n}" for n, x in columns.items())


CART_SQL = f"""
cart AS (SELECT *, {CART_NAME} AS name FROM (SELECT p_partkey AS key, {_sql_columns(CART)} FROM part)),
have AS (SELECT *, CASE WHEN told = 'En,Fr' THEN 0 WHEN told = 'De' THEN 1 WHEN region IN ('USA', 'Europe', 'USA, Europe') THEN 0 WHEN region = 'Germany' THEN 1 ELSE 2 END AS lang,
    CASE region WHEN 'Europe' THEN 0 WHEN 'USA, Europe' THEN 0 WHEN 'USA' THEN 1 WHEN 'Japan' THEN 3 ELSE 9 END AS place,
    CASE version WHEN '' THEN 0 WHEN 'Rev 1' THEN 1 WHEN 'v1.2' THEN 2 ELSE 3 END AS vkey FROM cart),
judged AS (SELECT *, list_filter([CASE WHEN beta THEN 'pre_release' END, CASE WHEN bad THEN 'bad_dump' END, CASE WHEN lang = 2 THEN 'language' END], lambda x: x IS NOT NULL) AS why FROM have),
won AS (SELECT *, first_value(name) OVER (PARTITION BY dat, title ORDER BY lang, place, vkey DESC, alt, lower(name), name, key) AS winner FROM judged WHERE len(why) = 0),
base AS (
  SELECT key, dat, title, name, CASE WHEN name = winner THEN 'keep' ELSE 'superseded' END AS action, why, CASE WHEN name = winner THEN '' ELSE winner END AS superseded_by FROM won
  UNION ALL SELECT key, dat, title, name, 'excluded', why, '' FROM judged WHERE len(why) > 0
), known AS (SELECT dat, title, CASE WHEN min(key) % 30 >= 5 THEN (length(title) * 7 % 90) / 10.0 + 1 END AS rating, min(key) % 30 AS votes FROM cart GROUP BY dat, title),
game AS (SELECT DISTINCT dat, title, rating, votes FROM base JOIN known USING (dat, title) WHERE action = 'keep'),
last AS (SELECT rating, votes, lower(title) AS t FROM game WHERE rating >= 3 ORDER BY rating DESC, votes DESC, t LIMIT 1 OFFSET 39),
rated AS (SELECT g.dat, g.title, list_filter([CASE WHEN g.rating IS NULL THEN 'rating_unrated' END, CASE WHEN g.rating < 3 THEN 'rating_low' END,
    CASE WHEN g.rating IS NOT NULL AND (SELECT count(*) FROM last) = 1 AND (SELECT (-g.rating, -g.votes, lower(g.title)) > (-l.rating, -l.votes, l.t) FROM last l) THEN 'rating_not_top' END], lambda x: x IS NOT NULL) AS codes FROM game g),
scored AS (SELECT b.* EXCLUDE (action, why), CASE WHEN b.action = 'keep' AND len(r.codes) > 0 THEN 'excluded' ELSE b.action END AS action, CASE WHEN b.action = 'keep' AND len(r.codes) > 0 THEN r.codes ELSE why END AS why
  FROM base b LEFT JOIN rated r USING (dat, title)),
forced AS (SELECT dat, name, min(CASE WHEN key % 97 = 0 THEN 'keep' ELSE 'excluded' END) AS f FROM cart WHERE key % 97 = 0 OR key % 89 = 0 GROUP BY dat, name),
chosen AS (SELECT s.key, s.dat, s.title, s.name, coalesce(f, action) AS action,
    CASE WHEN f IS NULL OR (f = 'keep' AND action = 'keep') THEN array_to_string(why, ',') WHEN f = 'keep' THEN 'override_keep' ELSE 'override_exclude' END AS codes,
    CASE WHEN f IS NULL OR (f = 'keep' AND action = 'keep') THEN superseded_by ELSE '' END AS superseded_by
  FROM scored s LEFT JOIN forced USING (dat, name))"""
CART_PROFILE = library.Profile(languages=["En", "De"], min_rating=3.0, top_n=40)


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, **CART).withColumn("name", F.expr(CART_NAME)).withColumnRenamed("p_partkey", "key")
    known = rows.groupBy("dat", "title").agg(F.min("key").alias("least")).select("dat", "title", ((F.char_length("title") * 7 % 90) / 10 + 1).alias("rating"), (F.col("least") % 30).alias("votes"))
    forced = rows.where("key % 97 = 0 or key % 89 = 0").groupBy("dat", "name").agg(F.min(F.when(F.col("key") % 97 == 0, "keep").otherwise("excluded")).alias("action"))
    items = library.prepared(tags.parse_region_first(rows.select("key", "dat", "name", F.lit("").alias("form")), "name", "t"))
    return library.select(items, CART_PROFILE, rated=known, overrides=forced, styles=(tags.REGION_FIRST,))


@query(f"WITH {CART_SQL} SELECT key, dat, name, action, codes, superseded_by FROM chosen")
def library_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility, one cartridge for each game, ratings with a top 40, overrides: one query."""
    return _chosen(spark, sf_dir).select("key", "dat", "name", "action", F.array_join("codes", ",").alias("codes"), "superseded_by")


@query(f"""
WITH {CART_SQL}, w AS (SELECT *, CASE WHEN action = 'superseded' THEN 'superseded' ELSE codes END AS why FROM chosen)
SELECT dat, title, count(*) AS variants, min_by(string_split(why, ',')[1], (len(string_split(why, ',')), name, why)) AS reason FROM w GROUP BY dat, title, name LIKE '%[b1]' HAVING count(*) FILTER (action = 'keep') = 0
""")
def library_vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the selection above of which nothing is kept, with the reason nearest to being kept."""
    return library.vanished(_chosen(spark, sf_dir)).select("dat", "title", "variants", "reason")


@query(f"WITH {CART_SQL} SELECT action, c AS code, count(*) AS n FROM (SELECT action, unnest(CASE WHEN codes = '' THEN [''] ELSE string_split(codes, ',') END) AS c FROM chosen) GROUP BY action, c")
def library_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.when(F.size("codes") > 0, F.col("codes")).otherwise(F.array(F.lit("")))
    return _chosen(spark, sf_dir).select("action", F.explode(codes).alias("code")).groupBy("action", "code").agg(F.count(F.lit(1)).alias("n"))


#: Releases with versions that a leading zero turns into fractions, some of them on two disks.
RELEASE = {"title": "concat(p_name, ' ', lower(p_type))", "version": "case p_size % 4 when 0 then '' when 1 then 'v1.02' when 2 then 'v1.1' else 'v1.21' end", "disk": "cast(p_partkey % 3 as int)"}
RELEASE_NAME = "concat(title, ' (USA)', case when version = '' then '' else concat(' (', version, ')') end, case when disk = 0 then '' else concat(' (Disk ', cast(disk as string), ' of 2)') end)"


@query(f"""
WITH n AS (SELECT DISTINCT title, version, disk, {RELEASE_NAME.replace("as string", "as varchar")} AS name FROM (SELECT {_sql_columns(RELEASE)} FROM part)),
g AS (SELECT *, disk > 0 AS on_disks, bool_or(version = 'v1.02') OVER (PARTITION BY title, disk > 0) AS padded FROM n),
v AS (SELECT *, CASE version WHEN '' THEN 0 WHEN 'v1.02' THEN 2 WHEN 'v1.1' THEN CASE WHEN padded THEN 10 ELSE 1 END ELSE 21 END AS vkey FROM g),
m AS (SELECT *, max(vkey) OVER (PARTITION BY title, on_disks) AS newest FROM v),
w AS (SELECT *, count(DISTINCT CASE WHEN vkey = newest THEN disk END) OVER (PARTITION BY title, on_disks) AS disks FROM m)
SELECT o.name, b.name AS newer FROM w o JOIN w b ON b.title = o.title AND b.disk = o.disk AND b.vkey = b.newest
WHERE o.vkey < o.newest AND (o.disk = 0 OR o.disks = 2)
""")
def superseded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, **RELEASE).withColumn("name", F.expr(RELEASE_NAME))
    # what supersedes what is told of names, so each is read once
    items = library.prepared(tags.parse_region_first(rows.select(F.lit("Cart").alias("dat"), F.lit("").alias("form"), "name").distinct(), "name", "t"))
    return library.superseded(items).select("name", "newer")


#: Archives with variants by language, chipset, memory, video, version and build.
ARCHIVES = {
    "title": "p_name",
    "lang": "case p_partkey % 3 when 0 then '' when 1 then '_De' else '_EnFr' end",
    "chip": "case p_partkey % 4 when 0 then '_AGA' when 1 then '_CD32' else '' end",
    "memory": "case when p_partkey % 5 = 0 then '_512k' else '' end",
    "ntsc": "case when p_partkey % 7 = 0 then '_NTSC' else '' end",
    "number": "p_size % 12",
    "build": "1000 + p_partkey % 50",
    "author": "case when p_partkey % 19 = 0 then '_Fast_by_Some_One' else '' end",
}
STEM = "concat(replace(title, ' ', ''), '_v1.', cast(number as string), lang, chip, memory, ntsc, author, '_', cast(build as string))"


@query(f"""
WITH a AS (SELECT *, {STEM.replace("as string", "as varchar")} AS stem FROM (SELECT p_partkey AS key, {_sql_columns(ARCHIVES)} FROM part))
SELECT key, stem, title, CASE lang WHEN '' THEN '' WHEN '_De' THEN 'De' ELSE 'En|Fr' END AS languages, 'v1.' || number AS version, CAST(build AS INTEGER) AS build,
  array_to_string(list_filter([CASE WHEN chip <> '' THEN chip[2:] END, CASE WHEN memory <> '' THEN '512KB' END, CASE WHEN ntsc <> '' THEN 'NTSC' END, CASE WHEN author <> '' THEN 'Fast Mem' END, CASE WHEN author <> '' THEN 'Hack' END, CASE WHEN author <> '' THEN 'by Some_One' END], lambda x: x IS NOT NULL), '|') AS flags,
  first_value(stem) OVER (PARTITION BY title, author ORDER BY lang = '_De', CASE chip WHEN '_CD32' THEN 0 WHEN '_AGA' THEN 1 ELSE 2 END, CASE WHEN memory <> '' THEN 2 WHEN author <> '' THEN 1 ELSE 0 END, ntsc <> '', number DESC, build DESC, lower(stem), stem, key) AS winner
FROM a
""")
def archive_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives read from stem and game name, and the best variant of each game."""
    rows = _part(spark, sf_dir, **ARCHIVES).withColumn("name", F.expr(STEM)).withColumnRenamed("p_partkey", "key")
    items = library.prepared(archives.parse_archive(rows.select("key", "name", "title", F.lit("A").alias("dat"), F.lit("").alias("form")), "name", "title", "t"))
    best = library.best_archive(items, library.Profile(languages=["En", "De"]))
    return best.select("key", F.col("name").alias("stem"), F.col("t.title").alias("title"), F.array_join("t.languages", "|").alias("languages"), "t.version", "t.build", F.array_join("t.flags", "|").alias("flags"), "winner")


#: Flags and, found by hand, their kind, whether they are a chipset, their memory, and the disk and the rule they tell.
FLAGS = [
    ("Unl", "licence", False, "", None, None), ("Aftermarket", "licence", False, "", None, None), ("Alt", "alt", False, "", None, None), ("Alt 2", "alt", False, "", None, None), ("1991-05-xx", "date", False, "", None, None), ("20??", "date", False, "", None, None),
    ("PAL60", "video", False, "", None, None), ("Disk 2 of 3", "disk", False, "", 2, None), ("Disc B of C", "disk", False, "", 2, None), ("Side A", "disk", False, "", None, None), ("Zh-Hans", "language", False, "", None, None), ("M5", "language", False, "", None, None),
    ("123456", "serial", False, "", None, None), ("Virtual Console", "distribution", False, "", None, None), ("Switch", "distribution", False, "", None, None), ("Wii Something", "distribution", False, "", None, None), ("Game Jam 7", "event", False, "", None, None),
    ("AGA", "hardware", True, "", None, None), ("OCS-AGA", "other", True, "", None, None), ("SGB Enhanced, GB Compatible", "hardware", False, "", None, None), ("1.5 MB", "hardware", False, "1.5MB", None, None), ("512k", "hardware", False, "512KB", None, None),
    ("Fast Mem", "hardware", False, "Fast Mem", None, None), ("1MB Chip", "hardware", False, "1MB Chip", None, None), ("Beta 3", "other", False, "", None, "pre_release"), ("demo-rolling", "other", False, "", None, "demo"), ("Alt, Proto", "other", False, "", None, "prototype"),
    ("Some Publisher", "other", False, "", None, None), ("Unreleased", "other", False, "", None, "unreleased"),
]


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool | int) else "'" + x + "'"


@query(f"""
WITH f(nth, flag, kind, chipset, memory, disk, rule) AS (VALUES {", ".join("(" + ", ".join(map(_literal, (i, *x))) + ")" for i, x in enumerate(FLAGS))})
SELECT p_partkey, flag, kind, chipset, memory, CAST(disk AS INTEGER) AS disk, rule FROM part JOIN f ON f.nth = p_partkey % {len(FLAGS)}
""")
def flag_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for each part, and what it says."""
    flag = F.get(F.array(*[F.lit(x[0]) for x in FLAGS]), (F.col("p_partkey") % len(FLAGS)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", flag.alias("flag"))
    f = F.col("flag")
    return rows.select("p_partkey", "flag", flags.flag_kind(f).alias("kind"), flags.is_chipset(f).alias("chipset"), flags.memory_tag(f).alias("memory"), flags.disk_words(f)["number"].alias("disk"), tags.token_rule(F.lit("("), f).alias("rule"))


#: Dated names with countries, chipsets, disks, labels and dump flags.
DATED_NAME = "concat(p_name, ' v1.', cast(p_size % 5 as string), ' (', cast(1985 + p_size % 9 as string), ')(', p_brand, ')', case p_partkey % 3 when 0 then '(DE)' when 1 then '(GB)' else '' end, case p_partkey % 4 when 0 then '(de-en)' else '' end, case p_partkey % 5 when 0 then '(AGA)' when 1 then '(OCS-AGA)' else '' end, case when p_partkey % 2 = 0 then '(Disk 1 of 2)(Boot)' else '' end, case p_partkey % 7 when 0 then '[cr FLT][t +2]' when 1 then '[tr fr]' when 2 then '[!]' else '' end)"


@query(f"""
SELECT p_partkey, {DATED_NAME.replace("as string", "as varchar")} AS name, lower(p_name) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'United Kingdom' ELSE '' END || '/' || lower(p_brand) AS identity,
  CASE WHEN p_partkey % 4 = 0 THEN 'De|En' ELSE '' END || '/' || CASE p_partkey % 5 WHEN 0 THEN 'AGA' WHEN 1 THEN 'OCS-AGA' ELSE '' END AS partition,
  CASE p_partkey % 5 WHEN 0 THEN 'AGA' WHEN 1 THEN 'AGA|OCS' ELSE 'OCS' END AS classes, CASE WHEN p_partkey % 5 < 2 THEN 'AGA' ELSE 'OCS' END AS platform_class,
  array_to_string(list_sort(list_distinct(list_filter([CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 = 0 THEN 'De' END, CASE WHEN p_partkey % 4 = 0 OR p_partkey % 3 <> 0 THEN 'En' END, CASE WHEN p_partkey % 7 = 1 THEN 'Fr' END], lambda x: x IS NOT NULL))), '|') AS languages,
  p_partkey % 7 = 0 AS cracked, CAST(CASE WHEN p_partkey % 7 < 2 THEN 1 ELSE 0 END AS INTEGER) AS modifications, CASE p_partkey % 7 WHEN 0 THEN 'cr|t' WHEN 1 THEN 'tr' ELSE '' END AS kinds,
  CAST(1 + CASE WHEN p_partkey % 5 < 2 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END + CASE p_partkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS extra_tags,
  CASE WHEN p_partkey % 2 = 0 THEN 1 END AS disk, p_brand || CASE p_partkey % 5 WHEN 0 THEN '|AGA' WHEN 1 THEN '|OCS-AGA' ELSE '' END AS set_flags
FROM part
""")
def dated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and ranks of dated names: identity, partition, set, chipset classes, languages, modifications."""
    rows = spread(table(spark, sf_dir, "part").select("p_partkey", F.expr(DATED_NAME).alias("name")))
    t = F.col("t")
    identity, part, same_set = keys.identity_key(t), keys.partition_key(t), keys.set_key(t)
    join = lambda c: F.array_join(c, "|")
    return flags.with_details(tags.parse_dated(rows, "name", "t"), "t").select(
        "p_partkey",
        "name",
        F.concat_ws("/", identity["title"], join(identity["regions"]), identity["publisher"]).alias("identity"),
        F.concat_ws("/", join(part["languages"]), join(part["chipset"])).alias("partition"),
        join(t["classes"]).alias("classes"),
        F.get(F.array(*map(F.lit, flags.CLASSES)), t["platform_rank"]).alias("platform_class"),
        join(t["played"]).alias("languages"),
        t["cracked"].alias("cracked"),
        t["modifications"].alias("modifications"),
        join(t["codes"]).alias("kinds"),
        t["extra_tags"].alias("extra_tags"),
        t["disk"]["number"].alias("disk"),
        join(same_set["flags"]).alias("set_flags"),
    )


#: Titles with a word of their own for each part, so that no two resemble each other by chance alone.
OWN_WORD = "concat(translate(cast(p_partkey as string), '0123456789', 'bcdfghklmn'), 'ora')"
ASKED = f"case p_partkey % 4 when 0 then concat(upper(p_name), ': OF ', {OWN_WORD}, ' - II') when 1 then concat('Alt ', {OWN_WORD}, ' Tale, The') when 2 then concat('The ', p_name, ' of ', {OWN_WORD}, ' 2') else concat('zq', cast(p_partkey % 10 as string)) end"


@query(f"""
SELECT p_partkey, {ASKED.replace("as string", "as varchar")} AS title, CASE WHEN p_partkey % 4 < 3 THEN round((1 + p_partkey % 40 / 10.0) * 2, 1) END AS rating, CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 50 + 1 END AS votes,
  CASE WHEN p_partkey % 4 < 3 THEN p_partkey + 1 END AS dbid, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'alt' WHEN 2 THEN 'roman' END AS kind
FROM part
""")
def ratings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles looked up by key, alternate name and roman numerals; short unknown ones have no rating."""
    part = table(spark, sf_dir, "part")
    source = part.select(
        (F.col("p_partkey") + 1).cast("string").alias("DatabaseID"), F.expr(f"concat('The ', p_name, ' of ', {OWN_WORD}, ' II')").alias("Name"), F.lit("P").alias("Platform"), (F.col("p_partkey") % 40 / 10 + 1).cast("string").alias("CommunityRating"), (F.col("p_partkey") % 50 + 1).cast("string").alias("CommunityRatingCount"), F.lit("1990").alias("ReleaseYear"), F.lit(None).cast("string").alias("ReleaseDate")
    )
    alternate = part.select(F.expr(f"concat('The Alt: ', {OWN_WORD}, ' Tale')").alias("AlternateName"), (F.col("p_partkey") + 1).cast("string").alias("DatabaseID"))
    index = ratings.build_index(ratings.rated_games(source, ["P"]), alternate)
    asked = part.select("p_partkey", F.lit("P").alias("plat"), F.expr(ASKED).alias("title"))
    return ratings.look_up(asked, index).select("p_partkey", "title", "rating", "votes", "dbid", "kind")


@query("""
WITH t AS (SELECT p_partkey, concat(p_name, ' ', lower(p_type), ' ', translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789', 'ghijklmnop')) AS title FROM part)
SELECT 'P' AS plat, left(title, length(title) - 1) || 'z' AS key, title AS found, p_partkey AS found_id, (length(title) - 1)::DOUBLE / length(title) AS similarity FROM t
""")
def fuzzy_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long titles with one letter changed against all titles: those that resemble one game alone."""
    part = table(spark, sf_dir, "part")
    title = F.concat_ws(" ", "p_name", F.lower("p_type"), F.expr("translate(md5(cast(p_partkey as string)), '0123456789', 'ghijklmnop')"))
    from shelfmark.operators import fuzzy

    known = part.select(F.lit("P").alias("plat"), title.alias("key"), F.col("p_partkey").alias("dbid"))
    asked = known.select("plat", F.concat(F.left("key", F.char_length("key") - 1), F.lit("z")).alias("key"))
    return fuzzy.matches(asked, known)


#: Dated names of one or two disks, in two languages, some cracked.
DISKS = {"title": "p_name", "number": "p_size % 3", "disk": "p_partkey % 3", "german": "p_partkey % 5 = 0", "cracked": "p_partkey % 7 = 0"}
DISK_NAME = "concat(title, ' v1.', cast(number as string), ' (1990)(Burrow)', case when german then '(de)' else '' end, case when disk = 0 then '' else concat('(Disk ', cast(disk as string), ' of 2)') end, case when cracked then '[cr X]' else '' end)"


#: The rule of sets written over columns: disks of one language; a set begins with each first disk, or with the newest one
#: that fits flags only other disks have; disk 2 is the newest that isn't newer and isn't cracked where the set isn't.
DISK_SETS_SQL = f"""
n AS (SELECT *, {DISK_NAME.replace("as string", "as varchar")} AS name, CASE WHEN disk = 0 THEN 1 ELSE disk END AS d, CASE WHEN disk = 0 THEN 1 ELSE 2 END AS total FROM (SELECT p_partkey AS key, {_sql_columns(DISKS)} FROM part)),
u AS (SELECT * FROM n WHERE total = 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY key) = 1),
a AS (SELECT title, german, cracked AS wanted, number, name, key, cracked, name AS told, 0 AS nth FROM u WHERE d = 1),
w AS (SELECT title, german, cracked AS wanted, min(name) AS told FROM u WHERE d = 2 GROUP BY ALL),
x AS (SELECT w.title, w.german, w.wanted, h.number, h.name, h.key, h.cracked, w.told, 1 AS nth
  FROM w JOIN u h ON h.title = w.title AND h.german = w.german AND h.d = 1 AND (w.wanted OR NOT h.cracked)
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.title = w.title AND a.german = w.german AND a.wanted = w.wanted)
  QUALIFY row_number() OVER (PARTITION BY w.title, w.german, w.wanted ORDER BY h.number DESC, h.cracked DESC, length(h.name), h.name) = 1),
f AS (SELECT p.*, o.key AS other, p.cracked OR o.cracked AS any_cracked
  FROM (SELECT * FROM a UNION ALL SELECT * FROM x) p JOIN u o ON o.title = p.title AND o.german = p.german AND o.d = 2 AND o.number <= p.number AND (p.wanted OR NOT o.cracked)
  QUALIFY row_number() OVER (PARTITION BY p.title, p.german, p.name, p.wanted, p.nth ORDER BY o.number DESC, o.cracked DESC, length(o.name), o.name) = 1),
s AS (SELECT *, concat(title, ' v1.', number, ' (1990)(Burrow)', CASE WHEN german THEN '(de)' ELSE '' END, CASE WHEN wanted THEN '[cr X]' ELSE '' END) AS set_name FROM f
  QUALIFY row_number() OVER (PARTITION BY title, german, key, other ORDER BY nth, told) = 1),
every AS (SELECT title, german, any_cracked AS cracked, number, name, key, other, set_name FROM s UNION ALL SELECT title, german, cracked, number, name, key, NULL, name FROM n WHERE total = 1),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY title ORDER BY german, cracked DESC, number DESC, lower(name), name, key) = 1)"""


@query(f"""
WITH {DISK_SETS_SQL}
SELECT n.key, n.name, CASE WHEN n.key IN (b.key, b.other) THEN 'keep' WHEN b.key IS NOT NULL THEN 'superseded' ELSE 'incomplete' END AS action,
  CASE WHEN n.key NOT IN (b.key, coalesce(b.other, -1)) THEN b.set_name ELSE '' END AS superseded_by, CASE WHEN b.key IS NULL THEN CAST(3 - n.d AS VARCHAR) ELSE '' END AS missing
FROM n LEFT JOIN best b ON b.title = n.title
""")
def library_disk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best complete set of disks of each game, filled as of its version; disks of games without one are incomplete."""
    chosen = _disk_sets(spark, sf_dir)
    return chosen.select("key", "name", "action", "superseded_by", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


#: Two-disk names of three countries and several years, so that many English sets lack a disk.
LENT = {"title": "p_name", "publisher": "p_brand", "country": "case p_partkey % 3 when 0 then '' when 1 then '(DE)' else '(FR)' end", "year": "1985 + p_size % 9", "disk": "1 + p_size % 2"}
LENT_NAME = "concat(title, ' (', cast(year as string), ')(', publisher, ')', country, '(Disk ', cast(disk as string), ' of 2)')"


@query(f"""
WITH n AS (SELECT *, {LENT_NAME.replace("as string", "as varchar")} AS name FROM (SELECT p_partkey AS key, {_sql_columns(LENT)} FROM part)),
a AS (SELECT title, publisher, max(year) FILTER (disk = 1) AS year, bool_or(disk = 2) AS whole FROM n WHERE country = '' GROUP BY title, publisher),
o AS (SELECT * FROM n WHERE disk = 2 AND country <> '' QUALIFY row_number() OVER (PARTITION BY title, publisher ORDER BY year DESC, length(name), name, key) = 1)
SELECT concat(a.title, ' (', a.year, ')(', a.publisher, ')') AS set_name, 2 AS slot, o.key, o.name, CASE WHEN a.year = o.year THEN 'country,language' ELSE 'country,language,year' END AS differences,
  concat('borrowed as disk 2 of ', a.title, ' (', a.year, ')(', a.publisher, ') from the ', o.country, ' edition') AS text
FROM a JOIN o ON o.title = a.title AND o.publisher = a.publisher WHERE a.year IS NOT NULL AND NOT a.whole
""")
def library_borrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disks of other countries that complete English sets of the same title and publisher."""
    rows = _part(spark, sf_dir, **LENT).withColumn("name", F.expr(LENT_NAME)).withColumnRenamed("p_partkey", "key")
    items = library.prepared(tags.parse_dated(rows.select("key", F.lit("D").alias("dat"), "name", F.lit("").alias("form")), "name", "t"))
    sets = library.dated_sets(items, library.Profile(languages=["En"]))
    return disk_sets.borrowed(sets).select("set_name", "slot", "key", "name", F.array_join("differences", ",").alias("differences"), "text")


def _disk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _part(spark, sf_dir, **DISKS).withColumn("name", F.expr(DISK_NAME)).withColumnRenamed("p_partkey", "key")
    items = library.prepared(tags.parse_dated(rows.select("key", F.lit("D").alias("dat"), "name", F.lit("").alias("form")), "name", "t"))
    return library.select(items, library.Profile(languages=["En", "De"], borrow_editions=False), styles=(tags.DATED,))


@query(f"""
WITH {CART_SQL}, {DISK_SETS_SQL},
c AS (SELECT key, CASE WHEN lang <> first_value(lang) OVER x THEN 'preferred language' WHEN place <> first_value(place) OVER x THEN 'preferred region' WHEN vkey <> first_value(vkey) OVER x THEN 'newer version' WHEN alt <> first_value(alt) OVER x THEN 'fewer tags' ELSE 'name order' END AS why, name <> winner AS lost
  FROM won WINDOW x AS (PARTITION BY dat, title ORDER BY lang, place, vkey DESC, alt, lower(name), name, key)),
z AS (SELECT *, {STEM.replace("as string", "as varchar")} AS stem, CASE chip WHEN '_CD32' THEN 0 WHEN '_AGA' THEN 1 ELSE 2 END AS chips, CASE WHEN memory <> '' THEN 2 WHEN author <> '' THEN 1 ELSE 0 END AS mem FROM (SELECT p_partkey AS key, {_sql_columns(ARCHIVES)} FROM part)),
r AS (SELECT key, CASE WHEN (lang = '_De') <> first_value(lang = '_De') OVER x THEN 'preferred language' WHEN chips <> first_value(chips) OVER x THEN 'better chipset' WHEN mem <> first_value(mem) OVER x THEN 'standard memory' WHEN ntsc <> first_value(ntsc) OVER x THEN 'PAL instead of NTSC'
    WHEN number <> first_value(number) OVER x THEN 'newer version' WHEN build <> first_value(build) OVER x THEN 'higher build number' ELSE 'name order' END AS why, stem <> first_value(stem) OVER x AS lost
  FROM z WINDOW x AS (PARTITION BY title, author ORDER BY lang = '_De', chips, mem, ntsc <> '', number DESC, build DESC, lower(stem), stem, key)),
i AS (SELECT n.key, b.key AS best, b.other, e.german, e.cracked, e.number, b.german AS bg, b.cracked AS bc, b.number AS bn, e.key AS known
  FROM n JOIN best b ON b.title = n.title LEFT JOIN every e ON e.title = n.title AND n.key IN (e.key, e.other)
  QUALIFY row_number() OVER (PARTITION BY n.key ORDER BY e.german, e.cracked DESC, e.number DESC, lower(e.name), e.name, e.key) = 1)
SELECT 'cartridge' AS kind, key, why FROM c WHERE lost
UNION ALL SELECT 'archive', key, why FROM r WHERE lost
UNION ALL SELECT 'set', key, CASE WHEN known IS NULL THEN 'complete set' WHEN german <> bg THEN 'preferred language' WHEN cracked <> bc THEN 'cracked' WHEN number <> bn THEN 'newer version' ELSE 'name order' END FROM i WHERE key NOT IN (best, coalesce(other, -1))
""")
def library_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why cartridges, archives and sets of disks yield to what supersedes them: the first criterion that differs."""
    carts = _part(spark, sf_dir, **CART).withColumn("name", F.expr(CART_NAME)).withColumnRenamed("p_partkey", "key")
    items = library.prepared(tags.parse_region_first(carts.select("key", "dat", "name", F.lit("").alias("form")), "name", "t"))
    chosen = library.select(items, library.Profile(languages=["En", "De"]), styles=(tags.REGION_FIRST,))
    stems = _part(spark, sf_dir, **ARCHIVES).withColumn("name", F.expr(STEM)).withColumnRenamed("p_partkey", "key")
    packed = library.prepared(archives.parse_archive(stems.select("key", "name", "title", F.lit("A").alias("dat"), F.lit("").alias("form")), "name", "title", "t"))
    best = library.best_archive(packed, library.Profile(languages=["En", "De"]))
    of = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), "key", "why")
    lost = F.col("action") == library.SUPERSEDED
    return of("cartridge", chosen.where(lost)).union(of("archive", best.where("name <> winner"))).union(of("set", _disk_sets(spark, sf_dir).where(lost)))


DISCS = {"title": "p_name", "region": "case p_partkey % 3 when 0 then 'USA' when 1 then 'Europe' else 'Germany' end", "disc": "1 + p_partkey % 2", "revision": "p_size % 3"}
DISC_NAME = "concat(title, ' (', region, ') (Disc ', cast(disc as string), ')', case when revision = 0 then '' else concat(' (Rev ', cast(revision as string), ')') end)"


@query(f"""
WITH n AS (SELECT *, {DISC_NAME.replace("as string", "as varchar")} AS name, region = 'Germany' AS german, CASE region WHEN 'Europe' THEN 0 WHEN 'USA' THEN 1 ELSE 2 END AS place FROM (SELECT p_partkey AS key, {_sql_columns(DISCS)} FROM part)),
w AS (SELECT *, first_value({{'region': region, 'name': name}}) OVER (PARTITION BY title ORDER BY disc, german, place, revision DESC, lower(name), name, key) AS best,
  first_value(name) OVER (PARTITION BY title, region, disc ORDER BY revision DESC, lower(name), name, key) AS own FROM n),
r AS (SELECT *, CASE WHEN region = best.region THEN own ELSE best.name END AS winner FROM w)
SELECT key, name, CASE WHEN name = winner THEN 'keep' ELSE 'superseded' END AS action, CASE WHEN name = winner THEN '' ELSE winner END AS superseded_by FROM r
""")
def library_disc_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best edition of each game on discs, with the newest revision of each of its discs."""
    rows = _part(spark, sf_dir, **DISCS).withColumn("name", F.expr(DISC_NAME)).withColumnRenamed("p_partkey", "key")
    items = library.prepared(tags.parse_disc(rows.select("key", F.lit("D").alias("dat"), "name", F.lit("").alias("form")), "name", "t"))
    return library.select(items, library.Profile(languages=["En", "De"]), styles=(tags.DISC,)).select("key", "name", "action", "superseded_by")


VANISHED_SQL = f"""{CART_SQL}, lists AS (SELECT c.*, name LIKE '%[b1]' AS bad1, CASE WHEN action = 'excluded' AND codes <> '' THEN string_split(codes, ',') ELSE [action] END AS why FROM chosen c),
spoken AS (SELECT key, CASE told WHEN 'En,Fr' THEN ['En', 'Fr'] WHEN 'De' THEN ['De'] ELSE CASE region WHEN 'Japan' THEN ['Ja'] WHEN 'Germany' THEN ['De'] ELSE ['En'] END END AS played FROM cart),
grouped AS (SELECT dat, title, bad1, min(len(why)) AS least, count(*) AS variants, min_by(name, (len(why), lower(name), name, l.key)) AS name, list_sort(list_distinct(flatten(list(played)))) AS played
  FROM lists l JOIN spoken s ON s.key = l.key GROUP BY dat, title, bad1 HAVING count(*) FILTER (action = 'keep') = 0),
ranked AS (SELECT DISTINCT g.dat, g.title, g.bad1, c, CASE c WHEN 'rating_low' THEN 1 WHEN 'rating_not_top' THEN 2 WHEN 'rating_unrated' THEN 3 WHEN 'language' THEN 4 WHEN 'bad_dump' THEN 11 WHEN 'pre_release' THEN 14 ELSE 99 END AS p
  FROM grouped g JOIN lists l ON l.dat = g.dat AND l.title = g.title AND l.bad1 = g.bad1 AND len(l.why) = g.least, unnest(l.why) u(c)),
lost AS (SELECT g.*, r.codes, string_split(r.codes, ',')[1] AS reason FROM grouped g JOIN (SELECT dat, title, bad1, string_agg(c, ',' ORDER BY p, c) AS codes FROM ranked GROUP BY dat, title, bad1) r USING (dat, title, bad1))"""


@query(f"""
WITH {VANISHED_SQL} SELECT dat, title, name, variants, codes, reason, CASE reason WHEN 'language' THEN 'no version in selected languages (has ' || array_to_string(list_concat(list_filter(played, lambda x: x = 'En'), list_filter(played, lambda x: x <> 'En')), ', ') || ')'
  WHEN 'rating_low' THEN 'below the minimum rating' WHEN 'rating_not_top' THEN 'not among the top rated games' WHEN 'rating_unrated' THEN 'no usable rating (unknown, or too few votes)'
  WHEN 'bad_dump' THEN 'every version excluded: bad dump' WHEN 'pre_release' THEN 'every version excluded: pre-release' WHEN 'override_exclude' THEN 'every version excluded: always excluded by you' ELSE 'every version excluded: ' || reason END AS text,
  CASE reason WHEN 'rating_low' THEN 'lower the minimum rating' WHEN 'rating_not_top' THEN 'raise Top N' WHEN 'rating_unrated' THEN 'tick Keep unrated games (or lower Minimum votes)' ELSE '' END AS hint FROM lost
""")
def library_vanish_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the selection of which nothing is kept: why by priority of codes, and in words (without the rating's figures)."""
    lost = reports.vanished(_chosen(spark, sf_dir)).withColumn("detail", F.lit(""))
    return reports.vanish_report(lost).select("dat", "title", "name", "variants", F.array_join("codes", ",").alias("codes"), "reason", "text", "hint")


@query(f"""
WITH {VANISHED_SQL} SELECT 'titles' AS kind, '' AS code, count(*) AS n FROM lost UNION ALL SELECT 'reason', reason, count(*) FROM lost GROUP BY reason
UNION ALL SELECT 'code', c, count(*) FROM (SELECT unnest(string_split(codes, ',')) AS c FROM lost) GROUP BY c
""")
def library_vanish_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.vanish_summary(reports.vanished(_chosen(spark, sf_dir)))


@query("""
WITH d AS (SELECT 'D' || p_partkey % 2 AS dat, p_brand || ' ' || lower(p_type) AS title, CASE p_size % 4 WHEN 0 THEN '[cr X]' WHEN 1 THEN '[a2]' ELSE '' END AS flag, 2 + p_size % 3 AS total, p_partkey % 6 <> 0 AS told FROM part)
SELECT dat, title || ' (1990)(Soft)' || flag AS base, array_to_string(list_sort(list(DISTINCT total)), ',') AS totals FROM d WHERE told GROUP BY dat, title, flag HAVING count(DISTINCT total) > 1
""")
def ambiguous_disk_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose disks belong to sets of different sizes; names are made of brand, type and size."""
    name = "concat(p_brand, ' ', lower(p_type), ' (1990)(Soft)', if(p_partkey % 6 = 0, '', concat('(Disk 1 of ', 2 + p_size % 3, ')')), if(p_partkey % 5 = 0, '(Intro)', ''), case p_size % 4 when 0 then '[cr X]' when 1 then '[a2]' else '[!]' end, if(p_partkey % 7 = 0, '.adf', ''))"
    rows = table(spark, sf_dir, "part").select(F.expr("concat('D', p_partkey % 2)").alias("dat"), F.expr(name).alias("name"))
    return reports.ambiguous_bases(rows).select("dat", "base", F.array_join("totals", ",").alias("totals"))


@query("""
WITH c AS (SELECT o_orderpriority AS dat, CASE WHEN o_orderpriority LIKE '%1%' OR o_orderpriority LIKE '%5%' THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS set_name, CAST(l_suppkey AS VARCHAR) AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT dat, CASE WHEN max(set_name) <> '' THEN 'game' ELSE 'rom' END AS counts, count(DISTINCT CASE WHEN set_name <> '' THEN set_name ELSE name END) AS units, count(*) AS roms FROM c GROUP BY dat
""")
def catalogue_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order priority's catalogue counts: parts as sets, or suppliers where it has no sets."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_suppkey").cast("string").alias("name"))
    both = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dat")), "o_orderkey")
    unset = F.col("dat").contains("1") | F.col("dat").contains("5")
    return reports.catalogue_units(both.select("dat", F.when(~unset, F.col("l_partkey").cast("string")).otherwise("").alias("set_name"), "name"))
