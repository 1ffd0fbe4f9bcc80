"""Queries of the match family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import match
from shelfmark.sources.tables import CATALOG_SQL, library_views, table
from shelfmark.sources.work import saved

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.loose(*library_views(spark, sf_dir))


@query(f"WITH {CATALOG_SQL} SELECT entry, dat, dat_priority, ord, name, set_name, via FROM matches")
def hash_match_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


@query(f"WITH {CATALOG_SQL} SELECT e.entry, c.dat, c.dat_priority, c.ord, c.name, c.set_name FROM entries e JOIN catalog c ON e.crc = c.crc AND e.size = c.size")
def hash_match_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.member(*library_views(spark, sf_dir))


#: Characters of the header that some catalogues leave out of their hashes.
HEADER = 16


@query(f"""
WITH v AS (
  SELECT doc_id AS entry, 0 AS nth, 'whole' AS variant, length(text) AS size, sha1(text) AS sha1 FROM documents
  UNION ALL SELECT doc_id, 1, 'headerless', length(text) - {HEADER}, sha1(substr(text, {HEADER + 1})) FROM documents WHERE length(text) > {HEADER}
), c AS (
  SELECT source AS dat, 'doc-' || doc_id AS name, size, sha1 FROM v JOIN documents ON doc_id = entry WHERE nth = doc_id % 2
), h AS (SELECT v.entry, v.nth, v.variant, c.dat, c.name FROM v JOIN c USING (sha1, size))
SELECT entry, variant, dat, name FROM h WHERE nth = (SELECT min(nth) FROM h AS o WHERE o.entry = h.entry)
""")
def alt_variant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues hash every second text whole and the others without their header; a file matches whole
    if it can, else without its header. Texts are hashed whole or from the header's end, never in part."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = F.char_length("text").cast("bigint")
    whole = F.struct(F.lit(0).alias("nth"), F.lit("whole").alias("variant"), size.alias("size"), F.sha1("text").alias("sha1"))
    bare = F.struct(F.lit(1).alias("nth"), F.lit("headerless").alias("variant"), (size - HEADER).alias("size"), F.sha1(F.substring("text", HEADER + 1, 2_000_000_000)).alias("sha1"))
    variants = F.when(size > HEADER, F.array(whole, bare)).when(size.isNotNull(), F.array(whole))
    each = saved(d.select("doc_id", "source", F.inline(variants)), "variants")
    rows = each.where("nth = doc_id % 2").select(F.col("source").alias("dat"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), "size", F.lit("").alias("crc"), "sha1")
    return match.first_variant(each.drop("source").withColumnRenamed("doc_id", "entry"), rows)


@query(f"WITH {CATALOG_SQL} SELECT entry, dat, dat_priority, ord, name, set_name, via FROM matches m WHERE dat_priority = (SELECT min(dat_priority) FROM matches o WHERE o.entry = m.entry)")
def primary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.primary(_matches(spark, sf_dir))


@query(f"""
WITH {CATALOG_SQL}, u AS (SELECT *, coalesce(set_name, name) AS unit, row_number() OVER (PARTITION BY dat, coalesce(set_name, name) ORDER BY ord) AS nth FROM catalog)
SELECT dat, unit, ord, name FROM u WHERE nth = 1
  AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.dat = u.dat AND coalesce(m.set_name, m.name) = u.unit)
""")
def missing_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, rows = library_views(spark, sf_dir)
    return match.missing(rows, match.by_content(entries, rows)).select("dat", "unit", "ord", "name")


@query(f"""
WITH {CATALOG_SQL}, s AS (SELECT dat, coalesce(set_name, name) AS unit, min(ord) AS ord, count(*) AS roms FROM catalog GROUP BY ALL),
f AS (SELECT dat, coalesce(set_name, name) AS unit, count(DISTINCT entry) AS files FROM matches GROUP BY ALL)
SELECT s.dat, s.unit, s.ord, s.roms, coalesce(f.files, 0) AS files, f.files IS NOT NULL AS have FROM s LEFT JOIN f ON s.dat = f.dat AND s.unit = f.unit
""")
def game_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, rows = library_views(spark, sf_dir)
    return match.game_status(rows, match.by_content(entries, rows))


@query(f"""
WITH {CATALOG_SQL}, t AS (SELECT dat, count(DISTINCT coalesce(set_name, name)) AS total FROM catalog GROUP BY dat),
h AS (SELECT dat, count(DISTINCT coalesce(set_name, name)) AS have, count(DISTINCT entry) AS files FROM matches GROUP BY dat)
SELECT t.dat, total, coalesce(have, 0) AS have, coalesce(files, 0) AS files, total - coalesce(have, 0) AS missing FROM t LEFT JOIN h ON t.dat = h.dat
""")
def per_dat_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, rows = library_views(spark, sf_dir)
    return match.per_dat(rows, match.by_content(entries, rows))


@query(f"""
WITH {CATALOG_SQL}
SELECT (SELECT count(*) FROM entries) AS files, (SELECT count(DISTINCT entry) FROM matches) AS matched,
  (SELECT count(*) FROM entries) - (SELECT count(DISTINCT entry) FROM matches) AS unmatched,
  (SELECT count(*) FROM (SELECT DISTINCT dat, coalesce(set_name, name) FROM catalog)) AS units_total,
  (SELECT count(*) FROM (SELECT DISTINCT dat, coalesce(set_name, name) FROM matches)) AS units_have
""")
def summary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, rows = library_views(spark, sf_dir)
    found = match.by_content(entries, rows)
    one = F.lit(1).alias("one")
    matched = found.select("entry", "files").distinct().agg(F.coalesce(F.sum("files"), F.lit(0)).alias("matched"))
    files = entries.agg(F.count(F.lit(1)).alias("files")).select("files", one).join(matched.select("matched", one), "one")
    units = rows.select("dat", match.counting_unit().alias("unit")).distinct().join(match.covered(found).withColumn("hit", F.lit(1)), ["dat", "unit"], "left")
    units = units.agg(F.count(F.lit(1)).alias("units_total"), F.count("hit").alias("units_have"))
    return files.join(units.select("*", one), "one").select("files", "matched", (F.col("files") - F.col("matched")).alias("unmatched"), "units_total", "units_have")


@query(f"WITH {CATALOG_SQL} SELECT v.via, count(DISTINCT m.entry) AS n FROM (VALUES ('sha1'), ('crc'), ('member')) v(via) LEFT JOIN matches m ON m.via = v.via GROUP BY v.via")
def matched_via_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.by_content(*library_views(spark, sf_dir)).select("entry", "via", "files").distinct()
    counts = found.agg(*[F.coalesce(F.sum(F.when(F.col("via") == v, F.col("files"))), F.lit(0)).alias(v) for v in ("sha1", "crc", "member")])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("via"), F.col(v).alias("n")) for v in ("sha1", "crc", "member")])))


@query(f"""
WITH {CATALOG_SQL}, p AS (SELECT DISTINCT entry, dat, coalesce(set_name, name) AS unit FROM matches m WHERE dat_priority = (SELECT min(dat_priority) FROM matches o WHERE o.entry = m.entry)),
n AS (SELECT entry, entry = min(entry) OVER (PARTITION BY dat, unit) AS new FROM p)
SELECT entry FROM n GROUP BY entry HAVING NOT bool_or(new)
""")
def count_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.repeated_entries(*library_views(spark, sf_dir))


@query("""
WITH r AS (SELECT doc_id, sha1(text) AS sha1, lang, source, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY sha1(text) ORDER BY lang <> 'en', source, length(text) DESC, doc_id) = 1 AS keeper
  FROM documents WINDOW g AS (PARTITION BY sha1(text)))
SELECT doc_id, sha1, group_size, keeper FROM r WHERE group_size > 1
""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"), "lang", "source", F.char_length("text").alias("chars"))
    rank = [(F.col("lang") != "en").asc(), F.col("source").asc(), F.col("chars").desc(), F.col("doc_id").asc()]
    return match.duplicates(d, ["sha1"], rank).select("doc_id", "sha1", "group_size", "keeper")


@query("""
WITH o AS (SELECT l_orderkey AS key, list_sort(list(CAST(l_quantity AS BIGINT))) AS sizes FROM lineitem GROUP BY l_orderkey),
g AS (SELECT sizes, min(key) AS game FROM o GROUP BY sizes HAVING count(*) > 1)
SELECT o.key AS unit, g.game, array_to_string(sizes, ',') AS sizes FROM o JOIN g USING (sizes) WHERE o.key <> g.game
""")
def size_tuple_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose ordered quantities are those of an earlier one. The games are the first orders of
    each tuple that occurs again, so a tuple that many share makes one row for each of them."""
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("bigint"))).alias("sizes"))
    games = sizes.groupBy("sizes").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return match.by_size_tuple(sizes, games).where("unit <> game").select("unit", "game", F.array_join("sizes", ",").alias("sizes"))
