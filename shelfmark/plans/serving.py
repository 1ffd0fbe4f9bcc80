"""Queries of the serving, planning, totals and name families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import names, tags
from shelfmark.operators import changes, serve, slots, totals
from shelfmark.sources.tables import spread, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT facet, value, count(*) AS n FROM (SELECT DISTINCT p_partkey, facet, value FROM (
  SELECT p_partkey, 'brand' AS facet, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part
  UNION ALL SELECT p_partkey, 'word', unnest(string_split(p_name, ' ')) FROM part)) GROUP BY facet, value
""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"brand": F.array("p_brand"), "type": F.array("p_type"), "word": F.split("p_name", " ")}
    return serve.facets(table(spark, sf_dir, "part"), columns)


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("rating"), F.col("p_retailprice").alias("votes"), F.expr("cast(p_partkey % 7 as int)").alias("year"))


GAMES_SQL = "(SELECT p_partkey, p_name, p_type, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS rating, p_retailprice AS votes, CAST(p_partkey % 7 AS INTEGER) AS year FROM part)"


def _sorted(kind: str, order: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return serve.page(_games(spark, sf_dir), serve.order_of(kind, "rating", "votes", "p_name", "year", "votes", "p_partkey"), 10, 200).select("p_partkey", "p_name", "rating")

    f.__name__ = f"sort_{kind}"
    query(f"SELECT p_partkey, p_name, rating FROM {GAMES_SQL} ORDER BY {order} LIMIT 200 OFFSET 10")(f)


_sorted("rating_desc", "rating DESC NULLS LAST, votes DESC NULLS LAST, lower(p_name), p_partkey")
_sorted("rating_asc", "rating ASC NULLS LAST, votes ASC NULLS LAST, lower(p_name), p_partkey")
_sorted("name_desc", "lower(p_name) DESC, p_partkey")
_sorted("name_asc", "lower(p_name), p_partkey")
_sorted("year_desc", "year DESC NULLS LAST, lower(p_name), p_partkey")
_sorted("size_asc", "votes ASC NULLS LAST, lower(p_name), p_partkey")


@query(f"SELECT p_partkey, p_name, p_type FROM {GAMES_SQL} WHERE contains(lower(p_name || chr(10) || p_type), 'an') ORDER BY lower(p_name), p_partkey LIMIT 100")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serve.search(_games(spark, sf_dir), "AN", ["p_name", "p_type"])
    return serve.page(found, serve.order_of("name_asc", "rating", "votes", "p_name", "year", "votes", "p_partkey")).select("p_partkey", "p_name", "p_type")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND event_type <> 'error'")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type as the log's last word; failures are left out."""
    log = table(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type")).withColumn("at", F.struct("ts", "event_id"))
    return changes.replay(log, "key", "at", "event_type", failed="error").select("event_id", "user_id", "event_type", "value")


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def cache_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.work_list(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])


MOVES_SQL = """
moves AS (SELECT page_id, url AS source, regexp_extract(url, '^https?://([^/?#]*)', 1) || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[0-9]+', 'n', 'g') AS target FROM pages)"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.regexp_extract("url", "^https?://([^/?#]*)", 1), F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source"), F.concat(host, F.regexp_replace(path, "[0-9]+", "n")).alias("target"))


@query(f"""
WITH {MOVES_SQL} SELECT page_id, target, CASE WHEN source = target THEN 'ok'
  WHEN row_number() OVER (PARTITION BY lower(target) ORDER BY source = target DESC, source, page_id) = 1 THEN 'move' ELSE 'conflict' END AS status FROM moves
""")
def plan_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.claims(_moves(spark, sf_dir), "page_id", "source", "target").select("page_id", "target", "status")


@query(f"""
WITH {MOVES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY lower(target) ORDER BY source, page_id) AS nth FROM moves)
SELECT page_id, CASE WHEN nth = 1 THEN target ELSE target || ' (' || nth || ')' END AS free_target FROM n
""")
def name_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.numbered(_moves(spark, sf_dir), "target", [F.col("source"), F.col("page_id")]).select("page_id", "free_target")


@query(f"""
WITH {MOVES_SQL}, s AS (SELECT CASE WHEN source = target THEN 'ok' WHEN row_number() OVER (PARTITION BY lower(target) ORDER BY source = target DESC, source, page_id) = 1 THEN 'move' ELSE 'conflict' END AS status FROM moves)
SELECT v.status, count(s.status) AS n FROM (VALUES ('ok'), ('move'), ('conflict'), ('skip')) v(status) LEFT JOIN s ON s.status = v.status GROUP BY v.status
""")
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.status_counts(changes.claims(_moves(spark, sf_dir), "page_id", "source", "target"), "status", ["ok", "move", "conflict", "skip"])


@query("""
SELECT coalesce(t.p_partkey, o.l_partkey) AS part, CASE WHEN t.p_partkey IS NOT NULL AND o.l_partkey IS NOT NULL THEN 'have' WHEN t.p_partkey IS NOT NULL THEN 'missing' ELSE 'outside' END AS state
FROM (SELECT p_partkey FROM part WHERE p_size > 25) t FULL JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R') o ON t.p_partkey = o.l_partkey
""")
def totals_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("part"))
    owned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")).distinct()
    return totals.combined(target, owned, ["part"])


TITLE = """case p_partkey % 5 when 0 then concat('The ', upper(p_name), ' & Co.: ', p_type, ', The') when 1 then concat(p_name, ' II - A ', p_type, '’s Tale') when 2 then concat('Poké', p_name, ' / ', p_type) when 3 then concat('An ', p_name, '!!') else concat('Thé ', p_type, ' X') end"""


@query(f"""
SELECT p_partkey, {TITLE} AS title, CASE p_partkey % 5 WHEN 0 THEN p_name || ' and co ' || lower(p_type) WHEN 1 THEN p_name || ' ii ' || lower(p_type) || 's tale' WHEN 2 THEN 'poke' || p_name || ' ' || lower(p_type)
  WHEN 3 THEN p_name ELSE lower(p_type) || ' x' END AS title_key,
  CASE p_partkey % 5 WHEN 1 THEN p_name || ' 2 ' || lower(p_type) || 's tale' WHEN 0 THEN p_name || ' and co ' || lower(p_type) WHEN 2 THEN 'poke' || p_name || ' ' || lower(p_type) WHEN 3 THEN p_name ELSE lower(p_type) || ' x' END AS roman_key,
  CASE p_partkey % 5 WHEN 1 THEN '2' WHEN 4 THEN '10' ELSE '' END AS numbers
FROM part
""")
def title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with articles, marks, segments and numerals, as they are compared."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(TITLE).alias("title")).withColumn("title_key", names.title_key("title"))
    return rows.select("p_partkey", "title", "title_key", names.roman_key("title_key").alias("roman_key"), F.array_join(names.number_signature("title_key"), ",").alias("numbers"))


VERSION = "case o_orderkey % 8 when 0 then '' when 1 then concat('Rev ', cast(o_orderkey as string)) when 2 then 'Rev AB' when 3 then concat('v', cast(o_orderkey % 7 as string), '.', cast(o_custkey as string)) when 4 then concat('v1.', cast(o_custkey % 9 as string), 'b') when 5 then concat('v2.0-beta', cast(o_custkey % 4 as string)) when 6 then concat('v1.3 rev', cast(o_custkey as string)) else 'Special' end"


@query(f"""
SELECT o_orderkey, {VERSION.replace("as string", "as varchar")} AS version, CASE o_orderkey % 8 WHEN 0 THEN '0' WHEN 1 THEN '1,' || o_orderkey WHEN 2 THEN '1,28' WHEN 3 THEN '1,' || o_orderkey % 7 || ',' || o_custkey WHEN 4 THEN '1,1,' || o_custkey % 9 || ',2'
  WHEN 5 THEN '1,2,-1,1000002,' || o_custkey % 4 WHEN 6 THEN '1,1,3,0,' || o_custkey ELSE '1,0' END AS version_key,
  (SELECT coalesce(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), '.'), '0') FROM unnest(regexp_extract_all({VERSION.replace("as string", "as varchar")}, '[0-9]+')) t(x)) AS numbers
FROM orders
""")
def version_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(VERSION).alias("version"))
    return rows.select("o_orderkey", "version", F.array_join(tags.version_key(F.col("version")).cast("array<string>"), ",").alias("version_key"), F.array_join(names.version_parts("version").cast("array<string>"), ".").alias("numbers"))


@query("""
SELECT doc_id, regexp_replace(source || '.' || lang, '\\.[A-Za-z0-9]{1,5}$', '') AS stem, lpad(to_hex(n_chars), 8, '0') AS digest, md5(lang) = md5(lang) AS equal FROM documents
""")
def name_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        names.strip_ext(F.concat_ws(".", "source", "lang")).alias("stem"),
        F.upper(names.hex_digest(F.hex("n_chars"), 8)).alias("digest"),
        names.equal_if_known(F.md5("lang"), F.upper(F.md5("lang"))).alias("equal"),
    )


@query("""
SELECT p_partkey, p_name || ' (Vol ' || p_size || ')' AS title, 'USA|Europe' AS regions, CASE WHEN p_size % 2 = 0 THEN 'En|Fr' ELSE 'En' END AS languages, p_size % 2 = 1 AS implied,
  'v1.' || p_size AS version, CASE WHEN p_size > 40 THEN 'Beta' ELSE '' END AS status, p_brand || '|Alt' AS flags, p_size < 5 AS bad, 'NTSC|PAL' AS video, CASE WHEN p_size > 40 THEN 'pre_release' ELSE '' END ||
  CASE WHEN p_size < 5 THEN 'bad_dump' ELSE '' END AS rules
FROM part
""")
def tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names put together from parts and parsed again."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    name = F.concat(F.col("p_name"), F.lit(" (Vol "), size, F.lit(") (USA, Europe) "), F.when(F.col("p_size") % 2 == 0, "(En,Fr) ").otherwise(""), F.lit("(v1."), size, F.lit(") ("), F.col("p_brand"), F.lit(") "), F.when(F.col("p_size") > 40, "(Beta) ").otherwise(""), F.lit("(Alt)"), F.when(F.col("p_size") < 5, "[b2 cut]").otherwise(""), F.lit(".rom"))
    rows = tags.parse_region_first(part.select("p_partkey", name.alias("name")), "name", "t")
    join = lambda c: F.array_join(c, "|")
    rules = F.array_join(tags.exclusion_rules(F.col("t.status"), F.col("t.flags"), F.col("t.dump_flags")), "")
    return rows.select("p_partkey", "t.title", join("t.regions").alias("regions"), join("t.languages").alias("languages"), F.col("t.languages_implied").alias("implied"), "t.version", "t.status", join("t.flags").alias("flags"), "t.bad", join("t.video").alias("video"), rules.alias("rules"))


@query("""
SELECT o_orderkey, 'Game ' || o_custkey AS title, 'v' || (o_orderkey % 9) || '.' || (o_orderkey % 13) AS version, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus || ' Soft' AS publisher,
  'Germany|France' AS regions, 'De|Fr' AS languages, '1-' || (o_orderkey % 9) || '-' || (o_orderkey % 13) AS version_key
FROM orders
""")
def tag_parse_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.lit("v"), (F.col("o_orderkey") % 9).cast("string"), F.lit("."), (F.col("o_orderkey") % 13).cast("string"))
    name = F.concat(F.lit("Game "), F.col("o_custkey").cast("string"), F.lit(" "), version, F.lit(" ("), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(")("), F.col("o_orderstatus"), F.lit(" Soft)(DE-FR)(de-fr)[a2]"))
    rows = tags.parse_dated(spread(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))), "name", "t")
    key = F.array_join(tags.version_key(F.col("t.version")).cast("array<string>"), "-")
    return rows.select("o_orderkey", "t.title", "t.version", "t.date", "t.publisher", F.array_join("t.regions", "|").alias("regions"), F.array_join("t.languages", "|").alias("languages"), key.alias("version_key"))


@query("""
WITH p AS (SELECT DISTINCT l_partkey AS identity, l_suppkey, least(l_linenumber, 3) AS slot, CAST(l_quantity AS INTEGER) AS version, l_orderkey * 10 + l_linenumber AS key FROM lineitem),
a AS (SELECT identity, key AS anchor, version AS av FROM p WHERE slot = 1),
f AS (SELECT a.identity, a.anchor, CAST(k AS INTEGER) AS slot, p.key, row_number() OVER (PARTITION BY a.identity, a.anchor, k ORDER BY p.version DESC NULLS LAST, p.key) AS nth
  FROM a CROSS JOIN range(1, 4) t(k) LEFT JOIN p ON p.identity = a.identity AND p.slot = k AND p.version <= a.av AND (k > 1 OR p.key = a.anchor))
SELECT identity, anchor, slot, coalesce(key, -1) AS key FROM f WHERE nth = 1
""")
def slot_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first line of a part as anchor of a set of three, filled with the newest lines not newer."""
    line = table(spark, sf_dir, "lineitem")
    none = F.array().cast("array<string>")
    parts = line.select(F.col("l_partkey").alias("identity"), F.least("l_linenumber", F.lit(3)).alias("slot"), F.lit(3).alias("total"), F.when(F.col("l_quantity").isNotNull(), F.array(F.col("l_quantity").cast("int"))).alias("version"), none.alias("flags"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))
    return slots.filled(parts).select("identity", "anchor", "slot", F.coalesce("key", F.lit(-1)).alias("key"))
