"""Queries of the selection family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import select, sets
from shelfmark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey, o_custkey, newest FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS newest FROM orders) WHERE o_orderdate < newest")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.older(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey", "newest")


@query("""
SELECT p_name, p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY
  CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 WHEN 'Brand#33' THEN 3 ELSE 4 END, p_size DESC, p_retailprice, p_partkey) AS nth FROM part) WHERE nth = 1
""")
def one_per_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [select.preferred(F.col("p_brand"), ["Brand#11", "Brand#22", "Brand#33"]).asc(), F.desc("p_size"), F.asc("p_retailprice"), F.asc("p_partkey")]
    return select.best_of(table(spark, sf_dir, "part"), ["p_name"], order).select("p_name", "p_brand", "p_partkey", "p_retailprice")


@query("""
SELECT p_name, p_brand, p_partkey FROM (SELECT *, first_value(p_brand) OVER (PARTITION BY p_name ORDER BY p_size DESC, p_retailprice, p_partkey) AS w FROM part) WHERE p_brand = w
""")
def winner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts of a name with the brand of its best one: equals of the winner stay."""
    return select.winners(table(spark, sf_dir, "part"), ["p_name"], [F.desc("p_size"), F.asc("p_retailprice"), F.asc("p_partkey")], "p_brand").select("p_name", "p_brand", "p_partkey")


@query("""
SELECT n_name, s_suppkey, s_name, s_acctbal FROM (SELECT n_name, s.*, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal < 0, s_acctbal DESC, s_suppkey) AS nth
  FROM supplier s JOIN nation ON s_nationkey = n_nationkey) WHERE nth = 1
""")
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    order = [(F.col("s_acctbal") < 0).asc(), F.desc("s_acctbal"), F.asc("s_suppkey")]
    return select.best_of(rows, ["s_nationkey"], order).select("n_name", "s_suppkey", "s_name", "s_acctbal")


@query("""
SELECT o_custkey, o_orderpriority, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS nth FROM orders) WHERE nth = 1
""")
def latest_per_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_of(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate")


@query("""
WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS lines, max(l_shipdate) AS newest FROM lineitem GROUP BY ALL),
b AS (SELECT l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY lines DESC, newest DESC, l_suppkey) AS nth FROM s) WHERE nth = 1)
SELECT l_partkey, l_suppkey, count(*) AS lines, max(l_shipdate) AS newest FROM lineitem JOIN b USING (l_partkey, l_suppkey) GROUP BY ALL
""")
def edition_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier with most lines of each part, with its lines: a pick over an aggregate."""
    editions = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("lines"), F.max("l_shipdate").alias("newest"))
    return select.best_of(editions, ["l_partkey"], [F.desc("lines"), F.desc("newest"), F.asc("l_suppkey")])


@query("SELECT p_partkey, p_name, p_retailprice FROM (SELECT *, rank() OVER (ORDER BY p_retailprice DESC, p_name) AS r FROM part) WHERE r <= 25")
def top_n_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return select.top_with_ties(part, 25, [-F.col("p_retailprice"), F.col("p_name")]).select("p_partkey", "p_name", "p_retailprice")


@query("""
WITH c AS (SELECT min(p_retailprice) AS cut FROM (SELECT p_retailprice FROM part ORDER BY p_retailprice DESC LIMIT 100))
SELECT p_partkey, p_retailprice FROM part, c WHERE p_retailprice >= cut AND p_size <= 25
""")
def top_n_cutoff_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cutoff is of the whole table, the rows are of a part of it."""
    return select.top_with_ties(table(spark, sf_dir, "part"), 100, [-F.col("p_retailprice")]).where("p_size <= 25").select("p_partkey", "p_retailprice")


@query("SELECT CAST(k AS INTEGER) AS step, k / 2.0 AS threshold, count(p_partkey) AS games FROM range(1, 21) t(k) LEFT JOIN part ON p_size / 5.0 >= k / 2.0 GROUP BY k")
def rating_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "part").select((F.col("p_size") / 5.0).alias("rating"))
    return select.coverage(rated, "rating").select("step", F.col("threshold").cast("double").alias("threshold"), "games")


@query("""
WITH n AS (SELECT p_name AS key, 0 AS alt, p_size AS votes, p_partkey AS id FROM part UNION ALL SELECT p_type, 1, p_size, p_partkey FROM part)
SELECT key, alt, votes, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY alt, votes DESC, id) AS nth FROM n) WHERE nth = 1
""")
def build_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own names before alternate ones, then most votes, then the lowest id."""
    part = table(spark, sf_dir, "part")
    names = F.inline(F.array(F.struct(F.col("p_name").alias("key"), F.lit(0).alias("alt")), F.struct(F.col("p_type").alias("key"), F.lit(1).alias("alt"))))
    rows = part.select(names, F.col("p_size").alias("votes"), F.col("p_partkey").alias("id"))
    return select.best_of(rows, ["key"], [F.asc("alt"), F.desc("votes"), F.asc("id")])


RULES_SQL = """
ruled AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, list_filter([
    CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN d.n_chars < 500 THEN 'short' END,
    CASE WHEN d.lang NOT IN ('en', 'de') THEN 'language' END], lambda x: x IS NOT NULL) AS codes
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rules = {"toxic": F.col("toxic") == 1, "quality": F.col("quality") == 1, "short": F.col("n_chars") < 500, "language": ~F.col("lang").isin("en", "de")}
    return rows.withColumn("codes", select.codes(rules))


@query(f"WITH {RULES_SQL} SELECT doc_id, array_to_string(codes, ',') AS codes, len(codes) = 0 AS eligible FROM ruled")
def eligibility_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ruled(spark, sf_dir).select("doc_id", F.array_join("codes", ",").alias("codes"), (F.size("codes") == 0).alias("eligible"))


@query(f'WITH {RULES_SQL}, e AS (SELECT codes[1] AS f, unnest(codes) AS code FROM ruled) SELECT code, count(*) FILTER (WHERE f = code) AS "first", count(*) AS "any" FROM e GROUP BY code')
def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.exclusion_counts(_ruled(spark, sf_dir))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus <> 'O' AS excluded FROM orders)
SELECT o_orderkey, o_custkey FROM r WHERE excluded AND o_custkey NOT IN (SELECT o_custkey FROM r WHERE NOT excluded)
""")
def rescue_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") != "O").alias("excluded"))
    return select.rescue(rows, ["o_custkey"], "excluded").select("o_orderkey", "o_custkey")


@query(f"""
WITH {RULES_SQL} SELECT r.doc_id, CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'exclude' WHEN l.doc_id IS NOT NULL AND l.quality = 0 THEN 'keep'
  WHEN len(r.codes) = 0 THEN 'keep' ELSE 'exclude' END AS action, l.doc_id IS NOT NULL AND (l.toxic = 1 OR l.quality = 0) AS forced
FROM ruled r LEFT JOIN labels l USING (doc_id)
""")
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    forced = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select("doc_id", F.when(F.col("toxic") == 1, "exclude").otherwise("keep").alias("action"))
    rows = _ruled(spark, sf_dir).select("doc_id", F.when(F.size("codes") == 0, "keep").otherwise("exclude").alias("action"))
    return select.with_overrides(rows, forced, "doc_id").select("doc_id", "action", "forced")


@query(f"""
WITH {RULES_SQL}, t AS (SELECT *, source || '/' || lang || '/' || (n_chars // 1000) AS title FROM ruled),
m AS (SELECT *, min(len(codes)) OVER (PARTITION BY title) AS least FROM t),
p AS (SELECT title, least, count(*) OVER (PARTITION BY title) AS variants, list_min(list_transform(codes, lambda c: list_position(['toxic', 'quality', 'short', 'language'], c))) AS best
  FROM m QUALIFY len(codes) = least)
SELECT title, max(n) AS variants, ['toxic', 'quality', 'short', 'language'][min(best)] AS reason
FROM p JOIN (SELECT title, count(*) AS n FROM t GROUP BY title) USING (title) WHERE least > 0 GROUP BY title
""")
def vanished(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ruled(spark, sf_dir).withColumn("title", F.concat_ws("/", "source", "lang", F.expr("cast(n_chars div 1000 as string)")))
    return select.vanished(rows, ["title"], ["toxic", "quality", "short", "language"])


@query("SELECT lang, count(*) AS releases, count(DISTINCT source) AS titles FROM documents GROUP BY lang")
def available_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("releases"), F.count_distinct("source").alias("titles"))
    return d.orderBy(F.col("lang") != "en", "lang")


SETS_SQL = "SELECT l_orderkey, max(l_linenumber) AS total, count(DISTINCT l_linenumber) AS present FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT l_orderkey, total, CAST(present AS INTEGER) AS present, total = present AS complete FROM ({SETS_SQL})")
def set_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sets.completeness(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")
    return rows.select("l_orderkey", "total", F.size("present").alias("present"), "complete")


@query(f"""
SELECT s.l_orderkey, CAST(k AS INTEGER) AS slot FROM ({SETS_SQL}) s, range(1, 8) t(k)
WHERE k <= total AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.l_orderkey AND l.l_linenumber = k)
""")
def missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.missing_slots(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT conv_id, max(turn) + 1 AS total, count(DISTINCT turn) AS present FROM conversations GROUP BY conv_id")
def conversation_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("slot"))
    return sets.completeness(parts, ["conv_id"], "slot").select("conv_id", "total", F.size("present").cast("bigint").alias("present"))


@query("""
SELECT event_id, user_id, coalesce(donor, -1) AS donor, donor_value FROM (SELECT p.event_id, p.user_id, v.event_id AS donor, v.value AS donor_value,
  row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS nth
  FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase') WHERE nth = 1
""")
def asof_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the newest view of its user that isn't newer."""
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("donor"), F.col("value").alias("donor_value"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return sets.as_of(bought, views, "user_id", "ts", ["donor", "donor_value"], "donor").select("event_id", "user_id", F.coalesce("donor", F.lit(-1)).alias("donor"), "donor_value")


@query("""
SELECT user_id, event_id, tier FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS tier,
  row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts DESC, event_id) AS nth FROM events) WHERE nth = 1
""")
def tiered_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return sets.tiered(table(spark, sf_dir, "events"), ["user_id"], tier, F.col("ts"), F.col("event_id").asc()).select("user_id", "event_id", "tier")


@query("""
WITH k AS (SELECT DISTINCT p_type, string_split(p_type, ' ') AS flags FROM part), n AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS flags FROM part)
SELECT a.p_name AS anchor, b.p_name AS other FROM n a JOIN n b ON a.flags[1] = b.flags[1] AND len(list_filter(a.flags, lambda x: NOT list_contains(b.flags, x))) = 0
""")
def flag_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose words are all in another name that begins with the same word."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("flags", F.split("p_name", " ")).withColumn("head", F.col("flags")[0])
    a, b = names.alias("a"), names.alias("b")
    both = a.join(b, (F.col("a.head") == F.col("b.head")) & sets.fits(F.col("a.flags"), F.col("b.flags")))
    return both.select(F.col("a.p_name").alias("anchor"), F.col("b.p_name").alias("other"))


@query("SELECT l_orderkey, CASE WHEN max(l_linenumber) > 1 THEN max(l_linenumber) ELSE 0 END AS discs FROM lineitem GROUP BY l_orderkey")
def disc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("most"))
    return most.select("l_orderkey", F.when(F.col("most") > 1, F.col("most")).otherwise(0).alias("discs"))
