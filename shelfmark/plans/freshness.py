"""Queries of catalogue freshness: names, files at hand and answers are built from columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import freshness
from shelfmark.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH p AS (SELECT p_partkey, p_size,
  CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_partkey % 4 <> 0 THEN p_brand END END AS installed, p_size % 5 <> 0 AS there,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size % 4 AS VARCHAR) END AS stored, CASE WHEN p_partkey % 9 <> 1 THEN CAST(p_partkey % 4 AS VARCHAR) END AS tag,
  p_partkey % 11 = 0 AS refused, p_partkey % 13 = 0 AS broken, p_partkey % 17 <> 0 AS asked FROM part)
SELECT p_partkey AS dat, installed, CASE WHEN asked AND (refused OR broken) THEN 'error' WHEN NOT asked THEN 'unknown' WHEN NOT there THEN 'missing'
    WHEN stored IS NULL OR tag IS NULL THEN 'unknown' WHEN stored = tag THEN 'up_to_date' ELSE 'update_available' END AS status,
  CASE WHEN asked AND broken THEN 'no route' WHEN asked AND refused THEN 'HTTP 404' END AS error FROM p
""")
def freshness_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a catalogue; tags are written in their strong and weak forms."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").withColumn("dat", F.col("p_partkey"))
    local = p.where("p_size % 5 <> 0").select("dat", F.expr("if(p_partkey % 4 = 0, ' ', p_brand)").alias("version"))
    manifest = p.where("p_partkey % 3 <> 0").select("dat", F.expr("concat(if(p_size % 2 = 0, 'W/', ''), '\"', p_size % 4, '\"')").alias("etag"))
    remote = p.where("p_partkey % 17 <> 0").select("dat", F.expr("if(p_partkey % 13 = 0, null, if(p_partkey % 11 = 0, 404, 200))").alias("status"), F.expr("if(p_partkey % 13 = 0, 'no route', '')").alias("error"), F.expr("if(p_partkey % 9 = 1, null, concat(' W/\"', p_partkey % 4, '\" '))").alias("etag"))
    return freshness.by_tag(p, local, manifest, remote)


@query("""
WITH c AS (SELECT c_custkey, '20' || (10 + c_nationkey) || '-01-02 03-04-' || (10 + c_custkey % 40) AS told, '20' || (10 + c_custkey % 25) || '-01-02 03-04-50' AS mine,
  c_custkey % 6 <> 0 AS there, c_custkey % 7 <> 0 AS dated, c_custkey % 19 = 0 AS refused, c_custkey % 5 <> 0 AS named FROM customer)
SELECT c_custkey AS dat, CASE WHEN there AND dated THEN mine END AS installed, CASE WHEN named AND NOT refused THEN told END AS latest,
  CASE WHEN refused THEN 'error' WHEN NOT there THEN 'missing' WHEN NOT named THEN 'unknown' WHEN dated AND mine >= told THEN 'up_to_date' ELSE 'update_available' END AS status,
  CASE WHEN refused THEN 'HTTP 503' END AS error FROM c
""")
def freshness_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a catalogue whose version stands in the name of the file that is offered."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name").withColumn("dat", F.col("c_custkey"))
    local = c.where("c_custkey % 6 <> 0").select("dat", F.expr("if(c_custkey % 7 = 0, null, concat('20', 10 + c_custkey % 25, '-01-02 03-04-50'))").alias("version"))
    told = "concat('20', 10 + c_nationkey, '-01-02 03-04-', 10 + c_custkey % 40)"
    disposition = F.expr(f"case when c_custkey % 5 = 0 then 'attachment; filename=plain.zip' when c_custkey % 2 = 0 then concat('attachment; FileName*=UTF-8''''', c_name, ' (7) (', {told}, ').zip') else concat('attachment; filename=\"', c_name, ' (1999-01-01 00-00-00) (', {told}, ').zip\"; size=7') end")
    remote = c.select("dat", F.expr("if(c_custkey % 19 = 0, 503, 200)").alias("status"), F.lit(None).cast("string").alias("error"), disposition.alias("disposition"))
    return freshness.by_version(c, local, remote)


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_custkey % 5 AS INTEGER) AS l, o_orderkey % 8 <> 0 AND o_custkey % 10 <> 1 AS there,
  o_orderkey % 9 = 0 AS refused, o_orderkey % 3 = 0 AS undated, o_orderkey % 4 = o_custkey % 4 AS same_tag, o_orderkey % 10 = 0 AS broken FROM orders),
a AS (SELECT *, CASE WHEN there AND NOT broken THEN CAST(DATE '1998-08-02' - d AS DOUBLE) - 0.5 END AS age FROM o),
y AS (SELECT *, coalesce(age < 100, false) AS young FROM a)
SELECT o_orderkey AS dat, CASE WHEN there THEN CASE WHEN NOT undated THEN strftime(d, '%Y-%m-%d') WHEN broken THEN 'never' ELSE strftime(d, '%Y-%m-%d') END END AS installed, age AS age_days,
  CASE WHEN NOT young AND NOT refused THEN strftime(l, '%a, %d %b %Y') || ' 00:00:00 GMT' END AS latest,
  CASE WHEN young THEN 'up_to_date' WHEN refused THEN 'error' WHEN NOT there THEN 'missing' WHEN CASE WHEN undated THEN true ELSE l > d END THEN 'update_available' ELSE 'up_to_date' END AS status,
  CASE WHEN NOT young AND refused THEN 'HTTP 500' END AS error FROM y
""")
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an index: built at noon of its day from data of that day; those of another schema aren't usable."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d")).withColumn("dat", F.col("o_orderkey"))
    header = lambda day: F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 00:00:00 GMT"))
    manifests = o.select(
        "dat",
        F.when(F.col("o_custkey") % 10 == 1, 2).otherwise(1).alias("schema"),
        F.when(F.col("o_orderkey") % 10 == 0, "never").otherwise(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit("T12:00:00+00:00"))).alias("built_at"),
        F.expr("concat('\"', o_orderkey % 4, '\"')").alias("etag"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(header(F.col("d"))).alias("last_modified"),
    )
    remote = o.select("dat", F.expr("if(o_orderkey % 9 = 0, 500, 200)").alias("status"), F.lit(None).cast("string").alias("error"), F.expr("concat('\"', o_custkey % 4, '\"')").alias("etag"), header(F.expr("date_add(d, cast(o_custkey % 5 as int))")).alias("last_modified"))
    here = freshness.usable(manifests, o.where("o_orderkey % 8 <> 0"), 1)
    return freshness.index_states(o, here, remote, 902016000, 100)


@query("""
WITH f AS (SELECT DISTINCT p_brand AS dat FROM part WHERE p_size % 10 <> 0 AND p_brand NOT LIKE '%3'),
e AS (SELECT o_custkey AS platform, p_brand AS dat, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, p_brand) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
g AS (SELECT platform, dat, min(place) AS place FROM e GROUP BY platform, dat)
SELECT platform, dat, CAST(row_number() OVER (PARTITION BY platform ORDER BY place) - 1 AS INTEGER) AS priority, CASE WHEN f.dat IS NOT NULL THEN '/c/' || dat || '.dat' END AS path, f.dat IS NULL AS missing FROM g LEFT JOIN f USING (dat)
""")
def platform_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as a platform whose catalogues are the brands of its orders, the first bought first."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    bought = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lists = bought.groupBy(F.col("o_custkey").alias("platform")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "p_brand"))).alias("rows"))
    listing = part.where("p_size % 10 <> 0 and p_brand not like '%3'").select(F.col("p_brand").alias("dat")).distinct().withColumn("path", F.concat(F.lit("/c/"), "dat", F.lit(".dat")))
    return freshness.in_order(lists.select("platform", F.col("rows.p_brand").alias("dats")), listing)
