"""The driver's tables, and the catalogue and inventory views made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import saved


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all tasks before slow work on each: a file of one row group would be one task, whatever its rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their texts, with size and hashes: texts are read and hashed once, whatever a query
    makes of the table."""
    d = table(spark, sf_dir, "documents")
    return saved(d.select("doc_id", "source", "lang", F.col("n_chars").alias("size"), F.substring(F.md5("text"), 1, 8).alias("crc"), F.sha1("text").alias("sha1")), "hashes")


def catalog(hashes: DataFrame) -> DataFrame:
    """Documents as catalogue rows: a catalogue for each source, sets by language and length.
    Rows of French texts have no sha1, as some catalogues don't."""
    return hashes.select(
        F.col("source").alias("dat"),
        F.expr("cast(substring(source, 4) as int)").alias("dat_priority"),
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"),
        F.concat_ws("-", "lang", F.col("size").cast("string")).alias("set_name"),
        "size",
        "crc",
        F.when(F.col("lang") != "fr", F.col("sha1")).alias("sha1"),
    )


def inventory(hashes: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents as files that are there."""
    return hashes.join(labels.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("entry"), "size", "crc", "sha1")


def library_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Inventory and catalogue of one table of hashes."""
    hashes = hashed(spark, sf_dir)
    return inventory(hashes, table(spark, sf_dir, "labels")), catalog(hashes)


#: The same views for SQL.
CATALOG_SQL = """
catalog AS (
  SELECT source AS dat, CAST(substr(source, 4) AS INTEGER) AS dat_priority, doc_id AS ord, 'doc-' || doc_id AS name,
    lang || '-' || n_chars AS set_name, n_chars AS size, substr(md5(text), 1, 8) AS crc,
    CASE WHEN lang <> 'fr' THEN sha1(text) END AS sha1
  FROM documents
), entries AS (
  SELECT doc_id AS entry, n_chars AS size, substr(md5(text), 1, 8) AS crc, sha1(text) AS sha1
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
), by_sha1 AS (
  SELECT e.entry, c.dat, c.dat_priority, c.ord, c.name, c.set_name, 'sha1' AS via
  FROM entries e JOIN catalog c ON e.sha1 = c.sha1
), by_crc AS (
  SELECT e.entry, c.dat, c.dat_priority, c.ord, c.name, c.set_name, 'crc' AS via
  FROM entries e JOIN catalog c ON e.crc = c.crc AND e.size = c.size
  WHERE c.sha1 IS NULL AND NOT EXISTS (SELECT 1 FROM by_sha1 s WHERE s.entry = e.entry AND s.dat = c.dat)
), matches AS (
  SELECT * FROM by_sha1 UNION ALL SELECT * FROM by_crc
)"""
