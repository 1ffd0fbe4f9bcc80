"""Catalogues at hand: the newest of each name, those of a platform, lookups, counters over catalogue and matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.catalogs import newest_files


def listed(paths: DataFrame) -> DataFrame:
    """dat, version, path: the newest .dat file of each catalogue among ``paths(path)``."""
    return newest_files(paths.where(F.lower("path").endswith(".dat")))


def find(listing: DataFrame, name: str) -> DataFrame:
    """The catalogue of exactly this name."""
    return listing.where(F.col("dat") == name)


def located(platforms: DataFrame, listing: DataFrame) -> DataFrame:
    """``platforms(platform, dat, priority)`` with the file of each catalogue that is there."""
    return platforms.join(listing, "dat").select("platform", "dat", "priority", "version", "path")


def status(platforms: DataFrame, listing: DataFrame) -> DataFrame:
    """The same with all catalogues: version and path are null for those that aren't there; adds present."""
    return platforms.join(listing, "dat", "left").select("platform", "dat", "priority", "version", "path", F.col("path").isNotNull().alias("present"))


def platform_summary(platforms: DataFrame, listing: DataFrame) -> DataFrame:
    """platform, wanted, present, newest version of each platform's catalogues."""
    return status(platforms, listing).groupBy("platform").agg(F.count(F.lit(1)).alias("wanted"), F.count_if("present").alias("present"), F.max("version").alias("newest"))


def updates(listing: DataFrame, remote: DataFrame) -> DataFrame:
    """dat, have, latest, state of ``remote(dat, version)``: new, current or missing; catalogues without a remote
    version are left out."""
    have = listing.select("dat", F.col("version").alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("have") < F.col("version"), "new").otherwise("current")
    return remote.join(have, "dat", "left").select("dat", "have", F.col("version").alias("latest"), state.alias("state"))


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """value, n of a column; null counts as empty."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def member_counts(matches: DataFrame) -> DataFrame:
    """path, members of archives among ``matches(path, member)``."""
    return matches.where("member is not null").groupBy("path").agg(F.count_distinct("member").alias("members"))


def naming_counts(rows: DataFrame, named: Column, placed: Column) -> DataFrame:
    """files, named, placed of all rows: how many have their name, and how many are in their place."""
    return rows.agg(F.count(F.lit(1)).alias("files"), F.count_if(named).alias("named"), F.count_if(placed).alias("placed"))


def bad_dumps(primary: DataFrame) -> DataFrame:
    """Rows of ``primary(entry, ord, bad)`` whose first catalogue row is a bad dump."""
    first = Window.partitionBy("entry").orderBy("ord")
    return primary.withColumn("_nth", F.row_number().over(first)).where("_nth = 1 and bad").drop("_nth")
