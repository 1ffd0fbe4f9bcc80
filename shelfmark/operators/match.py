"""Matching files to catalogue rows by content, and what follows from it.

Entries: entry, size, crc, sha1. Catalogue: dat, dat_priority, ord, name, set_name, size, crc, sha1.
Unknown hashes are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counting_unit() -> Column:
    """What have, missing and duplicates count: the set, or the name of a row without one."""
    return F.coalesce("set_name", "name")


def loose(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """entry with every catalogue row of its content.

    By sha1 first; in a catalogue without a row of this sha1, by (crc, size) among its rows without
    sha1. The fallback is decided for each catalogue apart. Adds ``via``; ``files`` of entries stays, if it is there.
    """
    rows = catalog.withColumnsRenamed({"size": "c_size", "crc": "c_crc", "sha1": "c_sha1"})
    by_sha1 = entries.join(rows, entries.sha1 == rows.c_sha1).withColumn("via", F.lit("sha1"))
    unhashed = rows.where("c_sha1 is null")
    by_crc = entries.join(unhashed, (entries.crc == unhashed.c_crc) & (entries.size == unhashed.c_size)).withColumn("via", F.lit("crc"))
    columns = ["entry", "dat", "dat_priority", "ord", "name", "set_name", "via", *(c for c in ("files",) if c in entries.columns)]
    both = by_sha1.select(*columns).unionByName(by_crc.select(*columns))
    # both joins are made once: a file's rows of a catalogue lie together, and sha1 among them rules crc out
    surer = F.max(F.col("via") == "sha1").over(Window.partitionBy("entry", "dat"))
    return both.withColumn("_surer", surer).where((F.col("via") == "sha1") | ~F.col("_surer")).drop("_surer")


def by_content(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """The units that each distinct content matches, in the columns of ``loose``: entry is the first file of the
    content, ``files`` how many have it, ``set_name`` the unit and ord the unit's first with this content; name is null.

    What is counted follows from these rows. A content that k files and m rows share makes a row for each unit at
    most, not k x m pairs; both sides are reduced before they meet."""
    contents = entries.groupBy("size", "crc", "sha1").agg(F.min("entry").alias("entry"), F.count(F.lit(1)).alias("files"))
    units = catalog.groupBy("dat", "dat_priority", counting_unit().alias("set_name"), "size", "crc", "sha1").agg(F.min("ord").alias("ord")).withColumn("name", F.lit(None).cast("string"))
    return loose(contents, units)


def _weight(matches: DataFrame) -> Column:
    return F.col("files") if "files" in matches.columns else F.lit(1)


def member(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Archive members match by (crc, size) alone."""
    return entries.where("crc is not null").join(catalog.drop("sha1"), ["crc", "size"]).select("entry", "dat", "dat_priority", "ord", "name", "set_name")


def first_variant(variants: DataFrame, catalog: DataFrame) -> DataFrame:
    """The rows of the first variant, by ``nth``, of each entry that matches by sha1 and size."""
    hits = variants.join(catalog.drop("crc"), ["sha1", "size"])
    first = F.min("nth").over(Window.partitionBy("entry"))
    return hits.withColumn("first", first).where("nth = first").select("entry", "variant", "dat", "name")


def primary(matches: DataFrame) -> DataFrame:
    """The rows of the catalogue of highest priority (lowest number) of each entry."""
    best = F.min("dat_priority").over(Window.partitionBy("entry"))
    return matches.withColumn("best", best).where("dat_priority = best").drop("best")


def covered(matches: DataFrame) -> DataFrame:
    return matches.select("dat", counting_unit().alias("unit")).distinct()


def first_of_unit(catalog: DataFrame) -> DataFrame:
    """One row for each counting unit: its first in catalogue order."""
    order = Window.partitionBy("dat", "unit").orderBy("ord")
    return catalog.withColumn("unit", counting_unit()).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def missing(catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """First rows of the units of which there is no file."""
    return first_of_unit(catalog).join(covered(matches), ["dat", "unit"], "left_anti")


def game_status(catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """Each set with its number of rows and of files, and whether there is any."""
    sets = catalog.withColumn("unit", counting_unit()).groupBy("dat", "unit").agg(F.count(F.lit(1)).alias("roms"), F.min("ord").alias("ord"))
    files = matches.select("dat", counting_unit().alias("unit"), "entry", _weight(matches).alias("files")).distinct().groupBy("dat", "unit").agg(F.sum("files").alias("files"))
    joined = sets.join(files, ["dat", "unit"], "left")
    return joined.select("dat", "unit", "ord", "roms", F.coalesce("files", F.lit(0)).cast("bigint").alias("files"), F.col("files").isNotNull().alias("have"))


def per_dat(catalog: DataFrame, matches: DataFrame) -> DataFrame:
    """total, have, missing units and matched files of each catalogue; those without a match stay."""
    total = catalog.groupBy("dat").agg(F.count_distinct(counting_unit()).alias("total"))
    have = covered(matches).groupBy("dat").agg(F.count(F.lit(1)).alias("have"))
    files = matches.select("dat", "entry", _weight(matches).alias("files")).distinct().groupBy("dat").agg(F.sum("files").alias("files"))
    joined = total.join(have, "dat", "left").join(files, "dat", "left").select("dat", "total", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("files", F.lit(0)).alias("files"))
    return joined.withColumn("missing", F.col("total") - F.col("have"))


def repeated_entries(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Entries that match and add no unit that an earlier entry (by number) hasn't brought, in their first catalogue.

    The entries that bring a unit are the first ones of units; all other files of matched contents are repeated."""
    found = by_content(entries, catalog)
    bring = primary(found).groupBy("dat", counting_unit().alias("unit")).agg(F.min("entry").alias("entry")).select("entry").distinct()
    contents = entries.join(found.select("entry").distinct(), "entry", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in ("size", "crc", "sha1")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("size", "crc", "sha1")]
    return entries.join(contents, same, "left_semi").select("entry").join(bring, "entry", "left_anti")


def duplicates(rows: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """Groups of more than one row: ``keeper`` is true for the first by rank; adds group_size."""
    group = Window.partitionBy(*keys)
    ranked = rows.withColumn("group_size", F.count(F.lit(1)).over(group)).where("group_size > 1")
    return ranked.withColumn("keeper", F.row_number().over(group.orderBy(*rank)) == 1)


def by_size_tuple(units: DataFrame, games: DataFrame) -> DataFrame:
    """Units and games, both (key, sizes array), whose ordered sizes are the same."""
    return units.withColumnRenamed("key", "unit").join(games.withColumnRenamed("key", "game"), "sizes")
