"""Discs by their tracks: which game a unit is, how surely, and what follows for games and counters.

Units and games: unit or game, tracks array<struct<number, size, hash>>; a hash is of one kind on both sides, null
if unknown. Levels, the best first: verified, identified, ambiguous, unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels, the best first.
LEVELS = ["verified", "identified", "ambiguous", "unknown"]


def track_ok(size: Column, hash_: Column, rom_size: Column, rom_hash: Column) -> Column:
    """Whether a track is a rom: equal sizes, and equal hashes, both known."""
    return (size == rom_size) & F.coalesce(hash_ == rom_hash, F.lit(False))


def _ordered(df: DataFrame) -> DataFrame:
    """Adds sizes and hashes of the tracks by number; hashes are null if one is unknown or there are no tracks."""
    rows = df.withColumn("tracks", F.array_sort(F.transform("tracks", lambda t: F.struct(t["number"].alias("number"), t["size"].alias("size"), t["hash"].alias("hash")))))
    known = (F.size("tracks") > 0) & F.forall("tracks", lambda t: t["hash"].isNotNull())
    return rows.withColumn("sizes", F.transform("tracks", lambda t: t["size"])).withColumn("hashes", F.when(known, F.transform("tracks", lambda t: t["hash"])))


def identified(units: DataFrame, games: DataFrame) -> DataFrame:
    """unit, game, level, candidates. Verified units have the sizes and hashes of a game (of several equal ones the
    first); the sizes of one game alone identify it, those of several leave it open, with their number as candidates.

    Games are grouped by sizes, and by sizes and hashes, before the joins, so sizes that very many games and units
    share make no pairs."""
    known = _ordered(games)
    by_sizes = known.groupBy("sizes").agg(F.count(F.lit(1)).alias("n"), F.min("game").alias("one"))
    by_hashes = known.where("hashes is not null").groupBy("sizes", "hashes").agg(F.min("game").alias("same"))
    rows = _ordered(units).join(by_sizes, "sizes", "left").join(by_hashes, ["sizes", "hashes"], "left")
    level = F.when(F.col("same").isNotNull(), LEVELS[0]).when(F.col("n") == 1, LEVELS[1]).when(F.col("n") > 1, LEVELS[2]).otherwise(LEVELS[3])
    return rows.select("unit", F.coalesce("same", F.when(F.col("n") == 1, F.col("one"))).alias("game"), level.alias("level"), F.coalesce("n", F.lit(0)).alias("candidates"))


def game_levels(found: DataFrame) -> DataFrame:
    """game, level (the best of its units), units."""
    rank = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    best = found.where("game is not null").groupBy("game").agg(F.min(rank).alias("r"), F.count(F.lit(1)).alias("units"))
    return best.select("game", F.get(F.array(*map(F.lit, LEVELS)), (F.col("r") - 1).cast("int")).alias("level"), "units")


def level_counts(found: DataFrame) -> DataFrame:
    """level, units of all levels, with zeros."""
    counts = found.agg(*[F.count_if(F.col("level") == x).alias(x) for x in LEVELS])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("units")) for x in LEVELS])))


def system_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """filename, status, source of system files ``wanted(filename, md5)`` (several md5 of a name are variants)
    among ``files(path, name, md5)``: ok if a file of the name is one of them; copy from the first path of one that is
    elsewhere; wrong if the name is there with other content; else missing."""
    # of files of one name and content the first path is all that counts, however many share a content
    first = files.groupBy("md5", F.lower("name").alias("_name")).agg(F.min("path").alias("path"))
    here = F.col("_name") == F.lower("filename")
    found = wanted.distinct().join(first, "md5").groupBy("filename").agg(F.min(F.when(here, F.col("path"))).alias("own"), F.min(F.when(~here, F.col("path"))).alias("elsewhere"))
    paths = files.groupBy(F.lower("name").alias("_n")).agg(F.min("path").alias("other"))
    named = wanted.select("filename").distinct().join(paths, F.lower("filename") == F.col("_n")).select("filename", "other")
    rows = wanted.select("filename").distinct().join(found, "filename", "left").join(named, "filename", "left")
    status = F.when(F.col("own").isNotNull(), "ok").when(F.col("elsewhere").isNotNull(), "copy").when(F.col("other").isNotNull(), "wrong").otherwise("missing")
    return rows.select("filename", status.alias("status"), F.coalesce("own", "elsewhere").alias("source"))
