"""Playlists that no longer hold: their disks are gone or move, or another playlist has the same disks.

Two playlists are the same if their sets of disks are, in whatever order: each set becomes one fingerprint, and equal
fingerprints are joined; no playlist is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.files import playlist_lines


def normal(path: Column) -> Column:
    """A path without empty parts, . and .. (leading .. stay)."""
    parts = F.split(path, "/")

    def step(acc: Column, part: Column) -> Column:
        inside = F.coalesce(F.get(acc, F.size(acc) - 1) != "..", F.lit(False))
        return F.when(part.isin("", "."), acc).when((part == "..") & inside, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(part)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(folded, "/"))


def entries(texts: DataFrame) -> DataFrame:
    """path, own and entry (letters folded, from the root) of the disks that playlists of ``texts(path, text)`` name."""
    folder = F.regexp_extract("path", "^(.*/)[^/]*$", 1)
    absolute = F.startswith("entry", F.lit("/"))
    return playlist_lines(texts).select("path", "own", F.lower(normal(F.when(absolute, F.col("entry")).otherwise(F.concat(folder, F.col("entry"))))).alias("entry"))


def _fingerprints(rows: DataFrame) -> DataFrame:
    """path and set of each playlist: a digest of its disks, each once, in one order."""
    return rows.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("entry")), "\n"), 256).alias("set"))


def stale(there: DataFrame, planned: DataFrame, files: DataFrame) -> DataFrame:
    """path, status and reason of playlists ``there(path, text)`` that no longer hold, or need their owner.

    ``planned(path, content)`` are the playlists to be written or left as they are; those there under a planned path are
    not judged. ``files(path, moving)`` are the files that are there. Own playlists with a disk that isn't there or
    moves are stale, and those with the disks of a planned one; others whose disks move are told of (skip)."""
    old = there.join(planned.select(F.lower("path").alias("_path")).distinct(), F.lower("path") == F.col("_path"), "left_anti")
    rows = entries(old)
    known = files.groupBy(F.lower("path").alias("entry")).agg(F.max("moving").alias("moving"))
    counts = rows.join(known, "entry", "left").groupBy("path", "own").agg(F.count_if(F.col("moving").isNull() | F.col("moving")).alias("gone"), F.count_if(F.coalesce("moving", F.lit(False))).alias("moves"))
    twins = _fingerprints(entries(planned.select("path", F.col("content").alias("text")))).groupBy("set").agg(F.min("path").alias("twin"))
    same = _fingerprints(rows).join(twins, "set").select("path", "twin")
    judged = counts.join(same, "path", "left")
    status = F.when(F.col("own") & ((F.col("gone") > 0) | F.col("twin").isNotNull()), "stale").when(~F.col("own") & (F.col("moves") > 0), "skip")
    reason = F.when(F.col("own") & (F.col("gone") > 0), F.concat(F.col("gone").cast("string"), F.lit(" of its disks are gone or move"))).when(F.col("own"), F.concat(F.lit("replaced by "), "twin")).otherwise(F.concat(F.col("moves").cast("string"), F.lit(" of its disks move")))
    return judged.withColumns({"status": status, "reason": reason}).where("status is not null").select("path", "status", "reason")
