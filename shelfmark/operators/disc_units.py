"""Units of disc images in a folder: what belongs to one image or sheet, by folders and by names that begin alike.

A folder with one image is a unit with all below it; in folders of several, a file belongs to the image with the longest
name that its own begins with. Both are longest-prefix joins: the prefixes of a path or name are listed and joined by
equality, and the longest (or, of folders with sheets, the outermost) that is met counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import places
from shelfmark.sources.work import saved

# Extensions of images and of sheets, the preferred first.
IMAGE = ".chd"
SHEETS = [".gdi", ".cue", ".iso"]


def _placed(files: DataFrame) -> DataFrame:
    """path, dir (empty at the top), name, stem, ext, of each path once, and ``above``: its folders from the top down."""
    rows = files.select("path").distinct()
    rows = rows.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    stem, ext = places.split_extension(F.col("name"))
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.select("path", "dir", "name", stem.alias("stem"), F.lower(ext).alias("ext"), above.alias("above"))


def _is_container(dir_: Column) -> Column:
    """The top, or a reserved folder there: never the folder of one game."""
    return (dir_ == "") | F.lower(dir_).isin(*places.RESERVED)


def _by_stem(files: DataFrame, mains: DataFrame) -> DataFrame:
    """path and unit of files whose name begins with the stem of a main file of their folder, the longest one; main
    files (unit, dir, stem) belong to themselves."""
    lengths = mains.groupBy("dir").agg(F.collect_set(F.char_length("stem")).alias("lengths"))
    cut = files.join(lengths, "dir").select("path", "dir", F.explode(F.filter("lengths", lambda n: n <= F.char_length("name"))).alias("n"), "name")
    cut = cut.withColumn("stem", F.left("name", F.col("n")))
    found = cut.join(mains.select("dir", "stem", "unit"), ["dir", "stem"]).groupBy("path").agg(F.max_by("unit", F.struct("n", "unit")).alias("unit"))
    others = found.join(mains.select(F.col("unit").alias("path")), "path", "left_anti")
    return others.select("path", "unit").union(mains.select(F.col("unit").alias("path"), "unit"))


def discovered(files: DataFrame, tracks: DataFrame | None = None, sheets: list[str] = SHEETS) -> DataFrame:  # noqa: B006
    """unit (its main file), kind (image or sheet), folder (null where the unit is no folder), path of each file of each unit.

    ``files(path)`` are relative to the root; ``tracks(sheet, path)`` the files that sheets name, which belong to the sheet of a
    folder with several wherever they are. Folders inside of a unit's folder that have images of their own are not
    part of it; of nested folders with sheets the outermost is the unit. Files of no unit are left out.
    """
    rows = saved(_placed(files), "placed-files")
    images = rows.where(F.col("ext") == IMAGE).select("dir", "stem", F.col("path").alias("unit"))
    dirs = images.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit")).select(F.col("dir").alias("at"), ((F.col("n") == 1) & ~_is_container(F.col("dir"))).alias("whole"), "unit")
    ancestors = rows.select("path", F.posexplode("above").alias("depth", "at"))
    # the nearest folder above (or its own) that has images
    nearest = ancestors.join(dirs, "at").groupBy("path").agg(F.max_by(F.struct("depth", "at", "whole", "unit"), "depth").alias("i"))
    known = saved(rows.join(nearest, "path", "left"), "files-by-image")
    of_folder = known.where("i.whole").select("path", F.col("i.unit").alias("unit"), F.col("i.at").alias("folder"))
    several = dirs.where("not whole").select(F.col("at").alias("dir"))
    of_stem = _by_stem(known.where(F.col("ext") != IMAGE).where("i.at = dir and not i.whole"), images.join(several, "dir"))
    with_images = of_folder.unionByName(of_stem.select("path", "unit", F.lit(None).cast("string").alias("folder")))

    open_ = saved(known.join(with_images.select("path").distinct(), "path", "left_anti"), "files-of-no-image")
    order = F.array_position(F.array(*map(F.lit, sheets)), F.col("ext"))
    listed = open_.where(F.col("ext").isin(*sheets) & (F.col("i").isNull() | (F.col("i.at") != F.col("dir")))).withColumn("kind", order)
    listed = listed.withColumn("best", F.min("kind").over(Window.partitionBy("dir"))).where("kind = best").select("dir", "stem", F.col("path").alias("unit"))
    sheet_dirs = listed.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("unit")).select(F.col("dir").alias("at"), ((F.col("n") == 1) & ~_is_container(F.col("dir"))).alias("whole"), "unit")
    # the outermost folder with one sheet, below the nearest one with images
    below = open_.select("path", F.coalesce("i.depth", F.lit(-1)).alias("least"), F.posexplode("above").alias("depth", "at")).where("depth > least")
    outer = below.join(sheet_dirs.where("whole"), "at").groupBy("path").agg(F.min_by(F.struct("at", "unit"), "depth").alias("s"))
    of_sheet_folder = outer.select("path", F.col("s.unit").alias("unit"), F.col("s.at").alias("folder"))
    mains = listed.join(sheet_dirs.where("not whole").select(F.col("at").alias("dir")), "dir").join(of_sheet_folder.select(F.col("path").alias("unit")), "unit", "left_anti")
    free = open_.join(of_sheet_folder.select("path"), "path", "left_anti")
    of_sheet = _by_stem(free.where(F.col("ext") != IMAGE), mains)
    if tracks is not None:
        named = tracks.select(F.col("sheet").alias("unit"), "path").join(mains.select("unit"), "unit", "left_semi").join(rows.select("path"), "path", "left_semi")
        of_sheet = of_sheet.select("path", "unit").union(named.select("path", "unit")).distinct()
    with_sheets = of_sheet_folder.unionByName(of_sheet.select("path", "unit", F.lit(None).cast("string").alias("folder")))
    return with_images.withColumn("kind", F.lit("image")).unionByName(with_sheets.withColumn("kind", F.lit("sheet"))).select("unit", "kind", "folder", "path")


def unclaimed(files: DataFrame, units: DataFrame) -> DataFrame:
    return files.select("path").distinct().join(units.select("path"), "path", "left_anti")
