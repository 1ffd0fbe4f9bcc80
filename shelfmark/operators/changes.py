"""Change plans: targets, claims, numbered names, journals, work lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.files import OWN_MARK as MARK
from shelfmark.sources.work import discard, saved

def claims(moves: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """status of each move: ok where the file is in its place, move for the first claim of a target
    by source path (letters folded), conflict for the others and where a file stays that isn't moved."""
    folded = F.lower(target)
    order = Window.partitionBy("_to").orderBy(F.col("_stays").desc(), source, key)
    rows = moves.withColumn("_to", folded).withColumn("_stays", (F.col(source) == F.col(target)).cast("int"))
    rows = rows.withColumn("_nth", F.row_number().over(order))
    status = F.when(F.col("_stays") == 1, "ok").when(F.col("_nth") == 1, "move").otherwise("conflict")
    return rows.withColumn("status", status).drop("_to", "_stays", "_nth")


def numbered(rows: DataFrame, target: str, order: list[Column]) -> DataFrame:
    """The n-th row of a target (letters folded) gets `` (n)`` from the second on, as ``free_target``."""
    nth = F.row_number().over(Window.partitionBy(F.lower(target)).orderBy(*order))
    return rows.withColumn("free_target", F.when(nth == 1, F.col(target)).otherwise(F.concat(F.col(target), F.lit(" ("), nth.cast("string"), F.lit(")"))))


def replay(journal: DataFrame, key: str, order: str, op: str, failed: str = "failed") -> DataFrame:
    """The last operation of each key; those that ended in a failure are left out."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return journal.withColumn("_nth", last).where((F.col("_nth") == 1) & (F.col(op) != failed)).drop("_nth")


def work_list(files: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose hash isn't in the cache for this path, size and time."""
    return files.join(cache.select(*keys).distinct(), keys, "left_anti")


def status_counts(rows: DataFrame, status: str, all_of: list[str]) -> DataFrame:
    """Rows by status, with zeros for those that don't occur."""
    counts = rows.agg(*[F.count_if(F.col(status) == s).alias(s) for s in all_of])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in all_of])).alias("e")).select("e.*")


def resolved(ops: DataFrame) -> DataFrame:
    """Adds status to ``ops(key, source, target)``, of one row for each file: ok, move or conflict.

    Files in their place stay. Of the moves to one target (letters folded) the first claims it, those that keep
    their name before others, then by source; where a file stays at the target, none does. A move to where another
    file still is waits for that file's move, and is a conflict if that one stays after all, along chains of waiting moves of any length:
    each round doubles the distance that is looked ahead. Moves in a circle make way for each other.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = ops.select("key", "source", "target", F.lower("source").alias("_from"), F.lower("target").alias("_to"), (F.col("source") == F.col("target")).alias("_stays"))
    order = Window.partitionBy("_to").orderBy(F.desc("_stays"), name("source") != name("target"), "_from", "key")
    first = F.when(F.col("_stays"), "ok").when(F.row_number().over(order) == 1, "move").otherwise("conflict")
    holders = rows.select(F.col("_from").alias("_to"), F.col("key").alias("_holder"))
    waiting = rows.withColumn("status", first).join(holders, "_to", "left")
    waiting = waiting.withColumn("_holder", F.when(F.col("_holder") != F.col("key"), F.col("_holder")))
    rows = saved(waiting.select("key", "source", "target", "status", "_holder"), "moves")
    holder = rows.select(F.col("key").alias("_holder"), F.col("status").alias("_of"), F.col("_holder").alias("_next"))
    # a move waits for its holder's; where that one is known to stay or to make way, so is this
    fails = F.when(F.col("_of") != "move", True).when(F.col("_next").isNull(), False)
    chain = saved(rows.where("status = 'move' and _holder is not null").join(holder, "_holder").select("key", F.col("_holder").alias("_at"), fails.alias("_fails")), "waiting")
    n = chain.where("_fails is null").count()
    for _ in range(n.bit_length()):
        # each round looks twice as far along the chain; what is open after all of them is a circle
        ahead = chain.select(F.col("key").alias("_at"), F.col("_at").alias("_then"), F.col("_fails").alias("_known"))
        looked = chain.where("_fails is null").join(ahead, "_at").select("key", F.col("_then").alias("_at"), F.col("_known").alias("_fails"))
        longer = saved(chain.where("_fails is not null").unionByName(looked), "waiting")
        discard(chain)
        chain = longer
        if chain.where("_fails is null").isEmpty():
            break
    failed = rows.join(chain.where("_fails").select("key", F.lit("conflict").alias("_now")), "key", "left")
    return failed.select("key", "source", "target", F.coalesce("_now", "status").alias("status"))


def archive_units(members: DataFrame) -> DataFrame:
    """path, members, matched, dat, unit of archives in ``members(path, member, dat, unit)``, a row for each
    catalogue row of a member (null dat: none). dat and unit are those that all members have in common, the first by
    catalogue and unit; null if there is none."""
    counts = members.groupBy("path").agg(F.count_distinct("member").alias("members"), F.count_distinct(F.when(F.col("dat").isNotNull(), F.col("member"))).alias("matched"))
    shared = members.where("dat is not null").groupBy("path", "dat", "unit").agg(F.count_distinct("member").alias("n"))
    whole = shared.join(counts, "path").where("n = members").groupBy("path").agg(F.min(F.struct("dat", "unit")).alias("u"))
    return counts.join(whole, "path", "left").select("path", "members", "matched", "u.dat", "u.unit")


# Archives that a playlist may point into.
POINTED_INTO = [".zip", ".7z"]


def relative(folder: Column, path: Column) -> Column:
    """``path`` as seen from ``folder`` (which ends with /, or is empty): .. for each of its folders that isn't the path's."""
    here, there = F.filter(F.split(folder, "/"), lambda x: x != ""), F.split(path, "/")
    other = F.array_position(F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False))
    shared = F.least(F.size(here), F.when(other > 0, other - 1).otherwise(F.size(here)), F.size(there) - 1).cast("int")
    return F.concat(F.repeat(F.lit("../"), F.size(here) - shared), F.array_join(F.slice(there, shared + 1, F.size(there)), "/"))


def playlists(disks: DataFrame, labels: bool = True) -> DataFrame:
    """set, path, content, usable of each set in ``disks(set, name, slot, file, member, members, label)``.

    A playlist stands beside its first disk, under the set's name; equal names of a folder (letters folded) are
    numbered by set. Lines are relative to the folder, with # and the member in archives of several, and |label. It
    isn't usable if a line holds a |, begins or ends with a space, or points into an archive of another kind."""
    file, folder = F.element_at(F.split("file", "/"), -1), F.regexp_extract("file", "^(.*/)[^/]*$", 1)
    first = F.first(folder).over(Window.partitionBy("set").orderBy("slot"))
    rows = disks.withColumn("_dir", first)
    near = relative(F.col("_dir"), F.col("file"))
    line = F.when((F.col("members") > 1) & F.col("member").isNotNull(), F.concat_ws("#", near, "member")).otherwise(near)
    line = F.when(F.startswith(line, F.lit("#")), F.concat(F.lit("./"), line)).otherwise(line)
    good = ~F.contains(line, F.lit("|")) & (F.trim(line) == line) & (F.col("member").isNull() | F.lower(F.regexp_extract(file, r"(\.[^.]+)$", 1)).isin(*POINTED_INTO))
    text = F.concat(line, F.lit("|"), F.coalesce("label", F.concat(F.lit("Disk "), F.col("slot").cast("string")))) if labels else line
    sets = rows.withColumn("_line", text).withColumn("_good", good).groupBy("set", "name", F.col("_dir").alias("folder")).agg(F.array_sort(F.collect_list(F.struct("slot", F.col("_line").alias("line")))).alias("l"), F.min("_good").alias("usable"))
    content = F.array_join(F.concat(F.array(F.lit(MARK)), F.transform("l", lambda x: x["line"]), F.array(F.lit(""))), "\n")
    sets, nth = _numbered(sets.select("set", "name", "folder", content.alias("content"), "usable"))
    named = F.concat("folder", "name", F.when(nth > 1, F.concat(F.lit(" ("), nth.cast("string"), F.lit(")"))).otherwise(""), F.lit(".m3u"))
    return sets.select("set", named.alias("path"), "content", "usable")


def _numbered(sets: DataFrame) -> tuple[DataFrame, Column]:
    """``sets`` and their numbers among those of one folder and name (letters folded), by set. Sets are put into one order
    in blocks, and each is numbered in its block, behind those of the blocks before: no task holds all of a name."""
    ordered = sets.withColumn("_name", F.lower("name")).repartitionByRange("folder", "_name", "set")
    blocks = saved(ordered.withColumn("_block", F.spark_partition_id()), "playlist-blocks")
    group = ["folder", "_name"]
    counts = blocks.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_block").orderBy("set")))
    known = counts.select(F.col("folder").alias("_f"), F.col("_name").alias("_m"), F.col("_block").alias("_b"), before.alias("_before"))
    same = F.col("folder").eqNullSafe(F.col("_f")) & F.col("_name").eqNullSafe(F.col("_m")) & (F.col("_block") == F.col("_b"))
    return placed.join(known, same), F.col("_in") + F.col("_before")


def playlist_states(planned: DataFrame, there: DataFrame) -> DataFrame:
    """Adds status to planned playlists by the files ``there(path, text)``: write, ok, or conflict with one that
    isn't our own. Own files that nothing is planned for come as stale, without content."""
    both = planned.join(there, "path", "full")
    same = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")) == F.col("content")
    own = F.startswith("text", F.lit(MARK))
    status = F.when(F.col("content").isNull(), F.when(own, "stale")).when(F.col("text").isNull() | (own & ~same), "write").when(same, "ok").otherwise("conflict")
    return both.withColumn("status", status).where("status is not null").drop("text")
