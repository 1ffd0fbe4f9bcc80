"""The plan for a folder: from files and decisions to a target, a status and a reason for each file.

A file's rule is the first that applies of one ordered table of conditions. Files of one content in one catalogue are
duplicates of the best placed; their keeper is found by a grouped minimum, so a content of many copies is no hot window.
Moves into folders of reasons get free names by number; what then claims one target or waits for another file's
move is settled by ``changes.resolved``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import places
from shelfmark.operators import changes
from shelfmark.sources.work import saved

# Files and folders of other programs that stay where they are.
KEPT_NAMES = ["systeminfo.txt", "metadata.txt", "metadata.pegasus.txt", "gamelist.xml", "rom.key", "desktop.ini", "thumbs.db"]
KEPT_EXTENSIONS = [".uae", ".key", ".srm", ".sav", ".state", ".nvram"]
MEDIA_FOLDERS = ["media", "images", "videos", "manuals", "downloaded_images", "snap", "boxart"]

#: path is unique and relative to the root. unit is the content a file stands for in its catalogue, null for files without;
#: matched and members count an archive's members; name is the file's target name; problem tells why it wasn't read.
FILES = ["path", "dat", "unit", "form", "name", "raw", "archive", "members", "matched", "link", "problem", "content"]


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_kept_file(path: Column) -> Column:
    low = F.lower(file_name(path))
    return low.isin(*KEPT_NAMES) | places.split_extension(low)[1].isin(*KEPT_EXTENSIONS)


def duplicates(files: DataFrame, flat: bool = False) -> DataFrame:
    """path and keeper of files that are spare: another file of the same catalogue, content and form is in its
    place, or not set aside, or an exact match, or no archive, or has a shorter path."""
    path = F.col("path")
    place = F.when(places.is_placed(path, places.canonical_folder(F.col("dat"), flat), F.col("name")), 0).otherwise(1)
    rank = F.struct(place, places.is_set_aside_duplicate(path), places.reserved_folder(path).isNotNull(), ~F.col("raw"), F.col("archive"), F.size(F.split(path, "/")), F.char_length(path), F.lower(path), path.alias("path"))
    units = files.where(F.col("unit").isNotNull() & F.col("problem").isNull() & ~F.col("link") & ~places.is_converted_original(path)).withColumn("rank", rank)
    keepers = units.groupBy("dat", "unit", "form").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keepers = keepers.select("dat", "unit", "form", F.col("best.path").alias("keeper"))
    return units.join(keepers, ["dat", "unit", "form"]).where("path <> keeper").select("path", "keeper")


def _ruled(rows: DataFrame, missing_dats: list[str], flat: bool) -> DataFrame:
    """Adds rule: struct(target, code, why, stays) by the first condition that holds."""
    path, matched = F.col("path"), F.col("unit").isNotNull()
    core, reserved, legacy = places.core_path(path), places.reserved_folder(path), places.is_legacy(path)
    top = F.lower(F.get(F.split(path, "/"), 0))
    inside = F.size(F.split(path, "/")) > 1
    folder = places.canonical_folder(F.col("dat"), flat)
    home = F.when(folder == "", F.col("name")).otherwise(F.concat_ws("/", folder, "name"))
    folders = F.array(*[F.lower(places.canonical_folder(F.lit(d))) for d in missing_dats]) if missing_dats else F.array().cast("array<string>")
    why = F.when(F.col("problem").isNotNull(), "").when(F.col("members") > 1, F.concat(F.lit("none of "), F.col("members").cast("string"), F.lit(" members match"))).otherwise("no catalogue matches")

    def rule(target: Column, why: Column | str, code: Column | str = "", stays: bool = False) -> Column:
        text = F.lit(why) if isinstance(why, str) else why
        return F.struct(target.alias("target"), (F.lit(code) if isinstance(code, str) else code).alias("code"), text.alias("why"), F.lit(stays).alias("stays"))

    reason_of = F.try_element_at(F.create_map(*[F.lit(x) for code, name in places.REASONS.items() for x in (name, code)]), reserved)
    table = [
        (places.is_converted_original(path) & legacy, rule(F.concat_ws("/", F.lit(places.CONVERTED), core), "original of a conversion")),
        (places.is_converted_original(path), rule(path, "original of a conversion")),
        (F.col("problem").isNotNull(), rule(path, F.concat(F.lit("could not be read: "), "problem"), stays=True)),
        (~matched & (F.col("matched") > 0), rule(path, F.concat(F.lit("archive has "), F.col("members").cast("string"), F.lit(" members ("), F.col("matched").cast("string"), F.lit(" matched)")), stays=True)),
        (F.col("keeper").isNotNull(), rule(places.reason_destination(path, F.lit("duplicate")), F.concat(F.lit("duplicate of "), "keeper"), "duplicate")),
        (matched & F.col("link"), rule(path, "symbolic link", stays=True)),
        (matched & F.col("action").isin(*places.REASONS), rule(places.reason_destination(path, F.col("action")), F.coalesce("detail", "action"), F.col("action"))),
        (matched, rule(home, F.coalesce("detail", F.lit("")))),
        (legacy, rule(F.concat_ws("/", reserved, core), why, F.coalesce(reason_of, F.lit("")))),
        (reserved.isNotNull(), rule(path, F.concat_ws(", ", why, F.concat(F.lit("already in "), reserved)))),
        (inside & F.array_contains(folders, top) & F.lit(not flat), rule(path, "its catalogue is not loaded", stays=True)),
        (inside & F.lit(flat) & top.isin(*MEDIA_FOLDERS), rule(path, "folder of another program", stays=True)),
        (is_kept_file(path), rule(path, "file of another program", stays=True)),
    ]
    cascade = F.when(*table[0])
    for condition, outcome in table[1:]:
        cascade = cascade.when(condition, outcome)
    return rows.withColumn("rule", cascade.otherwise(rule(F.concat_ws("/", F.lit(places.UNMATCHED), path), why)))


def _free_names(rows: DataFrame) -> DataFrame:
    """Gives moves into folders of reasons a target of their own: the plain name to the first by path where no file stays
    or comes there, else name (2).ext and so on, past all numbers that occur. Nothing is ever overwritten."""
    numbered = r"^(.*) \(([0-9]{1,9})\)(\.[^./]+)?$"
    coded = rows.where("status = 'move' and code <> ''")
    taken = rows.where("status <> 'move'").select(F.lower("path").alias("_to")).union(rows.where("status = 'move' and code = ''").select(F.lower("target"))).distinct()
    claims = coded.select("path", "target", F.lower("target").alias("_to")).join(taken.withColumn("_held", F.lit(True)), "_to", "left")
    nth = F.row_number().over(Window.partitionBy("_to").orderBy(F.lower("path"), "path"))
    claims = claims.withColumn("_j", nth - F.when(F.col("_held"), 0).otherwise(1)).where("_j > 0")
    occupied = rows.select(F.lower("path").alias("p")).union(rows.where("status = 'move'").select(F.lower("target"))).where(F.col("p").rlike(numbered))
    numbers = occupied.groupBy(F.concat(F.regexp_extract("p", numbered, 1), F.regexp_extract("p", numbered, 3)).alias("_to")).agg(F.array_sort(F.collect_set(F.regexp_extract("p", numbered, 2).cast("int"))).alias("_numbers"))
    # the j-th number from 2 on that isn't among those taken
    free = F.aggregate(F.coalesce("_numbers", F.array().cast("array<int>")), F.col("_j") + 1, lambda n, t: n + (t.between(2, n)).cast("int"))
    stem, extension = places.split_extension(file_name(F.col("target")))
    folder = F.left("target", F.char_length("target") - F.char_length(file_name(F.col("target"))))
    name = F.concat(folder, stem, F.lit(" ("), free.cast("string"), F.lit(")"), extension)
    renamed = claims.join(numbers, "_to", "left").select("path", name.alias("_free"))
    more = F.concat_ws(", ", F.nullif("why", F.lit("")), F.concat(F.lit("renamed to "), file_name(F.col("_free")), F.lit(": the name is taken there")))
    joined = rows.join(renamed, "path", "left")
    return joined.withColumn("why", F.when(F.col("_free").isNotNull(), more).otherwise(F.col("why"))).withColumn("target", F.coalesce("_free", "target")).drop("_free")


def plan(files: DataFrame, decisions: DataFrame | None = None, missing_dats: list[str] | None = None, flat: bool = False) -> DataFrame:
    """path, target, status (ok, move, skip, conflict, duplicate), code, reason, folder of each file.

    ``decisions`` has the action and detail of a selection by path. Of moves that can't be made, those whose target holds the
    same content are duplicates, the others conflicts; both stay where they are.
    """
    spare = duplicates(files, flat)
    rows = files.select(*FILES).join(spare, "path", "left")
    if decisions is None:
        rows = rows.withColumns({"action": F.lit(None).cast("string"), "detail": F.lit(None).cast("string")})
    else:
        rows = rows.join(decisions.select("path", "action", "detail"), "path", "left")
    ruled = _ruled(rows, missing_dats or [], flat)
    moved = F.when(F.col("rule.stays"), "skip").when(F.col("rule.target") == F.col("path"), "ok").otherwise("move")
    why = F.when((moved == "ok") & (F.col("rule.code") != ""), F.concat_ws(", ", "rule.why", F.lit("already there"))).otherwise(F.col("rule.why"))
    legacy = places.is_legacy(F.col("path")) & (moved == "move")
    why = F.when(legacy, F.concat_ws(", ", why, F.lit("moved out of _unmatched"))).otherwise(why)
    steps = ruled.select("path", "content", F.col("rule.target").alias("target"), F.col("rule.code").alias("code"), why.alias("why"), moved.alias("status"))
    steps = saved(_free_names(saved(steps, "plan-rules")), "plan-names")
    settled = changes.resolved(steps.select(F.col("path").alias("key"), F.col("path").alias("source"), F.when(F.col("status") == "move", F.col("target")).otherwise(F.col("path")).alias("target")))
    settled = settled.select(F.col("key").alias("path"), F.col("status").alias("settled"))
    both = steps.join(settled, "path").withColumn("status", F.when(F.col("status") == "skip", "skip").otherwise(F.col("settled"))).drop("settled")
    # who is at the target of a move that can't be made: the file that stays there, or the one that comes
    at = both.where("status <> 'conflict'").groupBy(F.lower(F.when(F.col("status") == "move", F.col("target")).otherwise(F.col("path"))).alias("_to")).agg(F.min(F.struct("path", "content")).alias("_at"))
    held = both.where("status = 'conflict'").withColumn("_to", F.lower("target")).join(at, "_to", "left")
    same = F.coalesce(F.col("content") == F.col("_at.content"), F.lit(False))
    text = F.when(same, F.concat(F.lit("same content as "), "_at.path")).otherwise(F.concat(F.lit("target also wanted by "), F.coalesce("_at.path", F.lit("a file that stays"))))
    held = held.withColumn("status", F.when(same, "duplicate").otherwise("conflict")).withColumn("why", F.concat_ws(", ", F.nullif("why", F.lit("")), text)).drop("_to", "_at")
    every = both.where("status <> 'conflict'").unionByName(held)
    final = F.when(F.col("status") == "move", F.col("target")).otherwise(F.col("path"))
    return every.select("path", final.alias("target"), "status", "code", F.col("why").alias("reason"), F.coalesce(places.top_folder(final), F.lit("")).alias("folder"))


def reason_counts(plan: DataFrame) -> DataFrame:
    """reason, n: what a plan changes, each file under one card, with zeros: kept (and of these renamed and moved),
    excluded, superseded, incomplete, duplicates, unmatched, conflict, skip. Files that already are where a reason
    sends them count under none."""
    moved, coded = F.col("status") == "move", F.col("code") != ""
    unknown = ~coded & ((F.col("folder") == places.UNMATCHED) | places.reserved_folder(F.col("target")).isNotNull())
    open_ = ~F.col("status").isin("conflict", "skip")
    kept = open_ & ~coded & ~unknown
    same_folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1) == F.regexp_extract("target", "^(.*/)?[^/]*$", 1)
    cards = {
        "kept": kept,
        "renamed": kept & moved & same_folder,
        "moved": kept & moved & ~same_folder,
        **{code: open_ & moved & (F.col("code") == code) for code in ("excluded", "superseded", "incomplete")},
        "duplicates": open_ & moved & (F.col("code") == "duplicate"),
        "unmatched": open_ & moved & ~coded & (F.col("folder") == places.UNMATCHED),
        "conflict": F.col("status") == "conflict",
        "skip": F.col("status") == "skip",
    }
    counts = plan.agg(*[F.count_if(x).alias(name) for name, x in cards.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("reason"), F.col(name).alias("n")) for name in cards])))
