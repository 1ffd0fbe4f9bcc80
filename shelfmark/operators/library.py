"""Selection of a library as one query: eligibility, one choice for each game, ratings, overrides, vanished titles.

Items: key (unique), dat, name (which carries the tags), form, t (a tags struct). ``prepared`` adds details and keys
once and saves them. Decisions: key, action (keep, excluded, superseded, incomplete), codes, superseded_by, missing.
Every step is a window over the game's key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import archives, flags, keys, tags
from shelfmark.operators import disk_sets, ratings
from shelfmark.operators.select import first_difference, sorts
from shelfmark.sources.work import saved

STYLES = (tags.REGION_FIRST, tags.DISC, tags.ARCHIVE, tags.DATED)
KEEP, EXCLUDED, SUPERSEDED, INCOMPLETE, BORROWED = "keep", "excluded", "superseded", "incomplete", "borrowed"
RESCUED_RULES = ["modified", "bad_size"]


@dataclass(frozen=True)
class Profile:
    """The choices of a selection; the defaults are those of a new library."""

    exclude: list[str] = field(default_factory=lambda: list(tags.RULES))
    latest_only: bool = True
    best_variant: bool = True
    complete_only: bool = True
    borrow_editions: bool = True
    languages: list[str] = field(default_factory=lambda: ["En"])
    keep_flags: list[str] = field(default_factory=lambda: list(flags.KEPT_CODES))
    rescue_only_dump: bool = False
    region_priority: list[str] = field(default_factory=lambda: list(flags.REGION_PRIORITY))
    one_per_game: bool = True
    min_rating: float | None = None
    top_n: int | None = None
    min_votes: int = ratings.LEAST_VOTES
    keep_unrated: bool = False

    @property
    def rated(self) -> bool:
        return self.min_rating is not None or self.top_n is not None


@dataclass(frozen=True)
class Scope:
    """The catalogues that each family of rules covers; None for all of them."""

    latest: list[str] | None = None
    best: list[str] | None = None
    disks: list[str] | None = None
    language: list[str] | None = None
    region: list[str] | None = None


def _within(names: list[str] | None) -> Column:
    return F.lit(True) if names is None else F.col("dat").isin(*names)


def prepared(items: DataFrame) -> DataFrame:
    """Items with details of their tags and the keys of their game and title, saved: names are read once."""
    t = F.col("t")
    keyed = flags.with_details(items, "t").withColumn("game", keys.key_text(keys.game_key(t))).withColumn("title_key", keys.key_text(keys.title_group(t)))
    return saved(keyed, "library-items")


# ---- eligibility


def _coded_text(code: str):
    return lambda f: F.struct(F.lit(f"flag_{code}").alias("code"), F.concat(F.lit("["), f, F.lit("]")).alias("text"))


def eligibility(profile: Profile, scope: Scope) -> Column:
    """array<struct<code, text>>: everything that excludes an item, rules first, then dump flags that aren't kept,
    then ``language``. Dump flags count in dated names of catalogues of one variant a game."""
    t = F.col("t")
    rules = F.filter(t["info"], lambda x: x["rule"].isin(*profile.exclude) if profile.exclude else F.lit(False))
    of_rules = F.transform(rules, lambda x: F.struct(x["rule"].alias("code"), x["text"].alias("text")))
    none = F.filter(of_rules, lambda x: F.lit(False))
    listed = [none]
    for code in [x for x in flags.KEPT_CODES if x not in profile.keep_flags]:
        listed.append(F.transform(flags.with_code(t, code), _coded_text(code)))
    of_flags = F.when((t["style"] == tags.DATED) & _within(scope.best), F.concat(*listed)).otherwise(none)
    have = t["played"]
    shown = F.concat(F.lit("("), F.array_join(F.array_sort(F.transform(have, lambda x: F.concat(F.when(x == "En", "0").otherwise("1"), x))), ","), F.lit(")"))
    missing = F.lit(bool(profile.languages)) & ~F.arrays_overlap(have, F.array(*map(F.lit, profile.languages or [""]))) & _within(scope.language)
    of_language = F.when(missing, F.array(F.struct(F.lit("language").alias("code"), F.regexp_replace(shown, "[01]([A-Z])", "$1").alias("text")))).otherwise(none)
    return F.concat(of_rules, of_flags, of_language)


def with_eligibility(items: DataFrame, profile: Profile, scope: Scope) -> DataFrame:
    """Adds ``codes`` (each once, in order), ``detail`` and ``rescued``.

    The only dump of a version in a dated catalogue that keeps all of them stays although it is modified or of a
    wrong size, if the profile says so."""
    found = items.withColumn("_info", eligibility(profile, scope))
    found = found.withColumn("codes", F.array_distinct(F.transform("_info", lambda x: x["code"]))).withColumn("detail", F.array_join(F.transform("_info", lambda x: x["text"]), " ")).drop("_info")
    if not profile.rescue_only_dump:
        return found.withColumn("rescued", F.lit(False))
    open_ = (F.col("t.style") == tags.DATED) & ~_within(scope.latest if scope.latest is not None else []) & ~_within(scope.best if scope.best is not None else [])
    release = F.struct(F.lower("t.title"), "t.version", "t.regions", F.when(F.col("t.languages_implied"), tags.none_of_text()).otherwise(F.col("t.languages")), "t.flags")
    alive = F.count_if(F.size("codes") == 0).over(Window.partitionBy("dat", release))
    mild = F.forall("codes", lambda x: x.isin(*RESCUED_RULES))
    found = found.withColumn("rescued", open_ & (F.size("codes") > 0) & mild & (alive == 0))
    return found.withColumn("codes", F.when(F.col("rescued"), tags.none_of_text()).otherwise(F.col("codes")))


# ---- versions inside a group


def with_version_keys(items: DataFrame, group: list[str], out: str = "vkey") -> DataFrame:
    """Adds the version key of ``t.version``, comparable inside a group.

    Where a version of the group writes a dotted part behind the first with a leading zero, that part is a decimal
    fraction in all of them: v1.02 is older than v1.1. Groups without such a part keep whole numbers."""
    parts = F.split(F.regexp_extract("t.version", r"^[vV]([0-9]+(?:[.][0-9]+)*)", 1), "[.]")
    each = items.select(*group, F.posexplode(parts).alias("place", "part")).where("place > 0 and part <> ''")
    wide = each.groupBy(*group, "place").agg(F.max(F.char_length("part")).alias("width"), F.max((F.char_length("part") > 1) & F.startswith("part", F.lit("0"))).alias("padded")).where("padded")
    widths = wide.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("place", "width"))).alias("_widths"))
    joined = items.join(widths, group, "left")
    none = F.create_map().cast("map<int,int>")
    return joined.withColumn(out, tags.version_key(F.col("t.version"), F.coalesce("_widths", none))).drop("_widths")


def superseded(items: DataFrame) -> DataFrame:
    """name, newer: names of which a group that differs in the version alone has a newer one.

    Of the disks of a set, older ones are superseded only if the newest version has all of its disks."""
    names = items.select("dat", "form", "name", "t").dropDuplicates(["dat", "form", "name"])
    disk = F.col("t.disk")
    names = names.withColumn("disk", disk["number"]).withColumn("total", disk["total"])
    key = F.when(F.col("disk").isNull(), keys.key_text(keys.supersede_key(F.col("t")))).otherwise(F.concat(F.lit("set:"), keys.key_text(keys.set_key(F.col("t")))))
    keyed = with_version_keys(names.withColumn("group", key), ["dat", "form", "group"])
    group = Window.partitionBy("dat", "form", "group")
    newest = keyed.withColumn("newest", F.max("vkey").over(group)).withColumn("best", F.max(F.when(F.col("vkey") == F.col("newest"), F.struct("vkey", "name"))).over(group)["name"])
    of_newest = F.col("vkey") == F.col("newest")
    have = F.collect_set(F.when(of_newest, F.col("disk"))).over(group)
    needed = F.max(F.when(of_newest, F.col("total"))).over(group)
    by_disk = F.min(F.when(of_newest & F.col("disk").isNotNull(), F.struct("disk", "name"))).over(group)["name"]
    same = F.min(F.when(of_newest, F.col("name"))).over(Window.partitionBy("dat", "form", "group", "disk"))
    counted = newest.withColumn("whole", F.col("disk").isNull() | (F.size(have) >= needed)).withColumn("newer", F.when(F.col("disk").isNull(), F.col("best")).otherwise(F.coalesce(same, by_disk)))
    return counted.where((F.col("vkey") < F.col("newest")) & F.col("whole")).select("dat", "form", "name", "newer")


# ---- one choice for each game


def _winner(items: DataFrame, group: list[str], criteria: list[tuple[str, Column, bool]]) -> DataFrame:
    """Adds the name of the first item of each group, and why others yield to it."""
    window = Window.partitionBy(*group).orderBy(*sorts(criteria), F.lower("name"), F.col("name"), F.col("key"))
    return items.withColumns({"winner": F.first("name").over(window), "why": first_difference(criteria, window)})


def language_rank(profile: Profile) -> Column:
    return flags.rank_in(F.col("t.played"), profile.languages) if profile.languages else F.lit(0)


def one_per_game(items: DataFrame, profile: Profile) -> DataFrame:
    """Region-first names: the best language, then region, then the newest version, the fewest tags, and the name."""
    keyed = with_version_keys(items, ["dat", "form", "game"])
    region = flags.rank_in(F.col("t.regions"), flags.region_order(profile.region_priority))
    return _winner(keyed, ["dat", "form", "game"], [("preferred language", language_rank(profile), False), ("preferred region", region, False), ("newer version", F.col("vkey"), True), ("fewer tags", F.col("t.extra_tags"), False)])


def best_archive(items: DataFrame, profile: Profile, best: bool = True) -> DataFrame:
    """Archives: the best language, chipset, memory, PAL, newest version, build and name of each game; or the newest
    version and build of each variant of it."""
    t = F.col("t")
    keyed = with_version_keys(items, ["dat", "game"])
    newest = [("newer version", F.col("vkey"), True), ("higher build number", t["build"], True)]
    if best:
        machine = [("better chipset", t["platform_rank"], False), ("standard memory", t["memory_rank"], False), ("PAL instead of NTSC", F.array_contains("t.video", "NTSC"), False)]
        return _winner(keyed, ["dat", "game"], [("preferred language", language_rank(profile), False), *machine, *newest])
    return _winner(keyed.withColumn("variant", keys.key_text(archives.variant_signature(t))), ["dat", "game", "variant"], newest)


def best_edition(items: DataFrame, profile: Profile) -> DataFrame:
    """Discs: the best edition of each game by its first disc, and of the discs of this edition the newest
    revisions; items of other editions and older revisions get the name of what they yield to."""
    t = F.col("t")
    without_disc = F.struct("t.regions", F.when(F.col("t.languages_implied"), tags.none_of_text()).otherwise(F.col("t.languages")), F.filter("t.flags", lambda f, i: F.get("t.kinds", i) != "disk"))
    keyed = items.withColumn("edition", keys.key_text(without_disc)).withColumn("disc", t["disc"])
    keyed = with_version_keys(keyed, ["dat", "game"])
    region = flags.rank_in(F.col("t.regions"), flags.region_order(profile.region_priority))
    first = F.greatest("disc", F.lit(1))
    criteria = [("earlier disc", first, False), ("preferred language", language_rank(profile), False), ("preferred region", region, False), ("newer version", F.col("vkey"), True), ("fewer tags", t["extra_tags"], False)]
    ranked = _winner(keyed, ["dat", "game"], criteria)
    chosen = F.first("edition").over(Window.partitionBy("dat", "game").orderBy(*sorts(criteria), F.lower("name"), "name", "key"))
    ranked = ranked.withColumn("chosen", chosen)
    revisions = Window.partitionBy("dat", "game", "edition", "disc").orderBy(F.desc("vkey"), F.lower("name"), "name", "key")
    ranked = ranked.withColumns({"own": F.first("name").over(revisions), "own_why": first_difference([("newer version", F.col("vkey"), True)], revisions)})
    same = F.col("edition") == F.col("chosen")
    return ranked.withColumns({"winner": F.when(same, F.col("own")).otherwise(F.col("winner")), "why": F.when(same, F.col("own_why")).otherwise(F.col("why"))}).drop("own", "own_why")


# ---- the whole


def select(items: DataFrame, profile: Profile, scope: Scope = Scope(), rated: DataFrame | None = None, overrides: DataFrame | None = None, styles: tuple[str, ...] = STYLES) -> DataFrame:  # noqa: B008
    """key, dat, name, t, title_key, action, codes, detail, superseded_by, missing, why of every one of the prepared items;
    ``why`` names the first criterion by which a superseded item yields to what supersedes it.

    ``styles`` are the layouts that occur; those left out are not planned, and their items not decided.

    ``rated`` gives rating and votes by (dat, title); ``overrides`` an action, keep or excluded, by (dat, name). A
    game's rating holds for all its kept items; overrides beat every rule.
    """
    if profile.rated and rated is None:
        raise ValueError("a rating filter needs ratings")
    found = with_eligibility(items, profile, scope)
    found = found.where(F.col("t.style").isin(*styles))
    base = ["key", "dat", "name", "t", "game", "title_key", "codes", "detail"]
    out = [found.where(F.size("codes") > 0).select(*base, F.lit(EXCLUDED).alias("action"), F.lit("").alias("superseded_by"), F.array().cast("array<int>").alias("missing"), F.lit("").alias("why"))]
    alive = found.where(F.size("codes") == 0)
    lent: list[DataFrame] = []

    def decided(df: DataFrame, stays: Column, winner: str = "winner", missing: Column | None = None, action: Column | None = None) -> None:
        missing = F.array().cast("array<int>") if missing is None else missing
        action = F.when(stays | F.col("rescued"), KEEP).otherwise(SUPERSEDED) if action is None else action
        out.append(df.select(*base, action.alias("action"), F.when(action == SUPERSEDED, F.col(winner)).otherwise("").alias("superseded_by"), missing.alias("missing"), F.when(action == SUPERSEDED, F.col("why")).otherwise("").alias("why")))

    style = F.col("t.style")
    latest, best = _within(scope.latest) & F.lit(profile.latest_only), _within(scope.best) & F.lit(profile.best_variant)
    one = _within(scope.latest) & _within(scope.region) & F.lit(profile.one_per_game)
    by_name = F.col("name") == F.col("winner")

    if tags.REGION_FIRST in styles:
        rows = alive.where(style == tags.REGION_FIRST)
        if profile.one_per_game:
            decided(one_per_game(rows.where(one), profile), by_name)
        if profile.latest_only and not (profile.one_per_game and scope.region is None):
            newest = rows.where(latest & ~one)
            decided(newest.join(superseded(newest), ["dat", "form", "name"], "left").withColumn("why", F.lit("newer version")), F.col("newer").isNull(), "newer")
    if tags.DISC in styles:
        decided(best_edition(alive.where((style == tags.DISC) & (latest | one)), profile), by_name)
    if tags.ARCHIVE in styles:
        rows = alive.where(style == tags.ARCHIVE)
        decided(best_archive(rows.where(best), profile), by_name)
        if profile.latest_only and not (profile.best_variant and scope.best is None):
            decided(best_archive(rows.where(latest & ~best), profile, best=False), by_name)
    if tags.DATED in styles:
        rows = alive.where(style == tags.DATED)
        for some, is_best in ((rows.where(best), True), (rows.where(latest & ~best), False)):
            if not is_best and (not profile.latest_only or profile.best_variant and scope.best is None):
                continue
            sets = sets_of(found, some, profile, scope, is_best)
            judged = some.join(disk_sets.decided(some, sets), "key")
            lacking = F.lit(profile.complete_only) & disk_sets.is_disk(F.col("t")) & _within(scope.disks)
            action = F.when(F.col("rescued") | F.col("in_kept"), KEEP).when(F.col("any_complete"), SUPERSEDED).when(lacking, INCOMPLETE).otherwise(KEEP)
            decided(judged, F.lit(True), missing=F.when(action == INCOMPLETE, F.col("lacking")).otherwise(F.array().cast("array<int>")), action=action)
            if profile.borrow_editions:
                lent.append(disk_sets.borrowed(sets))
    others = ((style == tags.REGION_FIRST) & ~latest & ~one) | ((style == tags.DISC) & ~(latest | one)) | (style.isin(tags.ARCHIVE, tags.DATED) & ~best & ~latest)
    decided(alive.where(others).withColumns({"winner": F.col("name"), "why": F.lit("")}), F.lit(True))
    chosen = out[0]
    for part in out[1:]:
        chosen = chosen.unionByName(part)
    if lent:
        chosen = _with_borrowed(chosen, lent)
    if profile.rated:
        chosen = _with_ratings(chosen, profile, rated)
    if overrides is not None:
        forced = overrides.select("dat", "name", F.col("action").alias("_forced")).dropDuplicates(["dat", "name"])
        chosen = chosen.join(forced, ["dat", "name"], "left")
        clear = lambda column, empty: F.when(F.col("_forced").isNull() | (F.col("_forced") == F.col("action")) & (F.col("_forced") == KEEP), F.col(column)).otherwise(empty)
        code = F.when(F.col("_forced") == KEEP, F.array(F.lit("override_keep"))).otherwise(F.array(F.lit("override_exclude")))
        chosen = chosen.withColumns({"codes": clear("codes", code), "detail": clear("detail", F.lit("")), "superseded_by": clear("superseded_by", F.lit("")), "missing": clear("missing", F.array().cast("array<int>")), "why": clear("why", F.lit(""))})
        chosen = chosen.withColumn("action", F.coalesce("_forced", "action")).drop("_forced")
    return chosen.select("key", "dat", "name", "t", "title_key", "action", "codes", "detail", "superseded_by", "missing", "why")


def sets_of(found: DataFrame, some: DataFrame, profile: Profile, scope: Scope, best: bool = True) -> DataFrame:
    """The saved sets of ``some`` dated items (``disk_sets.chosen_sets``); disks of ``found`` that only their language
    excludes may be borrowed as well."""
    pool = None
    if profile.borrow_editions:
        open_ = disk_sets.is_disk(F.col("t")) & _within(scope.disks) & F.forall("codes", lambda c: c == "language")
        shelf = F.to_json(F.struct(F.lower("t.title"), F.lower("t.publisher"), "t.disk.total"))
        pool = with_version_keys(found.where((F.col("t.style") == tags.DATED) & open_).withColumn("shelf", shelf), ["dat", "shelf"])
    keyed = with_version_keys(some, ["dat", "game"])
    return saved(disk_sets.chosen_sets(keyed, pool, profile.languages, best), "disk-sets")


def dated_sets(items: DataFrame, profile: Profile, scope: Scope = Scope()) -> DataFrame:  # noqa: B008
    """All sets of the prepared dated items of a selection of best variants, with what the kept ones borrow."""
    found = with_eligibility(items, profile, scope)
    alive = found.where((F.size("codes") == 0) & (F.col("t.style") == tags.DATED) & _within(scope.best))
    return sets_of(found, alive, profile, scope)


def _with_borrowed(chosen: DataFrame, lent: list[DataFrame]) -> DataFrame:
    """A borrowed disk is kept as a part of the set it completes, whatever was decided of it before."""
    every = lent[0]
    for more in lent[1:]:
        every = every.unionByName(more)
    notes = every.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("_text"))
    joined, is_lent, kept = chosen.join(notes, "key", "left"), F.col("_text").isNotNull(), F.col("action") == KEEP
    code = F.array(F.lit(BORROWED))
    changed = {
        "codes": F.when(is_lent, F.when(kept, F.concat("codes", code)).otherwise(code)).otherwise(F.col("codes")),
        "detail": F.when(is_lent, F.when(kept & (F.col("detail") != ""), F.concat_ws("; ", "detail", "_text")).otherwise(F.col("_text"))).otherwise(F.col("detail")),
        "superseded_by": F.when(is_lent, "").otherwise(F.col("superseded_by")),
        "missing": F.when(is_lent, F.array().cast("array<int>")).otherwise(F.col("missing")),
        "why": F.when(is_lent, "").otherwise(F.col("why")),
        "action": F.when(is_lent, KEEP).otherwise(F.col("action")),
    }
    return joined.withColumns(changed).drop("_text")


def _with_ratings(chosen: DataFrame, profile: Profile, rated: DataFrame) -> DataFrame:
    kept = F.col("action") == KEEP
    # the choice so far is read twice, for the games and for their items
    keyed = saved(chosen, "library-choice")
    games = keyed.where(kept).groupBy("dat", "game").agg(F.min_by("t.title", "key").alias("title"), F.max(F.size("missing") == 0).alias("complete"))
    known = rated.select("dat", "title", "rating", "votes")
    units = games.join(known, ["dat", "title"], "left").withColumn("rating", ratings.usable("rating", "votes", profile.min_votes))
    judged = ratings.rating_codes(units, profile.min_rating, profile.top_n, profile.keep_unrated).where(F.size("codes") > 0)
    judged = judged.select("dat", "game", F.col("codes").alias("_codes"), F.when(F.col("rating").isNull(), "no usable rating").otherwise(F.concat(F.lit("rated "), F.format_number("rating", 1), F.lit(" ("), F.col("votes").cast("string"), F.lit(" votes)"))).alias("_detail"))
    joined = keyed.join(judged, ["dat", "game"], "left")
    gone = kept & F.col("_codes").isNotNull()
    changed = {"codes": F.when(gone, F.col("_codes")).otherwise(F.col("codes")), "detail": F.when(gone, F.col("_detail")).otherwise(F.col("detail"))}
    return joined.withColumns(changed).withColumn("action", F.when(gone, EXCLUDED).otherwise(F.col("action"))).drop("game", "_codes", "_detail")


def vanished(chosen: DataFrame) -> DataFrame:
    """dat, title, variants, reason, codes of the titles of which nothing is kept.

    The reason is the first code of the item with the fewest codes (then by name); incomplete items count as that."""
    blocked = F.when(F.col("action") == INCOMPLETE, F.array(F.lit(INCOMPLETE))).when(F.col("action") == SUPERSEDED, F.array(F.lit(SUPERSEDED))).otherwise(F.col("codes"))
    titles = chosen.withColumn("why", blocked).groupBy("dat", "title_key").agg(
        F.count_if(F.col("action") == KEEP).alias("kept"), F.count(F.lit(1)).alias("variants"), F.min(F.struct(F.size("why"), "name", F.col("t.title").alias("title"), F.col("why").alias("why"))).alias("near"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("why") == 1, F.col("why")))))).alias("codes")
    )
    return titles.where("kept = 0").select("dat", F.col("near.title").alias("title"), "variants", F.get("near.why", 0).alias("reason"), "codes")
