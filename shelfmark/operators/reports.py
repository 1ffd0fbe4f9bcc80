"""Texts and summaries of a selection and of catalogues: what a person reads beside the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import disks, flags
from shelfmark.functions.names import strip_ext
from shelfmark.functions.tags import RULES, _map, square_groups

# Short texts of the codes that exclude an item.
LABELS = {
    "bad_dump": "bad dump", "virus": "virus-infected", "bad_size": "over/under dump", "pre_release": "pre-release", "prototype": "prototype", "demo": "demo", "faked": "faked",
    "unreleased": "unreleased", "modified": "modified", "flag_cr": "crack flag", "flag_h": "hack flag", "flag_t": "trainer flag", "flag_a": "alternate flag", "flag_f": "fix flag",
    "flag_tr": "translation flag", "language": "not in the selected languages", "rating_low": "rated below the minimum", "rating_not_top": "not among the top rated games",
    "rating_unrated": "no usable rating", "override_keep": "always kept by you", "override_exclude": "always excluded by you",
}
# Texts of titles of which nothing is kept, and what a person can do about it.
VANISHED = {"language": "no version in selected languages", "incomplete": "only incomplete sets", "rating_low": "below the minimum rating", "rating_not_top": "not among the top rated games", "rating_unrated": "no usable rating (unknown, or too few votes)"}
HINTS = {"rating_low": "lower the minimum rating", "rating_not_top": "raise Top N", "rating_unrated": "tick Keep unrated games (or lower Minimum votes)"}


def label(code: Column | str) -> Column:
    """The short text of a code; codes without one stand for themselves, null stays null."""
    column = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.try_element_at(_map(LABELS), column), column)


def described(info: Column | str) -> Column:
    """``bad dump [b] [b2], demo (Demo)`` of an array<struct<rule, text>>: the texts behind their rule, rules in the order
    they first occur. Empty for none and for null."""
    each = F.col(info) if isinstance(info, str) else info
    rules = F.array_distinct(F.transform(each, lambda x: x["rule"]))

    def texts(rule: Column) -> Column:
        return F.transform(F.filter(each, lambda x: x["rule"].eqNullSafe(rule)), lambda x: x["text"])

    return F.coalesce(F.array_join(F.transform(rules, lambda r: F.concat_ws(" ", label(r), F.array_join(texts(r), " "))), ", "), F.lit(""))


# What counts first where titles are lost for several reasons.
PRIORITY = ["rating_low", "rating_not_top", "rating_unrated", "language", *[f"flag_{x}" for x in flags.KEPT_CODES], *RULES, "incomplete"]


def vanished(chosen: DataFrame) -> DataFrame:
    """dat, title, name, reason, codes, languages, variants, detail of the titles of a selection of which nothing is kept.

    An item is blocked by its codes, or by its action if it has none. The items with the fewest of them tell why: ``codes`` are
    all of theirs by priority (then by text), ``reason`` is the first. The one of them that comes first by name gives title and name, and
    detail if the reason is a rating. ``languages`` are those of all variants, English first, if the reason is language.
    Of a title only distinct code lists and language lists are gathered, never its items."""
    codes = F.when((F.col("action") == "excluded") & (F.size("codes") > 0), F.col("codes")).otherwise(F.array("action"))
    blocked = F.struct(F.size("_codes").alias("n"), F.col("_codes").alias("codes"))
    near = F.struct(F.size("_codes"), F.lower("name"), "name", "key", F.col("t.title").alias("title"), "detail")
    titles = chosen.withColumn("_codes", codes).groupBy("dat", "title_key").agg(F.count_if(F.col("action") == "keep").alias("_kept"), F.count(F.lit(1)).alias("variants"), F.collect_set(blocked).alias("_lists"), F.min(near).alias("_near"), F.flatten(F.collect_set("t.played")).alias("_played"))
    lost = titles.where("_kept = 0").withColumn("_least", F.array_min(F.transform("_lists", lambda x: x["n"])))
    mine = F.array_distinct(F.flatten(F.transform(F.filter("_lists", lambda x: x["n"] == F.col("_least")), lambda x: x["codes"])))
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), c), F.lit(0)), F.lit(99))
    lost = lost.withColumn("codes", F.transform(F.array_sort(F.transform(mine, lambda c: F.struct(place(c).alias("p"), c.alias("c")))), lambda x: x["c"])).withColumn("reason", F.get("codes", 0))
    order = F.transform(F.array_sort(F.transform(F.array_distinct("_played"), lambda x: F.struct((x != "En").alias("other"), x.alias("x")))), lambda x: x["x"])
    languages = F.when(F.col("reason") == "language", order).otherwise(F.array().cast("array<string>"))
    detail = F.when(F.startswith("reason", F.lit("rating_")), F.col("_near.detail")).otherwise("")
    return lost.select("dat", F.col("_near.title").alias("title"), F.col("_near.name").alias("name"), "reason", "codes", languages.alias("languages"), "variants", detail.alias("detail"))


def vanish_summary(vanished: DataFrame) -> DataFrame:
    """kind, code, n of ``vanished(reason, codes)``: one row of kind titles (its code is empty), one for each reason, and one
    for each code. A title without codes counts for its reason alone; without titles the first row has 0."""
    total = vanished.agg(F.count(F.lit(1)).alias("n")).select(F.lit("titles").alias("kind"), F.lit("").alias("code"), "n")
    by = F.array_append(F.transform(F.coalesce("codes", F.array().cast("array<string>")), lambda c: F.struct(F.lit("code").alias("kind"), c.alias("code"))), F.struct(F.lit("reason").alias("kind"), F.coalesce("reason", F.lit("")).alias("code")))
    return total.unionByName(vanished.select(F.inline(by)).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n")))


def vanish_report(vanished: DataFrame, reason: str | None = None, limit: int | None = None) -> DataFrame:
    """``vanished(dat, title, reason, languages, detail, ...)`` with ``text`` and ``hint``, those of one reason if it is given.

    A title lost by its language tells which ones it has, one lost by its rating the detail. ``limit`` is for a page: the first
    ones by catalogue and title."""
    r = F.col("reason")
    has = F.when((r == "language") & (F.size("languages") > 0), F.concat(F.lit(" (has "), F.array_join("languages", ", "), F.lit(")")))
    rated = F.when(r.isin("rating_low", "rating_not_top") & (F.col("detail") != ""), F.concat(F.lit(" ("), "detail", F.lit(")")))
    known = F.try_element_at(_map(VANISHED), r)
    text = F.coalesce(F.concat(known, F.coalesce(has, rated, F.lit(""))), F.concat(F.lit("every version excluded: "), F.coalesce(label(r), F.lit(""))))
    rows = vanished.where(F.lit(True) if reason is None else r == reason).withColumn("text", text).withColumn("hint", F.coalesce(F.try_element_at(_map(HINTS), r), F.lit("")))
    return rows if limit is None else rows.orderBy("dat", "title").limit(limit)


def disk_base(name: Column | str) -> Column:
    """struct(base, number, total) of a disk's name: its title with the dump flags that make another variant; null for names
    without a disk, or of a set of fewer than two."""
    stem = strip_ext(name)
    told = F.filter(F.regexp_extract_all(stem, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda g: flags.disk_words(g)["number"].isNotNull())
    flag = F.get(told, 0)
    disk = flags.disk_words(flag)
    behind = F.substring(stem, F.position(F.concat(F.lit("("), flag, F.lit(")")), stem), F.char_length(stem))
    dump = F.filter(square_groups(behind), lambda f: ~disks.is_neutral(f))
    base = F.concat(disks.set_title(name if isinstance(name, Column) else F.col(name), flag), disks.flag_text(dump))
    return F.when((disk["total"] >= 2) & (disk["number"] >= 1), F.struct(base.alias("base"), disk["number"].alias("number"), disk["total"].alias("total")))


def ambiguous_bases(rows: DataFrame) -> DataFrame:
    """dat, base, totals of the titles in ``rows(dat, name)`` that stand for sets of different numbers of disks. ``totals`` are
    the distinct numbers, sorted: as many as a title has kinds of sets, whatever number of rows."""
    each = rows.select("dat", disk_base("name").alias("d")).where("d is not null").select("dat", "d.base", "d.total").distinct()
    return each.groupBy("dat", "base").agg(F.array_sort(F.collect_list("total")).alias("totals")).where(F.size("totals") > 1)


def catalogue_units(catalog: DataFrame) -> DataFrame:
    """dat, counts, units, roms of each catalogue: how many units it counts, and whether those are games (it has any set) or roms."""
    kind = F.when(F.bool_or(F.coalesce(F.col("set_name"), F.lit("")) != ""), "game").otherwise("rom")
    unit = F.coalesce(F.nullif("set_name", F.lit("")), "name")
    each = catalog.withColumn("unit", unit).groupBy("dat", "unit").agg(F.count(F.lit(1)).alias("roms"), F.max("set_name").alias("set_name"))
    return each.groupBy("dat").agg(kind.alias("counts"), F.count(F.lit(1)).alias("units"), F.sum("roms").alias("roms"))
