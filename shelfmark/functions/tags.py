"""Tags of structured release names, as native expressions.

A name is a title and trailing (round) and [square] groups. Each kind of tag goes to the first group
that has its form and that no kind before it has taken; what is left over are flags. Instead of
walking the groups, each kind finds the position of its group among those still free. Forms are built of
a few tests (dotted numbers, words with a number behind, codes with digits behind) over tables of words.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import date_parts

# Regions by video standard.
PAL = ["Europe", "Australia", "New Zealand", "Germany", "France", "Spain", "Italy", "Netherlands", "Sweden", "Denmark", "Norway", "Finland", "Scandinavia", "UK", "United Kingdom", "Ireland", "Portugal", "Austria", "Switzerland", "Belgium", "Greece", "Poland", "Russia", "Croatia", "Czech", "Hungary", "Turkey", "South Africa", "China", "Hong Kong", "India", "Argentina", "United Arab Emirates"]
NTSC = ["USA", "Canada", "Japan", "Korea", "Taiwan", "Brazil", "Mexico", "Peru", "Latin America"]
NEUTRAL = ["World", "Asia", "Unknown"]
# Country codes of the dated layout.
COUNTRIES = {
    "AE": "United Arab Emirates", "AR": "Argentina", "AT": "Austria", "AU": "Australia", "BE": "Belgium", "BR": "Brazil", "CA": "Canada", "CH": "Switzerland", "CN": "China",
    "CZ": "Czech", "DE": "Germany", "DK": "Denmark", "ES": "Spain", "EU": "Europe", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GR": "Greece", "HK": "Hong Kong",
    "HR": "Croatia", "HU": "Hungary", "IE": "Ireland", "IN": "India", "IT": "Italy", "JP": "Japan", "KR": "Korea", "MX": "Mexico", "NL": "Netherlands", "NO": "Norway",
    "NZ": "New Zealand", "PL": "Poland", "PT": "Portugal", "RU": "Russia", "SE": "Sweden", "TR": "Turkey", "TW": "Taiwan", "US": "USA", "ZA": "South Africa",
}
# Language codes, the language a region implies, and those that only a language filter knows.
LANGUAGES = [
    "En", "Ja", "Fr", "De", "Es", "It", "Nl", "Pt", "Sv", "No", "Da", "Fi", "Zh", "Ko", "Pl", "Ru", "El", "Ca", "Hu", "Cs", "Sk", "Tr", "Ar", "He", "Hr",
    "Is", "Et", "Lv", "Lt", "Sr", "Sl", "Ro", "Bg", "Uk", "Id", "Th", "Vi", "Ms", "Hi", "Ga", "Eu", "Gd", "Cy",
]
IMPLIED = {
    "En": ["USA", "World", "Europe", "Australia", "New Zealand", "UK", "United Kingdom", "Canada", "Ireland", "South Africa"],
    "Ja": ["Japan"], "De": ["Germany", "Austria"], "Fr": ["France"], "Es": ["Spain", "Mexico", "Argentina", "Latin America", "Peru"], "It": ["Italy"], "Nl": ["Netherlands"], "Sv": ["Sweden"],
    "No": ["Norway"], "Da": ["Denmark"], "Fi": ["Finland"], "Pt": ["Brazil", "Portugal"], "Ru": ["Russia"], "Ko": ["Korea"], "Zh": ["China", "Taiwan", "Hong Kong"], "Pl": ["Poland"], "El": ["Greece"],
}
FILTER_ONLY = {"Switzerland": "De", "Belgium": "Nl", "Czech": "Cs", "Hungary": "Hu", "Croatia": "Hr", "Turkey": "Tr", "India": "En", "United Arab Emirates": "Ar", "Scandinavia": "Sv"}
VIDEO_TAGS = ["PAL", "NTSC", "PAL-NTSC", "NTSC-PAL", "MPAL"]
# Words of a release state; in the dated layout in any case.
STATUS_WORDS = ["Beta", "Proto", "Possible Proto", "Demo", "Sample", "Kiosk", "Promo", "Debug", "Debug Version", "Tech Demo", "Auto Demo"]
DATED_STATUS_WORDS = ["alpha", "beta", "preview", "pre-release", "proto", "demo"]
STAGES = ["alpha", "beta", "rc"]
# Exclusion rules in report order, the words of their round groups, and codes and words of their square ones.
RULES = ["bad_dump", "virus", "bad_size", "pre_release", "prototype", "demo", "faked", "unreleased", "modified"]
ROUND_WORDS = {
    "pre_release": ["beta", "alpha", "preview", "pre-release", "prerelease", "debug", "debug version", "test program"],
    "prototype": ["proto", "possible proto"],
    "demo": ["demo", "tech demo", "auto demo", "sample", "kiosk"],
    "unreleased": ["unreleased"],
}
ARCHIVE_WORDS = {"pre_release": ["beta", "pre release", "preview"], "demo": ["game demo", "demo", "playable demo"], "unreleased": ["unreleased"]}
TRIAL_WORDS = ["taikenban", "tentou taikenban", "tentou-you taikenban", "tokubetsu taikenban", "tentou-you demo", "tentou-you demonstration", "tentou-you demo movie", "tentou-you demonstration movie"]
SQUARE_CODES = {"bad_dump": ["b"], "virus": ["v"], "bad_size": ["o", "u"], "modified": ["m"]}
SQUARE_WORDS = {"modified": ["modified"], "faked": ["fake", "faked"], "unreleased": ["unreleased"]}
SQUARE_WORDS_ANY_CASE = {"virus": ["inc virus", "inc. virus"], "pre_release": ["beta", "alpha", "preview", "pre-release"], "prototype": ["proto", "prototype"], "demo": ["demo", "technical demo"]}
CATEGORY_RULES = {"Demos": "demo", "Coverdiscs": "demo", "Preproduction": "prototype"}
# Layouts of names.
REGION_FIRST, DATED, ARCHIVE, DISC = "region_first", "dated", "archive", "disc"
# Fixed value: a group of a name.
GROUP = r"\([^()]*\)|\[[^\[\]]*\]"


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _either(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def none_of_text() -> Column:
    return F.array().cast("array<string>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), then), 0)


# ---- forms


def dotted(text: Column) -> Column:
    """Numbers parted by dots."""
    return F.forall(F.split(text, "[.]"), lambda x: x.rlike("^[0-9]+$"))


def without_number(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+[0-9]+$", "")


def coded(text: Column, code: str) -> Column:
    """A code such as b, with digits right behind it and words after a space at most."""
    behind = F.regexp_replace(F.substring(text, len(code) + 1, F.char_length(text)), "^[0-9]+", "")
    return F.startswith(text, F.lit(code)) & ((behind == "") | F.substring(behind, 1, 1).rlike(r"\s"))


def begins_with_word(text: Column, word: str) -> Column:
    behind = F.substring(text, len(word) + 1, 1)
    return F.startswith(text, F.lit(word)) & ~behind.rlike("[0-9A-Za-z_]")


def is_bad(flag: Column) -> Column:
    return coded(flag, "b")


def is_version(text: Column) -> Column:
    """Rev 1, Rev A, Rev 1.2, REV-B, v1.1, V2a, v2.0-beta3."""
    body = F.substring(text, 5, F.char_length(text))
    parts = F.split(body, "[.]")
    revision = F.startswith(text, F.lit("Rev ")) & F.get(parts, 0).rlike("^[0-9A-Z]+$") & F.forall(F.slice(parts, 2, F.size(parts)), lambda x: x.rlike("^[0-9]+$"))
    board = F.startswith(text, F.lit("REV-")) & body.rlike("^[0-9A-Z]+$")
    pieces = F.split(F.substring(text, 2, F.char_length(text)), "-")
    stage = F.regexp_replace(F.coalesce(F.get(pieces, 1), F.lit("rc")), "[0-9]+$", "")
    numbered = F.substring(text, 1, 1).isin("v", "V") & (F.size(pieces) <= 2) & dotted(F.regexp_replace(F.get(pieces, 0), "[a-z]$", "")) & stage.isin(*STAGES)
    return revision | board | numbered


def is_status(text: Column) -> Column:
    return without_number(text).isin(*STATUS_WORDS)


def is_dated_status(text: Column) -> Column:
    word = F.regexp_replace(F.lower(text), " [0-9]+$", "")
    return word.isin(*DATED_STATUS_WORDS) | (F.startswith(word, F.lit("demo-")) & F.substring(word, 6, F.char_length(word)).rlike("^[a-z]+$"))


def is_date(text: Column) -> Column:
    """A year, or a year with month and day; unknown digits are x or ?."""
    return date_parts(text).isNotNull()


def title_version_steps(title: Column) -> list[tuple[str, Column]]:
    """Steps to the column _cut of a dated title: struct(title without its version, version, upper-case letters behind it).

    The version is the last word (v1.2, v1.2a, r12, rev2) or the last ones (Rev 2, v1.3 rev1, v1.3 rev 1). What is asked of
    the last three words is computed once for each.
    """
    letters = lambda w: F.regexp_extract(w, "([A-Z]{1,3})$", 1)

    def numbered(w: Column) -> Column:
        return F.startswith(w, F.lit("v")) & dotted(F.regexp_replace(F.substring(w, 2, F.char_length(w)), "[a-z]$", ""))

    def revised(w: Column) -> Column:
        return w.rlike("^(?:[Rr]ev|r)[0-9]") & dotted(F.regexp_replace(w, "^[A-Za-z]+", ""))

    def glued(w: Column) -> Column:
        return w.rlike("^v.*r(?:ev)?[0-9.]+$") & numbered(F.regexp_extract(w, "^(v[0-9.]+[a-z]?)(?:[Rr]ev|r)[0-9]", 1))

    def asked(x: Column) -> Column:
        core = x["core"]
        return F.struct(x["word"].alias("word"), x["letters"].alias("letters"), core.alias("core"), numbered(core).alias("numbered"), revised(core).alias("revised"), dotted(core).alias("dotted"), glued(core).alias("glued"), x["word"].isin("rev", "Rev").alias("rev"))

    one, two, three = (F.get("_ends", n) for n in range(3))
    parted = two["rev"] & one["dotted"]
    taken = F.when(three["numbered"] & parted, 3).when(((two["numbered"] | two["revised"]) & one["revised"]) | parted, 2).when(one["numbered"] | one["revised"] | one["glued"], 1).otherwise(0)
    n = F.col("_taken")
    version = F.when(n == 3, F.concat_ws(" ", three["core"], two["word"], one["core"])).when((n == 2) & parted, F.concat_ws(" ", two["word"], one["core"])).when(n == 2, F.concat_ws(" ", two["core"], one["core"])).when(n == 1, one["core"]).otherwise("")
    behind = F.when(n == 3, F.concat(three["letters"], one["letters"])).when((n == 2) & parted, one["letters"]).when(n == 2, F.concat(two["letters"], one["letters"])).when(n == 1, one["letters"]).otherwise("")
    bare = F.when(n == 1, F.regexp_extract(title, r"^(.*?)(?:\s+\S+){1}$", 1)).when(n == 2, F.regexp_extract(title, r"^(.*?)(?:\s+\S+){2}$", 1)).when(n == 3, F.regexp_extract(title, r"^(.*?)(?:\s+\S+){3}$", 1)).otherwise(title)
    return [
        ("_words", F.split(title, r"\s+")),
        ("_behind", F.transform(F.slice(F.concat(F.reverse("_words"), _texts([""] * 3)), F.lit(1), F.lit(3)), lambda w: F.struct(w.alias("word"), letters(w).alias("letters")))),
        ("_cores", F.transform("_behind", lambda x: F.struct(x["word"].alias("word"), x["letters"].alias("letters"), F.left(x["word"], F.char_length(x["word"]) - F.char_length(x["letters"])).alias("core")))),
        ("_ends", F.transform("_cores", asked)),
        ("_found", taken),
        ("_taken", F.when(F.size("_words") > F.col("_found"), F.col("_found")).otherwise(0)),
        ("_cut", F.struct(bare.alias("title"), version.alias("version"), behind.alias("letters"))),
    ]


# ---- groups


def group_steps(name: Column) -> list[tuple[str, Column]]:
    """Steps to the columns _whole, _round and _square of a name: its run of groups at the end by their kind, in order and
    without their signs, and the text before that run. Groups that a text follows belong to that text."""
    c = F.col
    blank = lambda x: ~x.rlike(r"\S")

    def of(sign: str) -> Column:
        found = F.filter(F.slice("_groups", c("_last") + 1, F.size("_groups")), lambda g: F.startswith(g, F.lit(sign)))
        return F.transform(found, lambda g: F.substring(g, F.lit(2), F.char_length(g) - 2))

    return [
        ("_groups", F.regexp_extract_all(name, F.lit(GROUP), F.lit(0))),
        # text n, from 0, stands before group n; the last that isn't blank ends what is before the run
        ("_texts", F.split(name, GROUP)),
        ("_last", F.greatest(F.size("_texts") - F.coalesce(F.nullif(F.array_position(F.transform(F.reverse("_texts"), blank), F.lit(False)), F.lit(0)), F.size("_texts")), F.lit(0)).cast("int")),
        ("_whole", F.trim(F.array_join(F.zip_with(F.slice("_texts", F.lit(1), c("_last") + 1), F.slice("_groups", F.lit(1), c("_last")), lambda x, g: F.concat(x, F.coalesce(g, F.lit("")))), ""))),
        ("_round", of("(")),
        ("_square", of("[")),
    ]


def square_groups(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[[^\[\]]*\]"), F.lit(0)), lambda g: F.substring(g, F.lit(2), F.char_length(g) - 2))


def _first(round_: Column, form, taken: list[Column]) -> Column:
    """Position, from 1, of the first group of the form that isn't taken; 0 without one."""

    def fits(text: Column, i: Column) -> Column:
        free = form(text)
        for t in taken:
            free = free & (i + 1 != t)
        return free

    return F.coalesce(F.array_position(F.transform(round_, fits), F.lit(True)), F.lit(0)).cast("int")


def _at(round_: Column, position: Column) -> Column:
    return F.when(position > 0, F.get(round_, position - 1)).otherwise("")


def _all_in(text: Column, sign: str, known: list[str]) -> Column:
    return F.forall(F.split(text, sign), lambda p: F.array_contains(_texts(known), F.trim(p)))


def language_code(text: Column) -> Column:
    """En of En-Us; texts of another form as they are, trimmed."""
    parts = F.split(F.trim(text), "-")
    country = F.get(parts, 1)
    return F.when((F.size(parts) == 2) & F.char_length(country).between(2, 4) & country.rlike("^[A-Za-z]+$"), F.get(parts, 0)).otherwise(F.trim(text))


def _languages(text: Column) -> Column:
    return F.forall(F.split(text, "[,+]"), lambda p: F.array_contains(_texts(LANGUAGES), language_code(p)))


def implied_languages(regions: Column) -> Column:
    table = _map({region: language for language, some in IMPLIED.items() for region in some})
    return F.array_distinct(F.array_compact(F.transform(regions, lambda r: F.try_element_at(table, r))))


def video(regions: Column, flags: Column) -> Column:
    """Sorted video standards: those of the first video tag, else those of the regions."""
    tag = F.get(F.filter(flags, lambda f: f.isin(*VIDEO_TAGS)), F.lit(0))
    told = F.when(tag.isin("PAL-NTSC", "NTSC-PAL"), _texts(["NTSC", "PAL"])).when(tag == "MPAL", _texts(["NTSC"])).when(tag.isNotNull(), F.array(tag))
    each = F.transform(regions, lambda r: F.when(r == "World", _texts(["NTSC", "PAL"])).when(r.isin(*PAL), _texts(["PAL"])).when(r.isin(*NTSC), _texts(["NTSC"])).otherwise(F.array().cast("array<string>")))
    return F.coalesce(told, F.array_sort(F.array_distinct(F.flatten(each))))


def _rest(round_: Column, taken: list[Column]) -> Column:
    def free(_, i: Column) -> Column:
        kept = F.lit(True)
        for t in taken:
            kept = kept & (i + 1 != t)
        return kept

    return F.filter(round_, free)


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"\.[A-Za-z0-9]{1,5}$", ""), r"(?<=[)\]])\.+$", "")


def _steps(df: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """Adds columns one after the other: what several later ones use is computed once."""
    for name, column in columns:
        df = df.withColumn(name, column)
    return df


def _dropped(df: DataFrame, before: list[str], out: str) -> DataFrame:
    return df.select(*before, out)


def parse_disc(df: DataFrame, name: str, out: str, category: str | None = None) -> DataFrame:
    """The same layout for discs, with the category their catalogue gives them (null: none)."""
    return parse_region_first(df, name, out, DISC, F.coalesce(F.col(category), F.lit("")) if category else F.lit(""))


def parse_region_first(df: DataFrame, name: str, out: str, style: str = REGION_FIRST, category: Column | None = None) -> DataFrame:
    """Adds struct ``out`` of the layout ``Title (Region) (Languages) (Version) (Status) (flags)[dump flags]``."""
    c, before = F.col, df.columns
    category = F.lit("") if category is None else category
    none = none_of_text()
    df = _steps(
        df,
        ("_base", _bare(c(name))),
        ("_lead", F.regexp_extract("_base", r"^((?:\[[^\[\]]*\]\s*)+)(?=.)", 1)),
        ("_name", F.substring(c("_base"), F.char_length("_lead") + 1, F.char_length("_base"))),
        *group_steps(c("_name")),
        ("_all", c("_round")),
        ("_found", _first(c("_all"), lambda t: _all_in(t, ", ", PAL + NTSC + NEUTRAL), [])),
        # plain groups before the region belong to the title
        ("_before", F.when(c("_found") > 1, F.slice("_all", F.lit(1), F.greatest(c("_found") - 1, F.lit(0)))).otherwise(none)),
        ("_title", F.concat_ws(" ", F.array("_whole"), F.transform("_before", lambda t: F.concat(F.lit("("), t, F.lit(")"))))),
        ("_round", F.when(c("_found") > 1, F.slice("_all", F.greatest(c("_found"), F.lit(1)), F.size("_all"))).otherwise(c("_all"))),
        ("_r", F.least("_found", F.lit(1))),
        ("_l", _first(c("_round"), _languages, [c("_r")])),
        ("_v", _first(c("_round"), lambda t: F.forall(F.split(t, ", "), is_version), [c("_r"), c("_l")])),
        ("_s", _first(c("_round"), is_status, [c("_r"), c("_l"), c("_v")])),
        ("_regions", F.filter(F.split(_at(c("_round"), c("_r")), ", "), lambda r: r != "")),
        ("_told", F.filter(F.split(_at(c("_round"), c("_l")), "[,+]"), lambda p: p != "")),
        ("_flags", F.concat(F.filter(F.transform("_told", lambda p: F.trim(p)), lambda p: p.contains("-")), _rest(c("_round"), [c("_r"), c("_l"), c("_v"), c("_s")]))),
        ("_dump", F.concat(square_groups(c("_lead")), c("_square"))),
    )
    tags = F.struct(
        c("_title").alias("title"),
        c("_regions").alias("regions"),
        F.when(c("_l") > 0, F.array_distinct(F.transform("_told", language_code))).otherwise(implied_languages(c("_regions"))).alias("languages"),
        (c("_l") == 0).alias("languages_implied"),
        newest_version(_at(c("_round"), c("_v"))).alias("version"),
        _at(c("_round"), c("_s")).alias("status"),
        c("_flags").alias("flags"),
        c("_dump").alias("dump_flags"),
        F.exists("_dump", is_bad).alias("bad"),
        F.exists("_dump", lambda f: F.upper(f) == "BIOS").alias("bios"),
        video(c("_regions"), c("_flags")).alias("video"),
        F.lit(style).alias("style"),
        F.lit("").alias("date"),
        F.lit("").alias("publisher"),
        F.lit(0).alias("build"),
        category.alias("category"),
    )
    return _dropped(df.withColumn(out, tags), before, out)


def parse_dated(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds struct ``out`` of the layout ``Title v1.0 (Status)(Date)(Publisher)(Country)(language)(flags)[dump flags]``."""
    c, before = F.col, df.columns
    of_language = lambda p: (p == F.lower(p)) & F.array_contains(_texts(LANGUAGES), F.initcap(p))
    of_country = lambda p: F.array_contains(_texts(list(COUNTRIES)), p)
    taken = [c("_d"), c("_p"), c("_s")]
    df = _steps(
        df,
        ("_base", _bare(c(name))),
        *group_steps(c("_base")),
        ("_dump", c("_square")),
        *title_version_steps(c("_whole")),
        ("_d", _first(c("_round"), is_date, [])),
        ("_p", F.when((c("_d") > 0) & (c("_d") < F.size("_round")), c("_d") + 1).otherwise(0)),
        ("_s", _first(c("_round"), is_dated_status, taken[:2])),
        ("_r", _first(c("_round"), lambda t: F.forall(F.split(t, "-"), of_country), taken)),
        ("_l", _first(c("_round"), lambda t: F.forall(F.split(t, "-"), of_language), [*taken, c("_r")])),
        ("_regions", F.array_compact(F.transform(F.split(_at(c("_round"), c("_r")), "-"), lambda x: F.try_element_at(_map(COUNTRIES), x)))),
    )
    told = F.transform(F.split(_at(c("_round"), c("_l")), "-"), lambda p: F.initcap(p))
    # the letters behind a version stay with the name as a flag
    listed = F.concat(F.filter(F.array("_cut.letters"), lambda x: x != ""), _rest(c("_round"), [c("_d"), c("_s"), c("_r"), c("_l")]))
    df, flags = df.withColumn("_flags", listed), c("_flags")
    tags = F.struct(
        c("_cut.title").alias("title"),
        c("_regions").alias("regions"),
        F.when(c("_l") > 0, F.array_distinct(told)).otherwise(implied_languages(c("_regions"))).alias("languages"),
        (c("_l") == 0).alias("languages_implied"),
        c("_cut.version").alias("version"),
        _at(c("_round"), c("_s")).alias("status"),
        flags.alias("flags"),
        c("_dump").alias("dump_flags"),
        F.exists("_dump", is_bad).alias("bad"),
        F.exists("_dump", lambda f: F.upper(f) == "BIOS").alias("bios"),
        video(c("_regions"), flags).alias("video"),
        F.lit(DATED).alias("style"),
        _at(c("_round"), c("_d")).alias("date"),
        _at(c("_round"), c("_p")).alias("publisher"),
        F.lit(0).alias("build"),
        F.lit("").alias("category"),
    )
    return _dropped(df.withColumn(out, tags), before, out)


def _letters_value(text: Column) -> Column:
    """Letters as a number: A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64))


def version_key(version: Column, widths: Column | None = None) -> Column:
    """array<bigint> that orders versions: none, then revisions and v numbers; v2.0-beta sorts before v2.0.

    ``[0]`` for none and ``[1, 0]`` for texts of another form. Letters count from a = 1. ``widths`` is a map
    from the place of a dotted part (from 0) to digits: such parts are read as decimal fractions. A number of
    more than 18 digits counts as the largest one of 18.
    """
    one, none = F.array(F.lit(1).cast("long")), F.array().cast("array<bigint>")
    other = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))

    def number(x: Column) -> Column:
        return F.coalesce(F.when(F.char_length(F.ltrim(x, F.lit("0"))) > 18, F.lit(10**18 - 1)).otherwise(x.try_cast("long")), F.lit(0).cast("long"))

    def numbers(t: Column) -> Column:
        return F.transform(F.split(t, "[.]"), number)

    def revision(low: Column, body: Column) -> Column:
        first_number, then_letters = F.regexp_extract(body, "^([0-9]+)[a-z]+$", 1), F.regexp_extract(body, "^[0-9]*([a-z]+)$", 1)
        spelled = low.rlike("^rev[ -]")
        return (
            F.when(dotted(body) & ~F.startswith(low, F.lit("rev-")), F.concat(one, numbers(body)))
            .when(spelled & body.rlike("^[0-9]+$"), F.concat(one, F.array(number(body))))
            .when(spelled & (first_number != ""), F.concat(one, F.array(number(first_number), _letters_value(F.upper(then_letters)))))
            .when(spelled & body.rlike("^[a-z]+$"), F.concat(one, F.array(_letters_value(F.upper(body)))))
        )

    # v numbers: dotted parts, a letter, then either a stage or a revision
    def v_number(later: Column, pieces: Column, first: Column) -> Column:
        digits, letter = F.regexp_replace(first, "[a-z]$", ""), F.regexp_extract(first, "([a-z])$", 1)
        tail = F.coalesce(F.get(pieces, 1), F.lit(""))
        stage = F.regexp_replace(tail, "[0-9]+$", "")
        parts = F.split(digits, "[.]")
        if widths is not None:
            parts = F.transform(parts, lambda x, i: F.when(F.try_element_at(widths, i).isNotNull(), F.rpad(x, F.greatest(F.try_element_at(widths, i), F.char_length(x)), F.lit("0"))).otherwise(x))
        values = F.concat(F.transform(parts, number), F.when(letter != "", F.array((F.ascii(letter) - 96).cast("long"))).otherwise(none))
        early = lambda v: F.concat(F.slice(v, F.lit(1), F.size(v) - 1), F.array(F.element_at(v, -1) - 1), F.array(F.lit(1_000_000) + F.array_position(_texts(STAGES), stage), number(F.regexp_extract(tail, "([0-9]*)$", 1))))
        good = dotted(digits) & (F.size(pieces) <= 2) & ((tail == "") | stage.isin(*STAGES))
        return F.when(good, let(values, lambda v: F.when(later != "", F.concat(one, v, F.array(F.lit(0).cast("long")), numbers(later))).when(tail != "", F.concat(one, early(v))).otherwise(F.concat(one, v)))).otherwise(other)

    def of_number(low: Column, later: Column) -> Column:
        head = F.trim(F.when(later != "", F.regexp_replace(low, "(?:rev|r) ?[0-9][0-9.]*$", "")).otherwise(low))
        pieces = F.split(F.substring(head, 2, F.char_length(head)), "-")
        return let(pieces, lambda p: let(F.get(p, 0), lambda first: v_number(later, p, first)))

    def key(low: Column) -> Column:
        body = F.trim(F.regexp_replace(low, "^(?:rev[ -]?|r)", ""))
        of_revision = let(body, lambda b: F.when(low != b, F.coalesce(revision(low, b), other)).otherwise(other))
        later = F.regexp_extract(low, "(?:rev|r) ?([0-9][0-9.]*)$", 1)
        return F.when(low == "", F.array(F.lit(0).cast("long"))).when(F.startswith(low, F.lit("r")), of_revision).when(F.startswith(low, F.lit("v")), let(later, lambda x: of_number(low, x))).otherwise(other)

    return let(F.lower(F.trim(F.coalesce(version, F.lit("")))), key)


def newest_version(group: Column) -> Column:
    """Of the versions of one group, parted by commas, the highest."""
    ranked = F.transform(F.split(group, ", "), lambda x: F.struct(version_key(x).alias("k"), x.alias("v")))
    return F.when(F.contains(group, F.lit(", ")), F.element_at(F.array_sort(ranked), -1)["v"]).otherwise(group)


# ---- exclusion rules


def _word_rule(word: Column, table: dict[str, list[str]]) -> Column:
    return F.try_element_at(_map({w: rule for rule, words in table.items() for w in words}), word)


def round_rules(text: Column, style: Column | str = DATED) -> Column:
    """Rules of a round group, each once: of the words between its commas, without a number behind them."""
    style = F.lit(style) if isinstance(style, str) else style

    def rule(part: Column) -> Column:
        word = without_number(F.lower(F.trim(part)))
        trial = F.regexp_replace(word, " disc$", "").isin(*TRIAL_WORDS) | begins_with_word(word, "trial")
        common = F.coalesce(_word_rule(word, ROUND_WORDS), F.when(F.startswith(word, F.lit("demo-")), "demo"))
        return F.when(style == ARCHIVE, _word_rule(word, ARCHIVE_WORDS)).when((style == DISC) & trial, "demo").otherwise(common)

    return F.array_distinct(F.array_compact(F.transform(F.split(text, ", "), rule)))


def square_rule(text: Column) -> Column:
    """The rule of a square group, by its code or first words; codes and most words are in lower case."""
    low = F.lower(text)
    alternate = coded(low, "a") & F.regexp_replace(low, r"^a[0-9]*\s+", "").rlike(r"^bad\s?dump\b")
    found = F.lit(None).cast("string")
    for rule in reversed(["bad_dump", "virus", "bad_size", "modified", "faked", "unreleased", "pre_release", "prototype", "demo"]):
        tests = [coded(text, x) for x in SQUARE_CODES.get(rule, [])] + [begins_with_word(text, x) for x in SQUARE_WORDS.get(rule, [])] + [begins_with_word(low, x) for x in SQUARE_WORDS_ANY_CASE.get(rule, [])]
        found = F.when(_either(tests + [alternate] * (rule == "bad_dump")), rule).otherwise(found)
    return found


def token_rule(kind: Column, text: Column, style: Column | str = DATED) -> Column:
    """The rule of one tag: ``kind`` is ( or [. Archives have no square flags."""
    style = F.lit(style) if isinstance(style, str) else style
    return F.when(kind == "(", F.get(round_rules(text, style), 0)).when(style != ARCHIVE, square_rule(text))


def without_publisher(t: Column) -> Column:
    """Flags without the first one that is the publisher."""
    place = F.array_position(t["flags"], t["publisher"])
    return F.when((t["publisher"] != "") & (place > 0), F.filter(t["flags"], lambda _, i: i + 1 != place)).otherwise(t["flags"])


def exclusion_info(t: Column) -> Column:
    """array<struct<rule, text>>: every excluding tag of a tags struct as it stands in the name, each once."""
    words = F.concat(F.filter(F.array(t["status"]), lambda x: x != ""), without_publisher(t))
    of_round = F.flatten(F.transform(words, lambda x: F.transform(round_rules(x, t["style"]), lambda r: F.struct(r.alias("rule"), F.concat(F.lit("("), x, F.lit(")")).alias("text")))))
    square = F.transform(t["dump_flags"], lambda x: F.struct(token_rule(F.lit("["), x, t["style"]).alias("rule"), F.concat(F.lit("["), x, F.lit("]")).alias("text")))
    listed = F.array(F.struct(F.try_element_at(_map(CATEGORY_RULES), t["category"]).alias("rule"), F.concat(F.lit("(category: "), t["category"], F.lit(")")).alias("text")))
    return F.array_distinct(F.filter(F.concat(of_round, square, listed), lambda x: x["rule"].isNotNull()))


def exclusion_rules(status: Column, flags: Column, dump_flags: Column, style: str = DATED) -> Column:
    """Rules that a name's tags fall under, in the order of the tags, each once."""
    words = F.filter(F.concat(F.array(status), flags), lambda x: x != "")
    square = F.transform(dump_flags, square_rule) if style != ARCHIVE else none_of_text()
    return F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(words, lambda x: round_rules(x, style))), square)))
