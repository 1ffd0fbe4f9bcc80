"""Names of archives: a stem such as ``Title_v1.2_De_AGA_0417`` and the game's name ``Title (German) (AGA)``.

The game's name tells title, state and product; the stem adds version, build number, and words that the
game's name may lack. The stem's words behind the version are folded from the left, as a word "by" takes
those after it as an author's name, up to the next build number or version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flags import MEMORY_SHOWN, memory_tag, spelled
from .tags import ARCHIVE, _map, _steps, dotted, group_steps, none_of_text

# Languages as words of game names and as codes of stems.
LANGUAGE_WORDS = {
    "german": "De", "french": "Fr", "italian": "It", "spanish": "Es", "polish": "Pl", "danish": "Da", "czech": "Cs", "swedish": "Sv", "greek": "El", "finnish": "Fi", "dutch": "Nl", "croatian": "Hr",
    "norwegian": "No", "portuguese": "Pt", "russian": "Ru", "hungarian": "Hu", "turkish": "Tr", "english": "En",
}
LANGUAGE_CODES = {"En": "En", "De": "De", "Fr": "Fr", "It": "It", "Es": "Es", "Pl": "Pl", "Cz": "Cs", "Dk": "Da", "Nl": "Nl", "Se": "Sv", "Gr": "El", "Fi": "Fi", "Hr": "Hr", "Pt": "Pt", "Ru": "Ru", "Hu": "Hu", "Tr": "Tr"}
# Words of stems and the flags they stand for, and states of game names.
STEM_FLAGS = {
    "image": "Image", "files": "Files", "1disk": "One Disk", "2disk": "Two Disk", "3disk": "Three Disk", "4disk": "Four Disk", "cd": "CD-ROM", "nointro": "No Intro", "lores": "Low Res", "hires": "Hi Res",
    "atarist": "ST Port", "altversion": "Alt Version", "publicdomain": "PD", "enhanced": "Enhanced", "arcadia": "Arcadia", "mt32": "MT32", "cdtv": "CDTV", "censored": "Censored", "crunched": "Crunched",
    "nomusic": "No Music", "nospeech": "No Speech", "novoice": "No Voice", "easyplay": "Easy Play", "ecs": "ECS", "ocs": "OCS", "aga": "AGA", "cd32": "CD32", "ntsc": "NTSC", "68020": "68020",
    "68030": "68030", "68040": "68040", "68060": "68060", "hack": "Hack", "fix": "Fix",
}
STATES = ["Beta", "Pre Release", "Preview", "Unreleased", "Game Demo", "Demo"]


def _is_version(word: Column) -> Column:
    """v1.2, V1.4a, v2.1-B."""
    body = F.regexp_replace(F.substring(word, 2, F.char_length(word)), "-[A-Za-z]$", "")
    return F.substring(word, 1, 1).isin("v", "V") & dotted(F.regexp_replace(body, "[a-z]$", ""))


def _is_build(word: Column) -> Column:
    return F.forall(F.split(word, "&"), lambda x: x.rlike("^[0-9]{4}$"))


def _pairs(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest((F.char_length(word) / 2).cast("int") - 1, F.lit(0))), lambda i: F.substring(word, i * 2 + 1, F.lit(2)))


def _languages(word: Column) -> Column:
    """Languages of one word: a code, several codes without a gap, or a word; an empty array for other words."""
    code, several = F.try_element_at(_map(LANGUAGE_CODES), word), F.transform(_pairs(word), lambda x: F.try_element_at(_map(LANGUAGE_CODES), x))
    joined = (F.char_length(word) >= 4) & (F.char_length(word) % 2 == 0) & F.forall(several, lambda x: x.isNotNull())
    told = F.try_element_at(_map(LANGUAGE_WORDS), F.lower(word))
    return F.when(code.isNotNull(), F.array(code)).when(joined, several).when(told.isNotNull(), F.array(told)).otherwise(none_of_text())


def _read_words(words: Column) -> Column:
    """struct(by, author, build, languages, flags, status) of a stem's words behind its version."""
    start = F.struct(F.lit(False).alias("by"), none_of_text().alias("author"), F.lit(0).alias("build"), none_of_text().alias("languages"), none_of_text().alias("flags"), F.lit("").alias("status"))

    def step(s: Column, x: Column) -> Column:
        word, low = x["word"], F.lower(x["word"])
        named = s["by"] & ~_is_build(word) & ~_is_version(word)
        opens = ~named & (low == "by") & ~x["last"]
        build, languages = ~named & ~opens & _is_build(word), F.when(named | opens | _is_build(word), none_of_text()).otherwise(_languages(word))
        plain = ~named & ~opens & ~build & (F.size(languages) == 0)
        beta, early = plain & low.rlike("^beta[0-9]*$"), plain & (low == "prerelease")
        flag = F.when(opens, "Hack").when(plain & ~beta & ~early, F.coalesce(F.try_element_at(_map(MEMORY_SHOWN), low), F.try_element_at(_map(STEM_FLAGS), low)))
        return F.struct(
            (named | opens).alias("by"),
            F.when(opens, none_of_text()).when(named, F.array_append(s["author"], word)).otherwise(s["author"]).alias("author"),
            F.when(build, F.greatest(s["build"], F.array_max(F.transform(F.split(word, "&"), lambda n: n.try_cast("int"))))).otherwise(s["build"]).alias("build"),
            F.concat(s["languages"], languages).alias("languages"),
            F.when(flag.isNotNull(), F.array_append(s["flags"], flag)).otherwise(s["flags"]).alias("flags"),
            F.when(beta, "Beta").when(early & (s["status"] == ""), "Pre Release").otherwise(s["status"]).alias("status"),
        )

    numbered = F.transform(words, lambda w, i: F.struct(w.alias("word"), (i == F.size(words) - 1).alias("last")))
    return F.aggregate(numbered, start, step)


def _joined_flags(own: Column, more: Column) -> Column:
    """The stem's flags behind the game's, without those it has in another spelling or as the same memory."""

    def add(have: Column, f: Column) -> Column:
        same = F.exists(have, lambda x: (spelled(x) == spelled(f)) | ((memory_tag(f) != "") & (memory_tag(x) == memory_tag(f))))
        return F.when(same, have).otherwise(F.array_append(have, f))

    return F.aggregate(more, own, add)


def parse_archive(df: DataFrame, stem: str, game: str, out: str) -> DataFrame:
    """Adds struct ``out``; an empty or null game leaves the stem alone to tell. Without a language word an
    archive is in English; without NTSC it is PAL."""
    c, before = F.col, df.columns
    text = F.trim(F.coalesce(c(stem), F.lit("")))
    told = F.coalesce(c(game), F.lit(""))
    df = _steps(
        df,
        ("_words", F.filter(F.split(F.regexp_replace(text, r"(?i)\.(?:lha|lzx)$", ""), "_"), lambda w: w != "")),
        ("_at", F.coalesce(F.array_position(F.transform("_words", lambda w, i: (i >= 1) & _is_version(w)), F.lit(True)), F.lit(0)).cast("int")),
        ("_own", F.array_join(F.when(c("_at") > 0, F.slice("_words", F.lit(1), F.greatest(c("_at") - 1, F.lit(0)))).otherwise(c("_words")), "_")),
        ("_version", F.when(c("_at") > 0, F.lower(F.replace(F.concat(F.lit("v"), F.substring(F.get("_words", c("_at") - 1), 2, F.char_length(text))), F.lit("-"), F.lit("")))).otherwise("")),
        ("_stem", _read_words(F.when(c("_at") > 0, F.slice("_words", c("_at") + 1, F.size("_words"))).otherwise(F.slice("_words", F.lit(2), F.size("_words"))))),
        *group_steps(told),
        ("_named", F.array_distinct(F.array_compact(F.transform("_round", lambda x: F.try_element_at(_map(LANGUAGE_WORDS), F.lower(x)))))),
        ("_state", F.coalesce(F.array_position(F.transform("_round", lambda x: F.regexp_replace(x, r"\s+[0-9]+$", "").isin(*STATES)), F.lit(True)), F.lit(0)).cast("int")),
        ("_plain", F.filter("_round", lambda x, i: F.try_element_at(_map(LANGUAGE_WORDS), F.lower(x)).isNull() & (i + 1 != c("_state")))),
        ("_product", F.concat("_plain", F.transform("_square", lambda x: F.concat(F.lit("["), x, F.lit("]"))))),
        ("_joined", _joined_flags(c("_product"), c("_stem.flags"))),
        ("_flags", F.when(F.size("_stem.author") > 0, F.array_append("_joined", F.concat(F.lit("by "), F.array_join("_stem.author", "_")))).otherwise(c("_joined"))),
        ("_languages", F.array_distinct(F.concat("_named", "_stem.languages"))),
    )
    tags = F.struct(
        F.when(told != "", c("_whole")).otherwise(c("_own")).alias("title"),
        none_of_text().alias("regions"),
        c("_languages").alias("languages"),
        (F.size("_languages") == 0).alias("languages_implied"),
        c("_version").alias("version"),
        F.when(c("_state") > 0, F.get("_round", c("_state") - 1)).otherwise(c("_stem.status")).alias("status"),
        c("_flags").alias("flags"),
        none_of_text().alias("dump_flags"),
        F.lit(False).alias("bad"),
        F.lit(False).alias("bios"),
        F.when(F.exists("_flags", lambda f: F.lower(F.trim(f)) == "ntsc"), F.array(F.lit("NTSC"))).otherwise(none_of_text()).alias("video"),
        F.lit(ARCHIVE).alias("style"),
        F.lit("").alias("date"),
        F.lit("").alias("publisher"),
        c("_stem.build").alias("build"),
        F.lit("").alias("category"),
    )
    return df.withColumn(out, tags).select(*before, out)


def variant_signature(t: Column) -> Column:
    """What tells variants of one archived game apart: languages, chipset, memory and NTSC (of tags with details)."""
    memory = F.array_sort(F.array_distinct(F.filter(t["memory"], lambda x: x != "")))
    return F.struct(F.array_sort(t["languages"]).alias("languages"), t["chipset"].alias("chipset"), memory.alias("memory"), F.array_contains(t["video"], "NTSC").alias("ntsc"))
