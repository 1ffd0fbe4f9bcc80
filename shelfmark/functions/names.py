"""Scalar expressions over names, versions, dates and hashes, all as native columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roman numerals that are read as digits in titles. V and X are words as well, so they stay.
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12"}
# Roman numerals that count as numbers where titles are told apart; v and x only behind the first word.
NUMERALS = ROMAN | {"v": "5", "x": "10", "xiii": "13", "xiv": "14", "xv": "15"}
# Leading or trailing articles.
ARTICLES = ("the", "a", "an")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ext(name: Column | str) -> Column:
    """The name without an extension of up to five letters and digits."""
    return F.regexp_replace(_col(name), r"\.[A-Za-z0-9]{1,5}$", "")


def hex_digest(value: Column | str, width: int) -> Column:
    """A hex number in lower case without 0x, with leading zeros up to ``width``; longer ones stay whole."""
    digits = F.regexp_replace(F.lower(F.trim(_col(value))), "^0x", "")
    return F.when(F.coalesce(digits, F.lit("")) == "", "").when(F.char_length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))


def int_or_zero(value: Column | str) -> Column:
    return F.coalesce(F.trim(_col(value)).try_cast("bigint"), F.lit(0))


def date_parts(text: Column | str) -> Column:
    """Year, month and day of a partial date as an array, as far as told (199x, 1990-05, 1990-05-??); null for other texts.

    A year has four signs and the others two, each a digit or, unknown, an x or a question mark."""
    parts = F.split(F.lower(_col(text)), "-")

    def told(part: Column, signs: int) -> Column:
        return (F.char_length(part) == signs) & (F.translate(part, "0123456789x?", "") == "")

    later = F.slice(parts, F.lit(2), F.size(parts))
    return F.when(told(F.get(parts, 0), 4) & (F.size(parts) <= 3) & F.forall(later, lambda x: told(x, 2)), parts)


def date_key(date: Column | str) -> Column:
    """A partial date that can be compared: unknown digits count as 0."""
    return F.translate(F.lower(_col(date)), "x?", "00")


def version_parts(version: Column | str) -> Column:
    """The dotted numbers of a version; arrays of them compare as versions do. [0] without a number."""
    numbers = F.regexp_extract_all(_col(version), F.lit("[0-9]+"), F.lit(0))
    return F.when(F.size(numbers) > 0, F.transform(numbers, lambda n: n.try_cast("decimal(38,0)"))).otherwise(F.array(F.lit(0).cast("decimal(38,0)")))


@F.pandas_udf(T.StringType())
def _folded_signs(text: pd.Series) -> pd.Series:
    def fold(t: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()

    return text.map(fold, na_action="ignore")


def folded(text: Column | str) -> Column:
    """Compatibility forms taken apart, marks dropped, case folded; null stays null. Spark has no function for the
    first, so texts with signs beyond ASCII go to Python, and only those."""
    plain = ~_col(text).rlike(r"[^\x00-\x7F]")
    return F.when(plain, F.lower(_col(text))).otherwise(_folded_signs(F.when(~plain, _col(text))))


#: Dashes that part a title into segments.
_DASHES = (" - ", " \u2013 ", " \u2014 ")


def _without_article(segment: Column) -> Column:
    """A segment without the article behind its last comma, else without the one that is its first word."""
    text = F.trim(segment)
    last, first = F.substring_index(text, ",", -1), F.substring_index(text, " ", 1)
    behind = F.contains(text, F.lit(",")) & F.trim(last).isin(*ARTICLES)
    front = first.isin(*ARTICLES) & (first != text)
    size = F.char_length(text)
    return F.when(behind, F.left(text, size - F.char_length(last) - 1)).when(front, F.substring(text, F.char_length(first) + 2, size)).otherwise(text)


def title_key(title: Column | str) -> Column:
    """A title as compared: folded, & as and, without apostrophes, other signs as one space, and each segment
    (parted by a dash between spaces, a colon before a space, or a slash) without its article; null is empty."""
    text = F.regexp_replace(F.replace(folded(F.coalesce(_col(title), F.lit(""))), F.lit("&"), F.lit(" and ")), r"\s+", " ")
    text = F.regexp_replace(F.replace(text, F.lit(": "), F.lit("\n")), " ?/ ?", "\n")
    for sign in _DASHES:
        text = F.replace(text, F.lit(sign), F.lit("\n"))
    kept = F.array_join(F.transform(F.split(text, "\n"), _without_article), " ")
    return F.trim(F.regexp_replace(F.translate(kept, "'\u2019\u2018`\u00b4", ""), "[^0-9a-z]+", " "))


def _mapped(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def roman_key(key: Column | str) -> Column:
    """The key with roman numerals as digits, word by word."""
    return F.array_join(F.transform(F.split(_col(key), " "), lambda w: F.coalesce(F.try_element_at(_mapped(ROMAN), w), w)), " ")


def number_signature(key: Column | str) -> Column:
    """The numbers of a key in order, roman ones included, without leading zeros."""
    words = F.split(_col(key), " ")
    first = F.get(words, 0)

    def number(w: Column) -> Column:
        numeral = F.when(w.isin("v", "x") & (w == first), None).otherwise(F.try_element_at(_mapped(NUMERALS), w))
        return F.when(w.rlike("^[0-9]+$"), F.regexp_replace(w, "^0+(?=.)", "")).otherwise(numeral)

    return F.array_compact(F.transform(words, number))


def bracket_groups(name: Column | str) -> Column:
    """Texts of the [square] groups of a name, in order."""
    return F.regexp_extract_all(_col(name), F.lit(r"\[([^\[\]]*)\]"), F.lit(1))


def disk_position(name: Column | str) -> Column:
    """struct(number, total) of a (Disk n of m) or (Disc n) group; nulls without one. Letters count from A = 1."""
    text = _col(name)
    number = F.regexp_extract(text, r"(?i)\((?:disk|disc|side|part) ([0-9]+|[A-Z])(?: of [0-9]+)?\)", 1)
    total = F.regexp_extract(text, r"(?i)\((?:disk|disc|side|part) [0-9A-Z]+ of ([0-9]+)\)", 1)
    value = F.when(number.rlike("^[0-9]+$"), number.try_cast("int")).when(number != "", F.ascii(F.upper(number)) - 64)
    return F.struct(value.alias("number"), total.try_cast("int").alias("total"))


def is_bad_dump(name: Column | str) -> Column:
    """Whether a [b], [b2], [b text] flag stands in the name."""
    return F.exists(bracket_groups(name), lambda g: g.rlike("^b[0-9]*( .*)?$"))


def safe_filename(name: Column | str) -> Column:
    """A file name that every file system takes: forbidden signs as _, no dots or spaces at the end, no device names."""
    clean = F.regexp_replace(_col(name), r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(clean, r"[. ]+$", "")
    device = clean.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)")
    return F.when(clean == "", "_").when(device, F.concat(F.lit("_"), clean)).otherwise(clean)


def digest_or_null(value: Column | str) -> Column:
    """Unknown hashes are null, so that unknown never equals unknown."""
    return F.nullif(F.lower(F.trim(_col(value))), F.lit(""))


def equal_if_known(a: Column | str, b: Column | str) -> Column:
    """True or false where both hashes are known, else null."""
    return digest_or_null(a) == digest_or_null(b)


def folder_of(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
