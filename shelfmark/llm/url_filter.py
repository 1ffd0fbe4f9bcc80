"""URL filter: rules first, then host word segmentation and naive Bayes.

Names in hosts and paths are cut into words by a unigram Viterbi search; the unigram counts are of all
words in the pages' text. A multinomial naive Bayes over the words of host and path gives the verdict
where no rule does. It learns from all pages. Nobody has reviewed pages of the tables, so a page counts as
one to block if its text has several words of a seed list, or if its host, once segmented, has one; every
other word that comes with such pages gets its odds from them.

Counts, vocabulary and odds are tables, joined in Spark: each distinct name meets the counts of its own
parts alone, so no vocabulary is held by a task or the driver, and none is cut off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, saved, table

#: Rules as (host, path, verdict): a host and its subdomains, and the beginning of the path.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Words that mark a page as one to block, for lack of reviewed labels, and how many of them in its text do.
SEEDS = ("adult", "bet", "bets", "betting", "casino", "escort", "gambling", "hack", "jackpot", "loan", "loans", "lottery", "malware", "phish", "phishing", "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx")
LEAST_SEEDS = 3
#: Greatest length of a word of the unigram model; longer runs of letters are names made of several words.
LONGEST = 20
NUMBER = "<number>"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://, or an empty text."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A to Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule (host and path together) that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def text_words(html: Column) -> Column:
    """The words, runs of a to z of LONGEST letters at most, of a page's text in lower case."""
    text = F.regexp_replace(F.lower(F.coalesce(html, F.lit(""))), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return F.regexp_extract_all(text, F.lit(f"(?<![a-z])[a-z]{{1,{LONGEST}}}+(?![a-z])"), F.lit(0))


def names_of(text: Column) -> Column:
    """Runs of letters a to z of a host or path in lower case; NUMBER for each run of digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), NUMBER).otherwise(x))


@dataclass(frozen=True)
class Unigrams:
    """Costs of words (minus log probability), and the cost of a letter outside of words."""

    costs: dict[str, float]
    letter: float

    def segment(self, name: str) -> list[str]:
        """The cheapest cut of a lower-case name into words and single letters outside of words."""
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            choices = [(best[end - 1] + self.letter, end - 1)]
            for start in range(max(0, end - LONGEST), end):
                cost = self.costs.get(name[start:end])
                if cost is not None:
                    choices.append((best[start] + cost, start))
            cost, start = min(choices)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]

    def words(self, name: str) -> list[str]:
        """The words of a name; letters outside of words that stand together are one word of their own."""
        out, open_ = [], False
        for part in self.segment(name):
            known = part in self.costs
            if open_ and not known:
                out[-1] += part
            else:
                out.append(part)
            open_ = not known
        return out


def word_counts(pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """word, n: how often each word stands in all pages' text; each seed counts once more, so it is a word."""
    spoken = pages.select(F.explode(text_words(F.col("html"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = pages.sparkSession.createDataFrame([(x, 1) for x in seeds], "word string, n long")
    return spoken.unionByName(own).groupBy("word").agg(F.sum("n").alias("n"))


def _cut(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = []
        for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            costs = {p["word"]: -math.log(p["n"] / total) for p in parts or ()}
            words.append([name] if name == NUMBER else Unigrams(costs, math.log(total) + 5).words(name))
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(words, pa.list_(pa.string()))], names=["name", "words"])


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name and its words, for distinct ``names(name)`` and saved ``counts(word, n)``.

    Parts of up to LONGEST letters of each name are joined with the counts; what a task holds of a name
    are the parts that are words.
    """
    total = (counts.agg(F.sum("n")).first()[0] or 0) + 1
    own = saved(names.withColumn("nid", F.monotonically_increasing_id()), "names")
    tails = own.where(F.col("name") != NUMBER).select("nid", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("name")), lambda i: F.substring(F.col("name"), i, F.lit(LONGEST))))).alias("tail"))
    pieces = tails.select("nid", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("tail")), lambda i: F.left(F.col("tail"), i))).alias("word"))
    parts = pieces.hint("merge").join(counts, "word").groupBy("nid").agg(F.collect_set(F.struct("word", "n")).alias("parts"))
    cut = own.hint("merge").join(parts, "nid", "left").select("name", "parts")
    return in_arrow(cut, partial(_cut, total=total), "name string, words array<string>")


def with_words(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """uid, host_words, words (of host and path, in order) of saved ``urls(uid, host, path)``."""
    each = urls.select("uid", F.size(names_of(F.col("host"))).alias("of_host"), F.posexplode(F.concat(names_of(F.col("host")), names_of(F.col("path")))).alias("place", "name"))
    each = saved(each, "url-names")
    names = saved(segmented(each.select("name").distinct(), counts), "name-words")
    # two saved tables, so a name that very many urls have can be split among tasks
    found = each.hint("merge").join(names, "name").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("place", "of_host", "words"))).alias("all"))
    return found.select("uid", F.flatten(F.transform(F.filter("all", lambda x: x["place"] < x["of_host"]), lambda x: x["words"])).alias("host_words"), F.flatten(F.transform("all", lambda x: x["words"])).alias("words"))


def word_odds(urls: DataFrame) -> tuple[DataFrame, float]:
    """word and log odds of blocking, and the prior log odds, from ``urls(words, block)``; all rows count.

    Counts are smoothed by one. Without a url to block the odds are 0 and the prior is -1.
    """
    size = urls.agg(F.count_if("block").alias("block"), F.count_if(~F.col("block")).alias("allow")).first()
    counted = urls.select(F.explode("words").alias("word"), F.col("block").cast("long").alias("b")).groupBy("word").agg(F.sum("b").alias("block"), F.sum(1 - F.col("b")).alias("allow"))
    counted = saved(counted, "word-labels")
    if not size["block"]:
        return counted.select("word", F.lit(0.0).alias("odds")), -1.0
    whole = counted.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("n")).first()
    block, allow, n = (whole[x] or 0 for x in ("block", "allow", "n"))
    odds = F.log((F.col("block") + 1) / (block + n + 1)) - F.log((F.col("allow") + 1) / (allow + n + 1))
    return counted.select("word", odds.alias("odds")), math.log((size["block"] + 1) / (size["allow"] + 1))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, seeds: tuple[str, ...] = SEEDS, labels: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, host_words, block_score of each row of ``pages``.

    ``labels`` is a reviewed label over the columns of ``pages``, true for a page to block; by default
    the evidence of the seeds. A null url, or one without ://, has an empty host and path, no rule and
    the verdict allow. The longest rule wins; without one a positive score blocks. Without a page to learn
    blocking from, nothing is blocked by the method. Null ids stay null; repeated rows each get their
    row; an empty table gives no rows; other columns are not read.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    listed = F.size(F.array_intersect(text_words(F.col("html")), F.array(*map(F.lit, seeds)))) >= LEAST_SEEDS if labels is None else F.coalesce(labels, F.lit(False))
    urls = saved(pages.select(F.monotonically_increasing_id().alias("uid"), "page_id", host_of(url).alias("host"), path_of(url).alias("path"), listed.alias("listed")), "urls")
    counts = saved(word_counts(pages, seeds), "word-counts")
    words = with_words(urls, counts)
    seeded = F.arrays_overlap("host_words", F.array(*map(F.lit, seeds))) if labels is None else F.lit(False)
    known = saved(words.hint("merge").join(urls.select("uid", "listed"), "uid").withColumn("block", F.col("listed") | seeded), "url-words")
    odds, prior = word_odds(known)
    score = known.select("uid", F.explode("words").alias("word")).hint("merge").join(odds, "word").groupBy("uid").agg((F.sum("odds") + prior).alias("block_score"))
    judged = urls.hint("merge").join(known.select("uid", F.concat_ws(" ", "host_words").alias("host_words")), "uid", "left").hint("merge").join(score, "uid", "left")
    judged = judged.withColumns({"host_words": F.coalesce("host_words", F.lit("")), "block_score": F.coalesce("block_score", F.lit(prior))})
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when((F.col("block_score") > 0) & (F.col("host") != ""), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "host_words", "block_score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by the fixed rules and the method, as ``judge_urls`` defines it."""
    return judge_urls(table(spark, sf_dir, "pages"))
