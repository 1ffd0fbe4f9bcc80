"""Similar titles, by blocks of shared words; titles with a long rare word by pieces of that word."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.names import number_signature
from shelfmark.sources.work import saved

# Least similarity, least distance to the runner-up, greatest difference of lengths, shortest word and key.
LEAST, GAP, LENGTHS = 0.92, 0.04, 0.20
SHORTEST_WORD, SHORTEST_KEY = 4, 7
#: Titles of a common word that one task compares with at most, on average.
SHARE_OF_WORD = 1000
#: A word of so many signs that at most SHARE_OF_WORD titles have is cut into pieces, one for each sign that may differ, of so many signs.
LONG_WORD, SHORTEST_PIECE, LONGEST_PIECE = 16, 3, 6
#: Where at most so many signs of the long word differ, longer pieces of so many signs are enough; of each, one gram is looked up.
FEW, SPAN, GRAM = 3, 8, 6
#: Stands for each sign of a long rare word in the form of a title.
ANY = "\x01"


def similarity(found: str, key: str) -> float:
    """Twice the signs in matching blocks (longest first), as a share of both lengths; 0 if bounds rule LEAST out."""
    m = difflib.SequenceMatcher(None, found, key, autojunk=False)
    return m.ratio() if m.real_quick_ratio() >= LEAST and m.quick_ratio() >= LEAST else 0.0


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(similarity=[similarity(f, k) for f, k in zip(batch.found, batch.key, strict=True)])


def unmatched(part: str, form: str) -> int:
    """The fewest signs of ``part`` and of a beginning of ``form`` that have no equal in the other, in order (by the
    longest common subsequence, a bit for each sign of ``part``); ANY is equal to every sign of a word."""
    n, masks = len(part), dict.fromkeys(part, 0)
    for i, sign in enumerate(part):
        masks[sign] |= 1 << i
    full = (1 << n) - 1
    free, signs = masks.get(ANY, 0), full & ~masks.get(" ", 0)
    rest, best = full, n
    for i, sign in enumerate(form, 1):
        if i - n >= best:
            break
        same = rest & (signs if sign == ANY else masks.get(sign, 0) | (free if sign != " " else 0))
        rest = ((rest + same) | (rest - same)) & full
        best = min(best, n + i - 2 * (n - rest.bit_count()))
    return best


def _outside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        before = [unmatched(o[:s], p) for o, s, p in zip(batch.owner_form, batch.start, batch.other_form, strict=True)]
        behind = [unmatched(o[s + n :][::-1], p[::-1]) for o, s, n, p in zip(batch.owner_form, batch.start, batch.length, batch.other_form, strict=True)]
        yield batch.assign(outside=[x + y for x, y in zip(before, behind, strict=True)])


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: (F.char_length(w) >= SHORTEST_WORD) & ~w.rlike("^[0-9]+$")))


def _pairs_of_signs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - 1, F.lit(1))), lambda i: F.xxhash64(F.substring(text, i, F.lit(2))))


def _listed(df: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """A row for each title of ``df(plat, key)`` with a word that pairs may share: id, plat, text, numbers, words (the
    rarest first, those that no found title has left out), w (the same with their counts), and what pieces need: the form
    (the title with ANY for the signs of long rare words) and signatures."""
    own = df.withColumnRenamed("key", "text").distinct().withColumn("word", F.explode(_words(F.col("text"))))
    told = [F.first(c).alias(c) for c in df.columns if c not in ("plat", "key")]
    w = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "parts"))).alias("w")
    known = own.join(counts.hint("merge"), ["plat", "word"], "left").groupBy("plat", "text").agg(w, *told)
    rare = lambda x: (x["n"] <= SHARE_OF_WORD) & (F.char_length(x["word"]) >= LONG_WORD)
    # the longest of the rare words
    longest = F.array_max(F.transform(F.filter("w", rare), lambda x: F.struct(F.char_length(x["word"]).alias("size"), x["word"].alias("word"))))
    rows = known.withColumns({"size": F.char_length("text"), "long": longest["word"], "pairs": _pairs_of_signs(F.col("text")), "all": F.split("text", " "), "hidden": F.transform(F.filter("w", rare), lambda x: x["word"])})
    form = F.array_join(F.transform("all", lambda x: F.when(F.array_contains("hidden", x), F.repeat(F.lit(ANY), F.char_length(x))).otherwise(x)), " ")
    half = lambda n: F.aggregate("pairs", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(F.when(F.pmod(x, F.lit(128)) >= 64, F.lit(n)).otherwise(F.lit(1 - n)).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))))
    return saved(
        rows.select(
            F.monotonically_increasing_id().alias("id"), "plat", "text", number_signature("text").alias("numbers"), F.filter("w", lambda x: x["n"] > 0).alias("w"),
            "size", "long", F.array_position("all", F.col("long")).cast("int").alias("nth"), form.alias("form"), half(0).alias("even"), half(1).alias("odd"), *[c for c in df.columns if c not in ("plat", "key")],
        ),
        f"fuzzy-{name}",
    )


def _cut(known: DataFrame) -> DataFrame:
    """Adds to ``known`` (with largest: the size of the longest title asked for on its platform) most, the signs that may
    differ in a pair, piece, the size of pieces (null without a long rare word, or if it is too short for as many pieces),
    and the word's start and length."""
    other = F.least("largest", F.floor(F.col("size") * ((2 - LEAST) / LEAST) + 1e-6))
    most = F.floor((F.col("size") + other) * (1 - LEAST) + 1e-6).cast("int")
    before = F.array_join(F.slice(F.split("text", " "), F.lit(1), F.col("nth") - 1), " ")
    rows = known.withColumns({"most": most, "length": F.char_length("long"), "start": F.char_length(before) + F.when(F.col("nth") > 1, 1).otherwise(0)})
    piece = F.least(F.floor(F.col("length") / F.col("most")), F.lit(LONGEST_PIECE)).cast("int")
    return rows.withColumn("piece", F.when(F.col("long").isNotNull() & (F.col("most") > 0) & (piece >= SHORTEST_PIECE), piece))


def _by_words(owners: DataFrame, others: DataFrame) -> DataFrame:
    """owner, other: pairs at their rarest common word, of owners without a long rare word. The titles of a word that
    many share are dealt out among tasks."""
    row = lambda df, name: df.select("plat", "numbers", F.col("id").alias(name), F.col("size").alias(f"{name}_size"), "text", F.transform("w", lambda x: x["word"]).alias(f"{name}_words"), F.inline("w"))
    paired = lambda df, name: df.withColumn(f"{name}_bigrams", F.array_distinct(_pairs_of_signs(F.col("text")))).drop("text")
    probe = row(owners.where("piece is null"), "owner")
    on = ["plat", "word", "numbers"]
    wanted = saved(probe.select(*on).distinct(), "fuzzy-words")
    probe = paired(probe, "owner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    against = paired(row(others, "other").join(wanted, on, "left_semi"), "other").withColumn("part", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int")).drop("n", "parts")
    rarest = F.get(F.array_intersect("owner_words", "other_words"), 0) == F.col("word")
    return probe.hint("merge").join(against, [*on, "part"]).where(rarest & _near("owner", "other")).select("owner", "other")


def _signs(a: str, b: str) -> Column:
    """The signs that may have no equal in a pair of sizes ``a`` and ``b``: their number is odd if that of all signs is."""
    most = F.floor((F.col(a) + F.col(b)) * (1 - LEAST) + 1e-6)
    return (most - F.pmod(most - F.col(a) - F.col(b), F.lit(2))).cast("int")


def _moved(a: str, b: str) -> Column:
    """By how many signs at most an equal stretch stands at another place in the other title of a pair of sizes ``a`` and ``b``."""
    return F.floor((_signs(a, b) + F.abs(F.col(a) - F.col(b))) / 2).cast("int")


def _by_pieces(owners: DataFrame, others: DataFrame) -> DataFrame:
    """owner, other: pairs that a piece of the owner's long word allows, each once.

    Each kind of pieces is looked up and saved by itself, so that the shuffle of one is done with before the next.
    A sign that differs hits one piece at most. If few signs of the word differ, one of a few long pieces stands in the
    other title. Else few signs around the word differ. How many do at least is told by the forms of both titles alone,
    of which there are few where many titles share their common words: so forms are compared, and only titles of forms
    that are near are looked up by short pieces, one more than signs may be left to differ in the word. As many pieces
    as signs may differ at all are cut at most: then either one stands in the other title, moved by no more than as many
    signs, or each is hit by one sign and all around the word is the same; then half of the first piece is whole, in its
    place or moved by one. Signatures (parities of pairs of signs; a sign that differs changes three) drop most of the rest."""
    cut = owners.where("piece is not null")
    gram = lambda x, at, n: F.substring(x, at, n)
    one = lambda df, name, *more: df.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("size", "even", "odd")], *more)
    bounds = F.least("owner_size", "other_size") * 2 >= (F.col("owner_size") + F.col("other_size")) * LEAST
    alike = bounds & (F.bit_count(F.col("owner_even").bitwiseXOR(F.col("other_even"))) + F.bit_count(F.col("owner_odd").bitwiseXOR(F.col("other_odd"))) <= 3 * _signs("owner_size", "other_size"))

    # few signs of the word differ: of each of the long pieces, the least gram; of other titles, the least of any such stretch
    few = F.least("most", F.lit(FEW)).cast("int")
    cut = cut.withColumns({"few": few, "stride": F.floor(F.col("length") / (few + 1)).cast("int")}).withColumn("span", F.least("stride", F.lit(SPAN)).cast("int"))
    size_of_gram = F.least("span", F.lit(GRAM)).cast("int")
    hashes = lambda first, last: F.transform(F.sequence(first, last), lambda i: F.xxhash64("plat", "numbers", gram(F.col("text"), i, size_of_gram)))
    least = F.transform(F.sequence(F.lit(0), F.col("few")), lambda i: F.array_min(hashes(F.col("start") + i * F.col("stride") + 1, F.col("start") + i * F.col("stride") + 1 + F.col("span") - size_of_gram)))
    left = one(cut.withColumn("key", F.explode(F.array_distinct(least))), "owner", "key")
    stretches = others.crossJoin(F.broadcast(cut.select("span").distinct())).where("size >= span").withColumn("h", hashes(F.lit(1), F.col("size") - size_of_gram + 1))
    of_any = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("span") + 1), lambda i: F.array_min(F.slice("h", i, F.col("span") - size_of_gram + 1))))
    right = one(stretches.withColumn("key", F.explode(of_any)), "other", "key")
    pairs = saved(left.hint("merge").join(right, "key").where(alike).select("owner", "other"), "fuzzy-few")

    # forms that are near: what differs around the word leaves more signs than few for the word itself
    block = lambda x: F.when(F.contains(x, F.lit(ANY)), F.lit(ANY * SHORTEST_WORD)).otherwise(x)
    blocks = lambda words: F.array_distinct(F.filter(F.transform(words, block), lambda x: (F.char_length(x) >= SHORTEST_WORD) & ~x.rlike("^[0-9]+$")))
    words, nth = F.split("form", " "), F.col("nth")
    around = F.concat(F.slice(words, F.lit(1), nth - 1), F.slice(words, nth + 1, F.size(words)))
    forms = cut.select("plat", "numbers", "form", "nth", "size", "most", "few", "piece", "start", "length").distinct()
    forms = forms.select("plat", "numbers", F.col("form").alias("owner_form"), "nth", F.col("size").alias("owner_size"), "most", "few", "piece", "start", "length", blocks(around).alias("b"))
    other_forms = others.select("plat", "numbers", F.col("form").alias("other_form"), F.col("size").alias("other_size")).distinct().withColumn("c", blocks(F.split("other_form", " ")))
    common = forms.withColumn("word", F.explode("b")).hint("merge").join(other_forms.withColumn("word", F.explode("c")), ["plat", "numbers", "word"])
    common = common.where((F.get(F.array_intersect("b", "c"), 0) == F.col("word")) & bounds).withColumns({"signs": _signs("owner_size", "other_size"), "moved": _moved("owner_size", "other_size")}).where("signs > few")
    keys = [F.xxhash64("plat", "numbers", "owner_form", "nth").alias("owner_key"), F.xxhash64("plat", "numbers", "other_form").alias("other_key")]
    common = common.select(*keys, "owner_form", "other_form", "most", "few", "piece", "start", "length", "signs", "moved")
    told = common.mapInPandas(_outside, "owner_key long, other_key long, owner_form string, other_form string, most int, few int, piece int, start int, length int, signs int, moved int, outside int")
    near = saved(told.where("signs - outside > few").select("owner_key", "other_key", "piece", F.expr("least(most, signs - outside + 1)").alias("pieces"), F.expr("start + 1 - moved").alias("first"), F.expr("start + 1 + length - piece + moved").alias("last")), "fuzzy-near")
    pieces = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.struct((F.col("start") + i * F.col("piece") + 1).alias("at"), gram(F.col("long"), i * F.col("piece") + 1, F.col("piece")).alias("gram")))
    key = F.xxhash64("other_key", "piece", "g.gram").alias("key")
    left = cut.withColumn("owner_key", F.xxhash64("plat", "numbers", "form", "nth")).join(near.select("owner_key", "other_key", "pieces"), "owner_key").withColumn("g", F.explode(pieces))
    left = one(left, "owner", key, F.col("g.at").alias("at"))
    reach = near.groupBy("other_key", "piece").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    right = others.withColumn("other_key", F.xxhash64("plat", "numbers", "form")).join(reach, "other_key").withColumns({"first": F.greatest(F.col("first"), F.lit(1)), "last": F.least(F.col("last"), F.col("size") - F.col("piece") + 1)}).where("first <= last")
    grams = F.transform(F.sequence(F.col("first"), F.col("last")), lambda i: F.struct(i.alias("at"), gram(F.col("text"), i, F.col("piece")).alias("gram")))
    right = one(right.withColumn("g", F.explode(grams)), "other", key, F.col("g.at").alias("found_at"))
    close = left.hint("merge").join(right, "key").where((F.abs(F.col("at") - F.col("found_at")) <= _moved("owner_size", "other_size")) & alike).select("owner", "other")
    pairs = pairs.union(saved(close, "fuzzy-close"))

    # all around the word is the same: other titles are cut at their words, in every way that leaves enough for the word
    middle = F.floor(F.col("piece") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("half"), gram(F.col("long"), F.lit(1), middle).alias("gram")), F.struct(F.lit(1).alias("half"), gram(F.col("long"), middle + 1, F.col("piece") - middle).alias("gram")))
    every = F.split("text", " ")
    n = F.size(every)
    joined = lambda first, size: F.array_join(F.slice(every, first, size), " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct(F.xxhash64("plat", "numbers", joined(F.lit(1), i - 1), joined(j + 1, n)).alias("around"), joined(i, j - i + 1).alias("within")))))
    within = F.col("s.within")
    moved = F.array(F.struct(F.lit(0).alias("half"), gram(within, F.lit(1), middle).alias("gram")), *[F.struct(F.lit(1).alias("half"), gram(within, middle + 1 + d, F.col("piece") - middle).alias("gram")) for d in (-1, 1)])
    whole = cut.withColumn("around", F.xxhash64("plat", "numbers", joined(F.lit(1), nth - 1), joined(nth + 1, n)))
    arounds = saved(whole.select("around", "piece").distinct(), "fuzzy-around")
    key = F.xxhash64("around", "piece", "g.half", "g.gram").alias("key")
    left = one(whole.withColumn("g", F.explode(halves)), "owner", key)
    spanned = others.withColumn("s", F.explode(F.filter(spans, lambda x: F.char_length(x["within"]) >= F.col("size") * ((2 - 2 * LEAST) * (1 + LEAST / (2 - LEAST))) - 4)))
    right = one(spanned.withColumn("around", F.col("s.around")).join(arounds, "around").withColumn("g", F.explode(F.array_distinct(moved))), "other", key)
    return pairs.union(left.hint("merge").join(right, "key").where(alike).select("owner", "other")).distinct()


def _near(a: str, b: str) -> Column:
    """Whether lengths and common pairs of signs allow the least similarity: of a similarity s, s / 2 of both lengths match, in
    at most as many blocks as signs that don't, and a block of n signs has n - 1 pairs; pairs that a title repeats (or that
    share a hash) are listed once."""
    size, other = F.col(f"{a}_size"), F.col(f"{b}_size")
    repeated = F.least(size - 1 - F.size(f"{a}_bigrams"), other - 1 - F.size(f"{b}_bigrams"))
    near = F.size(F.array_intersect(f"{a}_bigrams", f"{b}_bigrams")) >= (size + other) * (LEAST / 2 - (1 - LEAST)) - 1 - repeated
    return (F.abs(size - other) <= F.greatest(size, other) * LENGTHS) & (F.least(size, other) * 2 >= (size + other) * LEAST) & near


def matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """plat, key of ``left(plat, key)`` with the one key it resembles, its id, and the similarity.

    ``right`` has plat, key and dbid. Candidates are of the same platform, share a word of at least four signs
    that is no number, are of similar length and have the same numbers; they differ in more than a plural s, and
    neither only adds whole words to the other. A key with two candidates of different ids nearly as good has
    none. A known title says how its pairs are found: by pieces of its long rare word if it has one, else by
    common words. All common words are looked at, and a pair is made at its rarest one alone. Pairs whose common pairs of signs are
    too few to reach the least similarity are dropped before their blocks are compared.
    """
    counts = saved(right.select("plat", "key").distinct().select("plat", F.explode(_words(F.col("key"))).alias("word")).groupBy("plat", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / SHARE_OF_WORD).cast("int")), "fuzzy-counts")
    asked = _listed(left.select("plat", "key").where(F.char_length("key") >= SHORTEST_KEY), counts, "asked")
    known = _cut(_listed(right.select("plat", "key").join(F.broadcast(asked.groupBy("plat").agg(F.max("size").alias("largest"))), "plat"), counts, "found"))
    ids = _by_words(known, asked).union(_by_pieces(known, asked))
    pairs = ids.select(F.col("owner").alias("found_id"), F.col("other").alias("key_id"))
    whole = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("plat").alias(f"{name}_plat"), F.col("text").alias(name), F.col("numbers").alias(f"{name}_numbers"), F.col("size").alias(f"{name}_size"), F.transform("w", lambda x: x["word"]).alias(f"{name}_words"))
    pairs = pairs.hint("merge").join(whole(asked, "key"), "key_id").hint("merge").join(whole(known, "found"), "found_id").withColumn("plat", F.col("key_plat"))
    pairs = pairs.withColumns({f"{name}_bigrams": F.array_distinct(_pairs_of_signs(F.col(name))) for name in ("key", "found")})
    same = (F.col("key_plat") == F.col("found_plat")) & (F.col("key_numbers") == F.col("found_numbers")) & F.arrays_overlap("key_words", "found_words")
    all_words, others = F.array_distinct(F.split("key", " ")), F.array_distinct(F.split("found", " "))
    adds = (F.size(all_words) != F.size(others)) & (F.size(F.array_intersect(all_words, others)) == F.least(F.size(all_words), F.size(others)))
    bare = lambda column: F.array_sort(F.array_distinct(F.transform(F.split(column, " "), lambda w: F.regexp_replace(w, "s+$", ""))))
    pairs = pairs.where(same & _near("key", "found") & ~adds & (bare("key") != bare("found"))).select("plat", "key", "found")
    scored = pairs.mapInPandas(_scored, "plat string, key string, found string, similarity double").where(F.col("similarity") >= LEAST)
    scored = scored.hint("merge").join(right.select("plat", F.col("key").alias("found"), F.col("dbid").alias("found_id")), ["plat", "found"])
    best = Window.partitionBy("plat", "key").orderBy(F.desc("similarity"), "found")
    ranked = scored.withColumn("nth", F.row_number().over(best)).withColumn("runner_up", F.lead(F.struct("similarity", "found_id")).over(best))
    unsure = F.coalesce((F.col("similarity") - F.col("runner_up.similarity") < GAP) & (F.col("runner_up.found_id") != F.col("found_id")), F.lit(False))
    return ranked.where((F.col("nth") == 1) & ~unsure).select("plat", "key", "found", "found_id", "similarity")
