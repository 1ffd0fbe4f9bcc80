"""I-Match fingerprints with randomised lexicons, in DataFrame functions alone.

A text is its distinct terms within a band of document frequency (the lexicon). From the lexicon
random ones are made by the terms' hashes; in each the text's terms are sorted and hashed, and these
hashes are the fingerprint. There are two kinds. Each of the wide lexicons drops a quarter of the
terms, another one each, so every term of the text is in all of them but one, whatever its length.
The narrow ones get thinner with the number of terms the text has, so that each holds about one of
them and an edit changes few of the hashes: they are a sample of the terms of a long text, and tell
by how much texts differ that the wide ones tell apart. A fingerprint has the narrow hashes at two
adjacent thinnings, so texts of similar length can be compared.

Document frequencies are counted over the whole corpus for each 64-bit hash of a term. What is
outside of the band is known without a join of all terms: a term below it is in one document, which
the count keeps; the terms above it are at most 1 / MOST_SHARE times as many as a document has on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_partitions, table, whole_text

#: The band: a term occurs in at least so many documents (``rare_terms`` needs two), and in at most this share of them.
LEAST_DOCUMENTS, MOST_SHARE = 2, 0.05
#: A text with fewer terms in the band is taken with all its terms.
LEAST_TERMS = 4
SLOTS, TERMS_A_LEVEL = 64, 48
#: Wide lexicons; each drops one of as many parts of the terms.
WIDE = 4
EMPTY = "------"


def terms_or_none(terms: str | Column) -> Column:
    return F.coalesce(F.col(terms) if isinstance(terms, str) else terms, F.array().cast("array<bigint>"))


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased runs of letters and digits."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def frequencies(rows: DataFrame) -> DataFrame:
    """h, n, doc_id of each term of ``rows(doc_id, text)``: the rows it is in, and the least doc_id of them."""
    each = rows.select("doc_id", F.explode(term_hashes(F.col("text"))).alias("h"))
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"))


def above(n_documents: int) -> Column:
    return F.col("n") > max(LEAST_DOCUMENTS, int(MOST_SHARE * n_documents))


def rare_terms(counted: DataFrame) -> DataFrame:
    """doc_id, rare: the terms below the band, which are in one row; other rows of its doc_id don't have them."""
    return counted.where(F.col("n") < LEAST_DOCUMENTS).groupBy("doc_id").agg(F.collect_list("h").alias("rare"))


def with_fingerprint(df: DataFrame, every: str, band: str, name: str) -> DataFrame:
    """Adds struct ``name`` from a text's terms and those in the band: level, the slots' hashes at this
    level and the next, and those of the wide lexicons."""

    def thinned(terms: str, more: int) -> Column:
        mask = F.expr(f"shiftleft(1L, {name}_level + {more}) - 1")
        return F.filter(F.col(terms), lambda h: F.shiftrightunsigned(h, 24).bitwiseAND(mask) == 0)

    def digest(own: Column) -> Column:
        return F.when(F.size(own) == 0, EMPTY).otherwise(F.lpad(F.lower(F.hex(F.xxhash64(F.array_sort(own)).bitwiseAND(0xFFFFFF))), 6, "0"))

    def hashed(kept: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda j: digest(F.filter(F.col(kept), lambda h: F.shiftrightunsigned(h, 56).bitwiseAND(SLOTS - 1) == j)))

    def wide() -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda j: digest(F.filter(F.col(f"{name}_terms"), lambda h: F.shiftrightunsigned(h, 4).bitwiseAND(WIDE - 1) != j)))

    df = df.withColumn(f"{name}_terms", F.when(F.size(band) >= LEAST_TERMS, F.col(band)).otherwise(F.col(every)))
    df = df.withColumn(f"{name}_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(f"{name}_terms"), F.lit(1)) / TERMS_A_LEVEL))).cast("int"))
    df = df.withColumn(f"{name}_kept", thinned(f"{name}_terms", 0)).withColumn(f"{name}_next", thinned(f"{name}_kept", 1))
    df = df.withColumn(name, F.struct(F.col(f"{name}_level").alias("level"), hashed(f"{name}_kept").alias("here"), hashed(f"{name}_next").alias("next"), wide().alias("wide")))
    return df.drop(*[f"{name}_{x}" for x in ("terms", "level", "kept", "next")])


def as_text(fingerprint: str) -> Column:
    f = F.col(fingerprint)
    return F.concat_ws(":", f["level"].cast("string"), F.concat_ws("", f["here"]), F.concat_ws("", f["next"]), F.concat_ws("", f["wide"]))


def likeness(a: str, b: str) -> Column:
    """Equal hashes, as a share of the hashes in use in one and the other on average, of the wide
    lexicons and of the slots at the common level. Of terms that differ, the wide ones miss none.

    Without such a level it is 0; of two fingerprints without terms it is 1.
    """
    a, b = F.col(a), F.col(b)
    level = F.greatest(a["level"], b["level"])

    def at(f: Column) -> Column:
        return F.concat(F.when(f["level"] == level, f["here"]).when(f["level"] + 1 == level, f["next"]), f["wide"])

    x, y = at(a), at(b)
    equal = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != EMPTY)), lambda s: s))
    used = F.size(F.filter(x, lambda p: p != EMPTY)) + F.size(F.filter(y, lambda p: p != EMPTY))
    return F.when(F.abs(a["level"] - b["level"]) > 1, 0.0).when(used == 0, 1.0).otherwise(2 * equal / used)


def with_next(docs: DataFrame, n_groups: int) -> DataFrame:
    """Rows (doc_id, text) with the group of neighbours they are in, and a copy of each group's
    follower: the first row of the next group, of the first group after the last.

    Groups are ranges of doc_id of about equal size. In a window over a group in order of
    (follower, doc_id, text), the next row of each row that isn't a follower is its next document.
    """
    spark = docs.sparkSession
    shares = [i / n_groups for i in range(1, n_groups)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or [])) if shares else []
    group = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b < F.col("doc_id")))
    rows = docs.withColumn("group", group)
    first = sorted((r["group"], r["doc_id"]) for r in rows.groupBy("group").agg(F.min("doc_id").alias("doc_id")).collect())  # n_groups rows at most
    follow = [(first[(i + 1) % len(first)][1], g) for i, (g, _) in enumerate(first)]
    followers = spark.createDataFrame(follow, "doc_id long, group int")
    copies = docs.where(F.col("doc_id").isin([d for d, _ in follow])).join(F.broadcast(followers), "doc_id") if follow else rows
    return rows.withColumn("follower", F.lit(False)).unionByName(copies.withColumn("follower", F.lit(True)))


def with_edited(df: DataFrame) -> DataFrame:
    """Adds n_chars and the edited text of ``text`` and ``after``."""
    df = df.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("k", F.expr("cast(n_chars div 4 as int)"))
    return df.withColumn("edited", F.expr("concat(left(text, cast(n_chars as int) - k), left(coalesce(after, ''), k))"))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness.

    The edited text has its last quarter (floor of its code points by 4) replaced by the beginning
    of the next document by doc_id (of the first after the last). Null texts count as empty; rows
    without a doc_id are left out; rows of equal doc_id go by text. A text without terms has empty
    slots only. An empty table gives no rows.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    n_documents, n_groups = rows.count(), 4 * shuffle_partitions(docs.sparkSession)
    counted = saved(frequencies(rows), "term-counts")
    common = counted.where(above(n_documents)).groupBy().agg(F.collect_list("h").alias("h")).select("h").scalar()
    order = Window.partitionBy("group").orderBy("follower", "doc_id", "listed", "text")
    # texts alone are shuffled: their terms are made where the groups are
    cut = with_next(rows.withColumn("listed", F.lit(1)), n_groups).repartition("group").withColumn("own", term_hashes(F.col("text")))
    cut = with_edited(cut.withColumn("after", F.lead("text").over(order)).withColumn("others", F.lead("own").over(order))).where("not follower")
    # terms of neither text, made where they are cut: few, and looked up by a join
    made = cut.select("doc_id", F.explode(F.array_except(F.array_except(term_hashes(F.col("edited")), "own"), terms_or_none("others"))).alias("h"))
    inside = counted.where((F.col("n") >= LEAST_DOCUMENTS) & ~above(n_documents)).select("h")
    made = made.hint("merge").join(inside, "h").groupBy("doc_id").agg(F.collect_set("h").alias("made"))
    lists = saved(rare_terms(counted).join(made.hint("merge"), "doc_id", "full"), "term-lists")

    # the lists of a doc_id go before its texts
    both = rows.withColumns({"listed": F.lit(1), "lists": F.lit(None).cast("struct<doc_id:bigint,rare:array<bigint>,made:array<bigint>>")})
    both = both.unionByName(lists.select("doc_id", F.lit("").alias("text"), F.lit(0).alias("listed"), F.struct("doc_id", "rare", "made").alias("lists")))
    near = with_next(both, n_groups).withColumn("lists", F.last("lists", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = near.where("listed = 1").withColumn("lists", F.when(F.col("lists.doc_id") == F.col("doc_id"), F.col("lists")))
    near = near.withColumn("own", term_hashes(F.col("text")))
    near = near.withColumn("band", F.array_except("own", F.concat(terms_or_none(common), terms_or_none("lists.rare"))))
    near = with_fingerprint(near, "own", "band", "f")
    near = near.withColumns({"after": F.lead("text").over(order), "others": F.lead("band").over(order), "g": F.lead("f").over(order)}).where("not follower")
    near = with_edited(near).withColumn("changed", term_hashes(F.col("edited")))
    known = F.concat("band", terms_or_none("others"), terms_or_none("lists.made"))
    near = with_fingerprint(near.withColumn("changed_band", F.array_intersect("changed", known)), "changed", "changed_band", "e")
    return near.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("f").alias("fingerprint"),
        as_text("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"),
        likeness("f", "g").alias("near_next"),
    )


def op9_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents' whole texts and of their edited texts, as ``fingerprint_pairs`` defines them."""
    return fingerprint_pairs(table(spark, sf_dir, "documents"))
