"""Secret scan with a random forest against false positives, in DataFrame functions and Spark ML.

Candidates are private-key blocks, passwords in URLs, quoted and assigned values, and long runs of
key-like characters. Each gets features of its length, its character transitions, its coverage by a
dictionary of the corpus' words, the path of its document, and the words around it. A forest trained
from labelled findings gives the probability that it is a secret.

Nobody has reviewed findings of the tables, so the label is other evidence than what the forest sees: a
finding counts as secret if it has a published key format, or if its characters are about evenly spread and
it is the password of a URL, stands behind the word bearer, or behind an assignment to a word that names a
secret. Names, assignments, formats and that spread are no features; the words around count without
those that name a secret.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, row_keys, saved, table, whole_text

#: Candidates, the first that fits at a place: a private-key block; user and password in a URL; a quoted
#: value behind = or :, from 8 signs; an assigned value with other signs than letters; a run of at least
#: 16 letters, digits and + / _ = - with a digit, or without one behind = : or a quote.
CANDIDATE = "|".join(
    [
        # a block ends at the next five dashes, so texts of many beginnings without an end stay linear
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?!-----)[A-Za-z0-9+/=\s:,-])*+-----END [A-Z ]{0,40}PRIVATE KEY-----",
        r"(?<=://)[^\s/:@?#\"'<>]{1,200}+:[^\s/@?#\"'<>]{3,200}+@",
        r"(?<=[=:]\s{0,3}[\"'])[^\"'\s]{8,}+(?=[\"'])",
        r"(?<=[=:]\s{0,3})(?![/\"'])(?=[A-Za-z]{0,200}+[^A-Za-z\s\"'<>,.;])[^\s\"'<>,;]{8,}+",
        r"(?<![A-Za-z0-9+/_=-])(?:(?=[A-Za-z+/_=-]*+[0-9])|(?<=[=:\"']))[A-Za-z0-9+/_=-]{16,}+",
    ]
)
CONTEXT = 48
#: Published beginnings of keys, and how a private-key block begins.
KEY_FORMATS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "npm_", "-----BEGIN ")
#: Words that name a secret, as they occur before one.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "private-key")
#: Bits of entropy a character from which on a named value is labelled a secret.
LEAST_ENTROPY = 2.5
#: Findings to fit on (the bound of the sample).
FIT_FINDINGS = 50_000
TREES, DEPTH, SEED = 20, 6, 7
THRESHOLD = 0.5
MARK = "[SECRET]"
FEATURES = ["f_length", "f_transitions", "f_digits", "f_upper", "f_lower", "f_distinct", "f_dictionary", "f_depth", "f_path", "f_words", "f_near", "f_near_best", "f_near_worst"]


def key_columns(docs: DataFrame) -> list[str]:
    """What a row's findings come from; rows alike in these have the same ones."""
    return [c for c in ("doc_id", "text", "source") if c in docs.columns]


def candidates(docs: DataFrame) -> DataFrame:
    """fid, _key1, _key2, doc_id, path, start (in code points), value, before, after of each candidate.

    ``_key1`` and ``_key2`` tell rows apart. ``path`` is the document's source. Of a URL with user and
    password the value is the password.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(key_columns(docs)), path.alias("path"), whole_text().alias("text"))
    found = rows.where(F.col("text").rlike(CANDIDATE)).withColumn("values", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("between", F.split("text", CANDIDATE, -1))
    found = found.withColumn("row", F.monotonically_increasing_id())
    whole = F.get("values", F.col("nth"))
    user = F.when(F.endswith(whole, F.lit("@")) & F.contains(whole, F.lit(":")), F.instr(whole, ":")).otherwise(0)
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(0), F.size("values") - 1))).withColumn("user", user).withColumn("whole", whole)
    each = each.select(
        *["doc_id", "_key1", "_key2", "row", "path", "nth", "user"],
        F.when(F.col("user") > 0, F.substring("whole", F.col("user") + 1, F.char_length("whole") - F.col("user") - 1)).otherwise(F.col("whole")).alias("value"),
        F.char_length("whole").alias("size"),
        F.char_length(F.get("between", F.col("nth"))).alias("gap"),
        F.right(F.get("between", F.col("nth")), F.lit(CONTEXT)).alias("before"),
        F.left(F.get("between", F.col("nth") + 1), F.lit(CONTEXT)).alias("after"),
    )
    upto = Window.partitionBy("row").orderBy("nth")
    start = F.sum(F.col("gap") + F.col("size")).over(upto) - F.col("size") + F.col("user")
    return each.withColumn("start", start.cast("long")).withColumn("fid", F.monotonically_increasing_id()).drop("row", "nth", "gap", "size", "user")


def letter_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def near_words(found: DataFrame) -> DataFrame:
    """fid and each distinct word around a finding that doesn't name a secret."""
    words = F.array_distinct(letter_runs(F.concat_ws(" ", "before", "after")))
    return found.select("fid", F.explode(words).alias("word")).where(~_any_of(F.col("word"), NAMES))


def dictionary_share(found: DataFrame, docs: DataFrame) -> DataFrame:
    """fid and the share of the value's characters that are in words of the dictionary.

    The dictionary has the words of three letters and more that at least two texts of ``docs`` hold
    outside of candidates; the words that occur in values are looked up in it.
    """
    parts = found.select("fid", F.char_length("value").alias("size"), F.explode(letter_runs(F.col("value"))).alias("word"))
    asked = saved(parts, "value-words")
    prose = docs.select(F.explode(F.array_distinct(letter_runs(F.regexp_replace(whole_text(), CANDIDATE, " ")))).alias("word"))
    known = prose.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("word")
    return asked.hint("merge").join(known, "word").groupBy("fid").agg((F.sum(F.char_length("word")) / F.first("size")).alias("f_dictionary"))


def near_evidence(found: DataFrame) -> DataFrame:
    """fid with sum, greatest and least of the log odds of the words around it, and their number.

    A word's odds come from the labels of all other findings it stands beside, so a finding's own label
    is no part of its features. ``found`` has fid, before, after and label.
    """
    words = saved(near_words(found).join(found.select("fid", "label"), "fid"), "near-words")
    whole = found.agg(F.sum("label").alias("yes"), F.count("label").alias("n")).first()
    counted = saved(words.groupBy("word").agg(F.sum(F.coalesce("label", F.lit(0.0))).alias("yes"), F.count("label").alias("n")), "near-counts")
    own = F.coalesce("label", F.lit(0.0))
    there = F.when(F.col("label").isNull(), 0).otherwise(1)
    yes, n = F.col("yes") - own, F.col("n") - there
    all_yes, all_n = whole["yes"] or 0.0, whole["n"]
    odds = F.log((yes + 0.5) / (n - yes + 0.5)) - math.log((all_yes + 1) / (all_n - all_yes + 1))
    each = words.hint("merge").join(counted, "word").select("fid", odds.alias("odds"))
    return each.groupBy("fid").agg(F.sum("odds").alias("f_near"), F.max("odds").alias("f_near_best"), F.min("odds").alias("f_near_worst"), F.count(F.lit(1)).alias("f_words"))


def _any_of(column: Column, some: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(column), F.lit(x)) for x in some])


def has_key_format() -> Column:
    return reduce(lambda a, b: a | b, [F.startswith("value", F.lit(x)) for x in KEY_FORMATS])


def entropy(value: Column) -> Column:
    """Bits a character, by the frequencies of the value's own characters."""
    signs = F.split(value, "")
    size = F.size(signs)
    terms = F.transform(F.array_distinct(signs), lambda c: (size - F.size(F.array_remove(signs, c))) / size)
    return F.aggregate(terms, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def weak_label() -> Column:
    """Label of a finding where nobody has reviewed it (see the module's head)."""
    named = _any_of(F.regexp_extract("before", r"([\p{L}\p{N}_-]+)[^\p{L}\p{N}_-]*$", 1), NAMES) & F.col("before").rlike(r"[=:]\s*[\"']?$")
    # a password of a URL is cut out behind the user, so what stands before both is the URL's beginning
    sent = F.endswith("before", F.lit("://")) | F.col("before").rlike(r"(?i)\bbearer\s+$")
    return (has_key_format() | ((named | sent) & (entropy(F.col("value")) >= LEAST_ENTROPY))).cast("double")


def with_features(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds the forest's features as doubles to findings with ``label`` (0, 1 or null)."""
    v = F.col("value")

    def share(pattern: str) -> Column:
        return F.char_length(F.regexp_replace(v, f"[^{pattern}]", "")) / F.char_length("value")

    runs = F.size(F.regexp_extract_all("value", F.lit("[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]+"), F.lit(0)))
    features = {
        "f_length": F.char_length("value"),
        "f_transitions": (runs - 1) / F.greatest(F.char_length("value") - 1, F.lit(1)),
        "f_digits": share("0-9"),
        "f_upper": share("A-Z"),
        "f_lower": share("a-z"),
        "f_distinct": F.size(F.array_distinct(F.split("value", ""))),
        "f_depth": F.char_length(F.regexp_replace("path", "[^/]", "")),
        "f_path": F.lower("path").rlike("test|example|sample|doc|fixture"),
    }
    joined = found.hint("merge").join(dictionary_share(found, docs), "fid", "left").hint("merge").join(near_evidence(found), "fid", "left")
    return joined.withColumns({name: F.coalesce(features.get(name, F.col(name)).cast("double"), F.lit(0.0)) for name in FEATURES})


def train_forest(findings: DataFrame, sample: int = FIT_FINDINGS) -> RandomForestClassificationModel | None:
    """A forest from findings with features and ``label`` 0 or 1, fitted on about ``sample`` at most.

    None where there are not both labels.
    """
    labelled = findings.where(F.col("label").isin(0.0, 1.0))
    sizes = labelled.groupBy("label").count().collect()
    if len(sizes) < 2:
        return None
    total = sum(r["count"] for r in sizes)
    if total > sample:
        labelled = labelled.where(F.pmod(F.xxhash64("value", "_key1", "start"), F.lit(1 << 20)) < int((1 << 20) * sample / total))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label").fit(vectors.select("features", "label"))


def score_findings(findings: DataFrame, forest: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``score``, the forest's probability of a secret; without a forest the label, or 0 if it is null."""
    if forest is None:
        return findings.withColumn("score", F.coalesce("label", F.lit(0.0)))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings)
    return forest.transform(vectors).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labels: Column | None = None) -> DataFrame:
    """Findings of ``docs``: _key1, _key2, doc_id, path, start, length, value, before, after, score, is_secret.

    ``labels`` is the label of a finding, a column over its fields; by default the weak label. A finding
    is a secret by the forest's score or by a published key format. Null and empty texts have none; a
    null doc_id stays null; repeated rows each have their own; a table without candidates, as an empty
    one, gives no rows. Values are whole, whatever their length; columns besides doc_id, text and source
    only tell rows apart.
    """
    found = saved(candidates(docs), "candidates")
    labelled = saved(found.withColumn("label", weak_label() if labels is None else labels), "labelled-findings")
    featured = saved(with_features(labelled, docs), "findings")
    scored = score_findings(featured, train_forest(featured))
    discard(found, labelled)
    secret = (F.col("score") >= THRESHOLD) | has_key_format()
    return scored.select("_key1", "_key2", "doc_id", "path", "start", F.char_length("value").alias("length"), "value", "before", "after", "score", secret.alias("is_secret"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each secret's text replaced by a mark; rows and columns stay, n_chars follows the text.

    A row's secrets are its own, whatever other rows its doc_id has; rows with a null doc_id are treated
    alike. Rows without a secret, null and empty texts stay as they are; an empty table gives no rows.
    """
    secrets = saved(scan(docs).where("is_secret").groupBy("_key1", "_key2").agg(F.collect_set("value").alias("_secrets")), "secrets")
    # the row is one column, so its columns' names meet no others
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), *row_keys(key_columns(docs)))
    joined = keyed.hint("merge").join(secrets, ["_key1", "_key2"], "left")  # secrets grow with the corpus: never broadcast
    # longest first, so that no secret is cut by a shorter one inside it
    ordered = F.array_sort(F.col("_secrets"), lambda a, b: F.char_length(b) - F.char_length(a))
    old, none = F.col("_row.text"), F.col("_secrets").isNull()
    text = F.when(none, old).otherwise(F.aggregate(ordered, old, lambda t, s: F.replace(t, s, F.lit(MARK))))
    changed = {"text": text, "n_chars": F.when(none, F.col("_row")["n_chars"]).otherwise(F.char_length(text).cast("long")) if "n_chars" in docs.columns else None}
    return joined.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents' whole texts with the digest of the value, as ``scan`` defines them."""
    findings = scan(table(spark, sf_dir, "documents"))
    return findings.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")
