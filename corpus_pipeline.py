"""Corpus pipeline: toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Stages are
written as Parquet in the work folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm import common, jaccard_join, packing, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the threshold; the model learns from the labelled
    documents of ``docs``. Score and text stay in one row, so no join is needed.

    Null and empty texts stay; repeated rows are judged alike; an empty table gives no rows.
    """
    rows = docs.select(*COLUMNS)
    model = toxicity.train(rows.select("doc_id", "text"), common.table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.with_scores(rows, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: sets of five-word shingles with a Jaccard similarity of
    at least 0.8. It is the one of the smallest doc_id (nulls last), and of several such any one by a hash.

    Rows are compared by their own texts, whatever their doc_id; repeated rows are a group. Rows without
    words, as with null and empty texts, all stay. An empty table gives no rows.
    """
    keyed = docs.select(*COLUMNS, *common.row_keys(COLUMNS))
    placed = common.saved(jaccard_join.jaccard_groups(keyed, "doc_id", "_key1", "_key2"), "placed")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key1", "_key2")
    first = placed.where("node is not null").groupBy("node").agg(F.min(order).alias("o")).select("o._key1", "o._key2", F.lit(False).alias("wordless"))
    wordless = placed.where("node is null").select("_key1", "_key2", F.lit(True).alias("wordless")).distinct()
    # the keys grow with the corpus and are never broadcast; the join leaves repeated rows side by side
    kept = keyed.hint("merge").join(first.union(wordless), ["_key1", "_key2"])
    nth = F.row_number().over(Window.partitionBy("_key1", "_key2").orderBy("_key1"))
    return kept.withColumn("nth", nth).where("wordless or nth = 1").select(*COLUMNS)


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of each secret; rows without one, null and empty texts, and repeated
    rows stay as they are. An empty table gives no rows."""
    return secrets.redacted(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their place in sequences of at most 2048 ids. A null text counts
    as empty and gives one piece; repeated rows each have theirs. An empty table gives no rows."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean_of_toxicity),
    ("near_duplicates", one_of_near_duplicates),
    ("secrets", secrets_redacted),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return docs


#: Trained models and encoders are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
