"""Hard negatives by a full sort of each anchor's scores.

Anchors meet all rows in blocks. A block's scores with an anchor are integers and are sorted as a whole, by score
and then by id. A first pass reads each block's best rows of the anchor's label; over all blocks they give the
anchor's positives. A second pass finds each positive's upper limit in the sorted scores by binary search and
reads from there down to its lower limit the first rows of other labels; over all blocks they give the
negatives. So a task sorts a block at a time, and an anchor sends a few rows a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .exact_top_k import _products

BLOCK_ROWS, ANCHOR_ROWS, SLICE = 8192, 1024, 128
FACTOR, ANCHOR_STEP, RELABEL_STEP, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Limits of a negative's score in hundredths of the positive's.
LEAST, MOST = 50, 95
POSITIVE_ROWS = "anchor_id long, vec_id long, score long"
NEGATIVE_ROWS = "anchor_id long, positive_id long, positive_rank int, positive_score long, negative_id long, negative_score long"


def labelled_vectors(vectors: DataFrame, factor: int = FACTOR) -> DataFrame:
    """vec_id, label, dim and x: floor(factor * component) as array of long. Rows without a vec_id, a label, a
    vector or components, or with a null or non-finite component are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where("vec_id is not null and label is not null and size(embedding) > 0").where(~F.coalesce(bad, F.lit(False)))
    x = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), x.alias("x"))


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    # in the order of ids: a stable sort by score then leaves ties in it
    rows = rows.sort_values("vec_id", kind="stable")
    matrix = np.array(rows.x.tolist(), np.int64)
    parts = {"ids": rows.vec_id, "labels": rows.label, "matrix": matrix}
    return pd.DataFrame({"dim": [rows.dim.iloc[0]], "salt": [rows.salt.iloc[0]], **{name: [np.asarray(x, np.int64).tobytes()] for name, x in parts.items()}})


def _sorted(block: pd.DataFrame, anchors: pd.DataFrame, most: float) -> Iterator[tuple]:
    """For each anchor: its place among ``anchors``, and of all other rows of the block ids, whether
    the label is the anchor's, and scores, from the highest score down and by id."""
    ids, labels = (np.frombuffer(block[name].iloc[0], np.int64) for name in ("ids", "labels"))
    matrix = np.frombuffer(block.matrix.iloc[0], np.int64).reshape(len(ids), -1)
    for at in range(0, len(anchors), SLICE):
        some = anchors.iloc[at : at + SLICE]
        scores = _products(np.array(some.x.tolist(), np.int64), matrix, most)
        order = np.argsort(-scores, axis=1, kind="stable")
        for i, (vec_id, label) in enumerate(zip(some.vec_id, some.label, strict=True)):
            down = order[i][ids[order[i]] != vec_id]
            yield at + i, ids[down], labels[down] == label, scores[i, down]


def _positives(block: pd.DataFrame, anchors: pd.DataFrame, most: float, k: int) -> pd.DataFrame:
    out = [(np.zeros(0, np.int64),) * 3]
    if len(block) and len(anchors):
        for i, ids, same, scores in _sorted(block, anchors, most):
            first = np.flatnonzero(same)[:k]
            out.append((np.full(len(first), anchors.vec_id.iloc[i]), ids[first], scores[first]))
    return pd.DataFrame(dict(zip(("anchor_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def _hundredths(score: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """part * score / 100, rounded down and up, without a product beyond 64 bits."""
    whole, rest = np.divmod(score, 100)
    return whole * part + part * rest // 100, whole * part - (-part * rest // 100)


def _negatives(block: pd.DataFrame, anchors: pd.DataFrame, most: float, k: int, limits: tuple[int, int]) -> pd.DataFrame:
    out = []
    if len(block) and len(anchors):
        for i, ids, same, scores in _sorted(block, anchors, most):
            anchor = anchors.iloc[i]
            given = np.asarray(anchor.positive_scores, np.int64)
            other = np.flatnonzero(~same)
            falling = -scores[other]
            begin = np.searchsorted(falling, -_hundredths(given, limits[1])[0], "left")
            end = np.searchsorted(falling, -_hundredths(given, limits[0])[1], "right")
            for nth, (b, e) in enumerate(zip(begin, np.minimum(end, begin + k), strict=True)):
                for at in other[b:e]:
                    out.append((anchor.vec_id, anchor.positive_ids[nth], nth + 1, given[nth], ids[at], scores[at]))
    return pd.DataFrame(out, columns=[x.split()[0] for x in NEGATIVE_ROWS.split(", ")])


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, limits: tuple[int, int] = (LEAST, MOST), factor: int = FACTOR) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    Positives of an anchor are the first other rows of its label by score, ties by smaller vec_id. Negatives of
    a positive are the first rows of other labels with a score from ``limits[0]`` to ``limits[1]`` hundredths
    of the positive's; where it is negative there are none.

    A vector is compared with vectors of its own number of components. Repeated rows of a vec_id count each, and
    as one anchor, the first by label, size and components; rows of the anchor's own id are neither positives
    nor negatives. If a score needs more than 64 bits, the query ends with an error. Anchors without
    a positive or negative, and empty tables, give no rows; other columns are not read.
    """
    rows = labelled_vectors(vectors.select("vec_id", "label", "embedding"), factor)
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("a"), F.max(norm).alias("most")).first()
    salts, parts = max(1, -(-size["n"] // BLOCK_ROWS)), max(1, -(-size["a"] // ANCHOR_ROWS))
    most = (size["most"] or 0.0) + 1
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    blocks = saved(salted.groupBy("dim", "salt").applyInPandas(_block, "dim int, salt int, ids binary, labels binary, matrix binary"), "negative-blocks")
    one_each = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "dim", "x")).alias("a")).select("vec_id", "a.*")
    anchors = saved(one_each.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")), "negative-anchors")
    each_part = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def scored(asked: DataFrame, work: Callable, schema: str) -> DataFrame:
        each_block = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = ["dim", "part", "salt"]
        return each_part.groupBy(*keys).cogroup(each_block.groupBy(*keys)).applyInPandas(work, schema)

    def first(rows: DataFrame, keys: list[str], score: str, id_: str, k: int) -> DataFrame:
        down = Window.partitionBy(*keys).orderBy(F.desc(score), id_)
        return rows.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= k)

    best = first(scored(anchors, partial(_positives, most=most, k=positives), POSITIVE_ROWS), ["anchor_id"], "score", "vec_id", positives)
    listed = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    given = best.groupBy("anchor_id").agg(listed.alias("p")).select(F.col("anchor_id").alias("vec_id"), F.col("p.vec_id").alias("positive_ids"), F.col("p.score").alias("positive_scores"))
    asked = saved(anchors.join(given, "vec_id"), "negative-positives")
    found = scored(asked, partial(_negatives, most=most, k=negatives, limits=limits), NEGATIVE_ROWS)
    ranked = first(found, ["anchor_id", "positive_rank"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three hard negatives for each of five positives of every vector whose id is divisible by 50, as
    ``hard_negatives`` defines them; each seventh vector first moves to the next label."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    found = hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % ANCHOR_STEP == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  WHERE p.nth <= 5
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
