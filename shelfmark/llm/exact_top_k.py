"""Exact top-k search by distributed histogram selection.

Candidates are packed into blocks. A pass scores every block against every block of queries and
counts scores in bins of the current interval of each query; the summed counts tell in which bin
its k-th highest score lies, and the next pass splits that bin. Once a bin is one score wide and still
holds more ties than are wanted, the passes go on over the ties' vec_ids, a byte at a time, from the
smallest up. The last pass is a filter alone: it keeps what lies at or above the located bin, and the
counts have told how much that is. A block counts only bins down to its own k-th score, as the k-th
score over all blocks can't be lower.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

BLOCK_ROWS, QUERY_ROWS, SLICE, BINS = 8192, 2048, 256, 1024
K, FACTOR, QUERY_STEP = 5, 256, 50
#: Scores left at or above the located bin, as a multiple of k, with which the last pass may begin.
LEFT = 16
#: Bytes of a vec_id; a pass over ties looks at one. Scores and components keep below OVER.
ID_BYTES = 8
OVER = 1 << 61


def integer_vectors(vectors: DataFrame, factor: int = FACTOR) -> DataFrame:
    """vec_id and x: floor(factor * component) as array of long. Rows without vec_id, without a
    vector, or with a null or non-finite component are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(False)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * factor)).alias("x"))


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    matrix = np.array(rows.x.tolist(), np.int64)
    return pd.DataFrame({"dim": [matrix.shape[1] if matrix.ndim > 1 else 0], "salt": [rows.salt.iloc[0]], "ids": [rows.vec_id.to_numpy(np.int64).tobytes()], "matrix": [matrix.tobytes()]})


def _products(queries: np.ndarray, matrix: np.ndarray, most: float) -> np.ndarray:
    """Inner products as integers; ``most`` bounds them, and decides in which numbers they are exact."""
    if most < 1 << 52:
        return (queries.astype(np.float64) @ matrix.astype(np.float64).T).astype(np.int64)
    if most < OVER:
        return queries @ matrix.T
    found = queries.astype(object) @ matrix.T.astype(object)
    if max((abs(x) for m in (found, queries.astype(object), matrix.astype(object)) for x in m.ravel()), default=0) >= OVER:
        raise ArithmeticError("a score of these vectors needs more than 64 bits")
    return found.astype(np.int64)


def _scores(block: pd.DataFrame, queries: pd.DataFrame, most: float):
    """Ids of the block's vectors, and for each slice of queries the slice and its scores; -OVER for own rows."""
    dim = int(block.dim.iloc[0])
    ids = np.frombuffer(block.ids.iloc[0], np.int64)
    matrix = np.frombuffer(block.matrix.iloc[0], np.int64).reshape(len(ids), dim)
    for at in range(0, len(queries), SLICE):
        some = queries.iloc[at : at + SLICE]
        found = _products(np.array(some.x.tolist(), np.int64).reshape(len(some), dim), matrix, most)
        found[some.vec_id.to_numpy()[:, None] == ids[None, :]] = -OVER
        yield ids, some, found


def _first_bytes(ids: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` bytes, one at least, of each id as a number; its order is that of the ids."""
    return (ids.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - 8 * n)


def _count(block: pd.DataFrame, queries: pd.DataFrame, k: int, most: float) -> pd.DataFrame:
    out = []

    def add(some: pd.DataFrame, bins: np.ndarray, counted: np.ndarray) -> None:
        row, col = np.nonzero(counted)
        key, n = np.unique(row * BINS + bins[row, col], return_counts=True)
        out.append(pd.DataFrame({"query_id": some.vec_id.to_numpy()[key // BINS], "bin": key % BINS, "n": n}))

    if len(block) and len(queries):
        for ids, some, found in _scores(block, queries, most):
            open_ = np.flatnonzero(~some.tied.to_numpy())
            if len(open_):
                own, x = some.iloc[open_], found[open_]
                low, width = own.low.to_numpy()[:, None], own.width.to_numpy()[:, None]
                n = x.shape[1]
                floor = np.partition(x, n - k, axis=1)[:, n - k : n - k + 1] if n > k else np.full((len(x), 1), -OVER + 1)
                bins = (x - low) // width
                least = np.maximum((np.maximum(floor, -OVER + 1) - low) // width, 0)
                add(own, bins, (bins >= least) & (x > -OVER) & (x - low < own.span.to_numpy()[:, None]))
            for depth in np.unique(some.depth[some.tied]).tolist():
                at = np.flatnonzero((some.tied & (some.depth == depth)).to_numpy())
                own = some.iloc[at]
                counted = found[at] == own.low.to_numpy()[:, None]
                if depth:
                    counted &= _first_bytes(ids, depth) == own.prefix.to_numpy().view(np.uint64)[:, None]
                # the smallest ids come first, so they get the highest bins
                byte = (_first_bytes(ids, depth + 1) & np.uint64(255)).astype(np.int64) if depth < ID_BYTES else np.zeros(len(ids), np.int64)
                add(own, np.broadcast_to(255 - byte, counted.shape), counted)
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "bin": [], "n": []})


def _keep(block: pd.DataFrame, queries: pd.DataFrame, k: int, most: float) -> pd.DataFrame:
    """All scores above the located bin and in it: a filter, whatever the block."""
    out = []
    if len(block) and len(queries):
        for ids, some, found in _scores(block, queries, most):
            low = some.low.to_numpy()[:, None]
            kept = found >= np.maximum(low, -OVER + 1)
            for depth in np.unique(some.depth[some.depth > 0]).tolist():
                at = np.flatnonzero(some.depth == depth)
                late = _first_bytes(ids, depth) > some.prefix.to_numpy().view(np.uint64)[at, None]
                kept[at] &= ~((found[at] == low[at]) & late)
            row, col = np.nonzero(kept)
            out.append(pd.DataFrame({"query_id": some.vec_id.to_numpy()[row], "vec_id": ids[col], "score": found[row, col]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _located(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """The next state of each query, by the bin that holds its k-th score, or its k-th tie by vec_id;
    ``left`` candidates are in it and above it (0 where no pass can part them)."""
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    there = counts.join(state.withColumnRenamed("vec_id", "query_id"), "query_id").withColumn("upto", F.col("above") + F.sum("n").over(down))
    # fewer than k scores in all: the lowest bin with a score holds the last of them
    fields = ["bin", "upto", "n", "low", "width", "span", "tied", "depth", "prefix"]
    kth = there.where(F.col("upto") - F.col("n") < k).groupBy("query_id").agg(F.min_by(F.struct(*fields), "bin").alias("b"))
    kth = kth.select(F.col("query_id").alias("vec_id"), "b.*")
    deeper = F.col("tied") & (F.col("depth") < ID_BYTES)
    depth = F.when(deeper, F.col("depth") + 1).otherwise(F.col("depth"))
    return kth.select(
        "vec_id",
        F.when(F.col("tied"), F.col("low")).otherwise(F.col("low") + F.col("bin") * F.col("width")).alias("low"),
        F.when(F.col("tied"), F.col("width")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("width") / BINS))).cast("long").alias("width"),
        F.when(F.col("tied"), F.col("span")).otherwise(F.col("width")).alias("span"),
        (F.col("upto") - F.col("n")).alias("above"),
        (F.col("tied") | (F.col("width") == 1) & (F.col("upto") > LEFT * k)).alias("tied"),
        depth.cast("int").alias("depth"),
        F.when(deeper, F.shiftleft("prefix", 8) + (255 - F.col("bin"))).otherwise(F.col("prefix")).cast("long").alias("prefix"),
        F.when(F.col("tied") & (depth == ID_BYTES), F.lit(0)).otherwise(F.col("upto")).alias("left"),
    )


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = K, factor: int = FACTOR) -> DataFrame:
    """The k highest inner products of each query with all other rows: query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; all candidates come if there are fewer than k. A vector is
    compared with vectors of its own number of components. Repeated rows of a vec_id count each as
    a candidate, and as one query, the first by size and components. If a score needs more than 64
    bits, the query ends with an error. Empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors.select("vec_id", "embedding"), factor)
    rows = rows.withColumn("dim", F.size("x")).where("dim > 0")
    norm = F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(norm).alias("most")).first()
    salts, query_blocks = max(1, -(-size["n"] // BLOCK_ROWS)), max(1, -(-size["q"] // QUERY_ROWS))
    most = (size["most"] or 0.0) + 1
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    blocks = saved(salted.groupBy("dim", "salt").applyInPandas(_block, "dim int, salt int, ids binary, matrix binary"), "vector-blocks")
    one_each = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "x")).alias("q")).select("vec_id", "q.dim", "q.x")
    queries = saved(one_each.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")), "query-vectors")
    each_part = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def scored(state: DataFrame, work, schema: str) -> DataFrame:
        asked = queries.join(state, ["vec_id"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys = ["dim", "part", "salt"]
        return each_part.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(partial(work, k=k, most=most), schema)

    lowest = -int(min(most, OVER - 1))
    width = max(1, 1 << max(0, (-2 * lowest // BINS).bit_length()))
    begin = {"low": F.lit(lowest).cast("long"), "width": F.lit(width).cast("long"), "span": F.lit(min(width * BINS, (1 << 63) - 1)).cast("long"), "above": F.lit(0).cast("long"), "tied": F.lit(False), "depth": F.lit(0), "prefix": F.lit(0).cast("long")}
    state = queries.select("vec_id", *[x.alias(name) for name, x in begin.items()])
    while True:
        counts = scored(state, _count, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        state = saved(_located(state, counts, k), "kth-scores")
        left = state.agg(F.max("left")).first()[0] or 0
        if left <= LEFT * k:
            break
    kept = scored(state.drop("left"), _keep, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each vector whose id is divisible by 50, as ``exact_top_k`` defines them."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
