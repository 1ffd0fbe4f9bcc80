"""Best-fit packing by exact-complement hashing.

Which documents share a sequence depends on their lengths alone, and there are at most ``size``
different lengths. So the plan is made on counts of lengths, a table of fixed size, and the
pieces are then given places by their rank among pieces of equal length:

1. Encode, cut into pieces of at most ``size`` ids, keep length and checksum of each piece.
2. Count pieces by length and salt; running sums of the counts give each piece its rank.
3. Plan: from the longest length down, fill gaps exactly with a single length, a pair or a triple
   found in hashes of sums of available lengths, as often as the counts allow; then best-fit the rest.
4. Join pieces to the plan's rank intervals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, saved, shuffle_partitions, table, whole_text
from .words import library_encoder

SIZE = 2048
END_ID = 0
PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(tokenizer)
    for batch in batches:
        rows = []
        for row, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
            ids = np.append(ids, end_id).astype("<u4")
            for k in range(0, len(ids), size):
                cut = ids[k : k + size]
                rows.append((row, k // size, k, len(cut), zlib.crc32(cut.tobytes())))
        row, piece, start, length, crc = zip(*rows, strict=True) if rows else [()] * 5
        doc_id = batch.column("doc_id").take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([doc_id, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's ids with the end id: doc_id, piece, start, length, ids_crc32.

    Null texts count as empty (the end id alone); a null doc_id stays null; repeated rows each have
    their pieces; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(rows, partial(_pieces, tokenizer=tokenizer, size=size, end_id=end_id), PIECE)


class SumIndex:
    """Available lengths by count, with hashes of the sums of one and of two of them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        there = (self.left > 0).astype(np.int64)
        self.pairs = np.rint(np.convolve(there, there)).astype(np.int64)[: len(counts)]

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            other = np.flatnonzero(self.left > 0)
            sums = other + length
            self.pairs[sums[sums < len(self.pairs)]] -= 2
            if 2 * length < len(self.pairs):
                self.pairs[2 * length] -= 1

    def fits(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The pair with the longest member that fills the gap."""
        if gap < 2 or not self.pairs[gap]:
            return None
        a = np.arange((gap + 1) // 2, gap)
        for x in a[(self.left[a] > 0) & (self.left[gap - a] > 0)][::-1].tolist():
            if self.fits(x, gap - x):
                return (x, gap - x)
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """The triple with the longest member that fills the gap."""
        a = np.arange(1, gap - 1)
        for x in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)][::-1].tolist():
            rest = gap - x
            b = np.arange((rest + 1) // 2, rest)
            for y in b[(self.left[b] > 0) & (self.left[rest - b] > 0)][::-1].tolist():
                if self.fits(x, y, rest - y):
                    return (x, y, rest - y)
        return None


def plan_sequences(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Kinds of sequences: pieces by length, and how many sequences are of this kind.

    Exact combinations of three pieces can use up short pieces that long ones need, so the plan is
    made with single, with single and pair, and with all complements; the shortest one holds.
    """
    plans = [plan_to_depth(counts, size, depth) for depth in (3, 2, 1)]
    return min(plans, key=lambda kinds: sum(times for _, times in kinds))


def plan_to_depth(counts: dict[int, int], size: int, depth: int) -> list[tuple[dict[int, int], int]]:
    """The plan with complements of up to ``depth`` pieces.

    Each step uses up the count of a length or leaves less than one more sequence of its kind, so
    there are no more kinds than a few times ``size``, whatever the number of pieces.
    """
    start = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        start[length] += n
    index, kinds = SumIndex(start), []

    def use(lengths: tuple[int, ...]) -> None:
        kind = {x: lengths.count(x) for x in lengths}
        times = min(int(index.left[x]) // n for x, n in kind.items())
        for x, n in kind.items():
            index.take(x, n * times)
        kinds.append((kind, times))

    if index.left[size]:
        use((size,))
    for find in (index.single, index.pair, index.triple)[:depth]:
        for length in range(size - 1, 0, -1):
            while index.left[length]:
                # the sequence's own piece is not there for its complement
                index.left[length] -= 1
                found = find(size - length)
                index.left[length] += 1
                if not found or not index.fits(length, *found):
                    break
                use((length, *found))
    while (there := np.flatnonzero(index.left)).size:
        lengths, gap, left = [int(there[-1])], size - int(there[-1]), index.left.copy()
        left[lengths[0]] -= 1
        while (small := np.flatnonzero(left[: gap + 1])).size:
            x = int(small[-1])
            n = min(int(left[x]), gap // x)
            lengths += [x] * n
            gap -= n * x
            left[x] -= n
        use(tuple(lengths))
    return kinds


def plan_table(spark: SparkSession, kinds: list[tuple[dict[int, int], int]]) -> DataFrame:
    """Rank intervals: pieces of ``length`` with rank in [low, high) go, ``each`` to a sequence, to
    sequences from ``first`` on, at ``place`` there. A few times 2048 rows at most."""
    rows, used, sequence = [], {}, 0
    for kind, times in kinds:
        place = 0
        for length, each in sorted(kind.items(), reverse=True):
            low = used.get(length, 0)
            used[length] = low + each * times
            rows.append((length, low, used[length], each, sequence, place))
            place += length * each
        sequence += times
    return spark.createDataFrame(rows, "length int, low long, high long, each long, first long, place long")


def ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds rank: 0, 1, ... among pieces of equal length, in groups of length and salt, so that a
    length of which there are many is ranked by many tasks."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("within", F.row_number().over(inside) - 1).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within")).drop("salt", "base", "within")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to saved pieces (doc_id, piece, start, length, ids_crc32).

    Every piece gets one place; pieces of equal length go by doc_id (nulls first), piece and checksum,
    and of such as are equal in all, either may come first. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    plan = plan_table(spark, plan_sequences(counts, size))
    placed = ranked(pieces, shuffle_partitions(spark)).alias("p").join(F.broadcast(plan).alias("s"), F.expr("p.length = s.length and p.rank >= s.low and p.rank < s.high"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("p.length").cast("long").alias("length"),
        "ids_crc32",
        F.expr("s.first + (p.rank - s.low) div s.each").alias("sequence_id"),
        F.expr("s.place + (p.rank - s.low) % s.each * p.length").alias("offset"),
    )


def packed_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Encode, cut and pack ``docs(doc_id, text)``; a null text counts as empty (the end id alone)."""
    return pack(saved(token_pieces(docs, tokenizer, size, end_id), "pieces"), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces of at most 2048 ids and their places, as ``packed_documents`` defines them."""
    import public_tokenizers

    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
