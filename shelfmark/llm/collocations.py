"""Phrases mined level by level (Apriori), scored by their weakest cut.

The first level counts words of each language. Frequent ones get numbers, texts are written once as arrays of
these numbers with 0 for all else, and later levels never read a text again: a phrase of k words is a pair of
adjacent frequent phrases of k-1 words, so a level counts pairs of adjacent numbers, numbers the frequent
pairs, and writes the arrays of the next level. A language needs no column of its own there, as numbers of
words already differ by language.

Frequent phrases are broadcast in chunks of a fixed size. A level with more than one chunk takes one pass over
the arrays for each, which fills in the numbers of that chunk, so a task's memory never follows the tables.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, in_arrow, numbered, saved, table

LEAST_COUNT, MOST_WORDS, BEST = 100, 5, 2000
#: Frequent words and pairs that are broadcast at once.
CHUNK_WORDS, CHUNK_PAIRS = 400_000, 2_000_000
#: What a task keeps of counts before it hands them on; bytes of text split at once; numbers in a block.
HELD_WORDS, HELD_PAIRS, PART_BYTES, BLOCK = 300_000, 4_000_000, 4 << 20, 500_000
MOST_NUMBERS = 1 << 32

BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Capital letters become small, tabs spaces, and all that ends a piece a full stop.
PLAIN = bytes(46 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, with a full stop as a word between pieces; a very long text in several lists."""
    text = text.translate(PLAIN)
    at = 0
    while at < len(text):
        cut = len(text) if len(text) - at <= PART_BYTES else text.find(b" ", at + PART_BYTES)
        cut = cut if cut > 0 else len(text)
        # other white space is gone, and so only spaces part words
        yield text[at:cut].replace(b".", b" . ").split()
        at = cut


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            yield lang.as_py(), text.as_py()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n; a row without a word has the number of all words."""
    held: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        flat = [(lang, word, n) for lang, counts in held.items() for word, n in counts.items()]
        for lang, counts in held.items():
            flat.append((lang, None, sum(counts.values())))
        held.clear()
        langs, words, ns = zip(*flat, strict=True) if flat else ((), (), ())
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(ns, pa.int64())], ["lang", "word", "n"])

    size = 0
    for lang, text in _rows(batches):
        counts = held[lang]
        for words in _words(text):
            before = len(counts)
            counts.update(words)
            counts.pop(b".", None)
            size += len(counts) - before
            if size > HELD_WORDS:
                yield flush()
                counts, size = held[lang], 0
    yield flush()


class Blocks:
    """Arrays of numbers put together to blocks, with a 0 between two of them and no longer runs of 0."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, numbers: np.ndarray) -> None:
        known = np.concatenate([[False], numbers != 0, [False]])
        # a number without a neighbour is in no pair
        paired = known[1:-1] & (known[:-2] | known[2:])
        kept = paired | np.concatenate([[False], paired[:-1]])
        some = np.where(paired, numbers, 0)[kept]
        if len(some):
            self.parts += [some.astype(np.uint32), np.zeros(1, np.uint32)]
            self.size += len(some) + 1

    def take(self, least: int = 1) -> Iterator[bytes]:
        if self.size >= least:
            yield np.concatenate(self.parts).tobytes()
            self.parts, self.size = [], 0


def _binary(values: list[bytes], name: str) -> pa.RecordBatch:
    return pa.record_batch([pa.array(values, pa.binary())], [name])


def _code_words(batches: Iterator[pa.RecordBatch], chunk) -> Iterator[pa.RecordBatch]:
    """Blocks of word numbers, all frequent words being in one chunk."""
    numbers, blocks = chunk.value, Blocks()
    for lang, text in _rows(batches):
        known = numbers.get(lang)
        if known:
            found = [np.fromiter(map(known.get, words, repeat(0)), np.uint32, len(words)) for words in _words(text)]
            blocks.add(np.concatenate(found) if found else np.zeros(0, np.uint32))
        for block in blocks.take(BLOCK):
            yield _binary([block], "numbers")
    for block in blocks.take():
        yield _binary([block], "numbers")


def _code_words_of(batches: Iterator[pa.RecordBatch], chunk) -> Iterator[pa.RecordBatch]:
    """lang, text, numbers: the numbers of this chunk's words are filled in."""
    for batch in batches:
        for lang, text, before in zip(*(batch.column(i) for i in range(3)), strict=True):
            known = chunk.value.get(lang.as_py(), {})
            found = [np.fromiter(map(known.get, words, repeat(0)), np.uint32, len(words)) for words in _words(text.as_py())]
            numbers = np.concatenate([np.zeros(0, np.uint32), *found])
            if before.as_py() is not None:
                numbers += np.frombuffer(before.as_py(), np.uint32)
            yield pa.record_batch([pa.array([lang.as_py()], pa.string()), pa.array([text.as_py()], pa.binary()), pa.array([numbers.tobytes()], pa.binary())], ["lang", "text", "numbers"])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks = Blocks()
    for batch in batches:
        for x in batch.column(0):
            blocks.add(np.frombuffer(x.as_py(), np.uint32))
            for block in blocks.take(BLOCK):
                yield _binary([block], "numbers")
    for block in blocks.take():
        yield _binary([block], "numbers")


def _pairs(numbers: np.ndarray) -> np.ndarray:
    """A key for each two neighbours, 0 where one of them is 0."""
    wide = numbers.astype(np.uint64)
    return np.where((wide[:-1] != 0) & (wide[1:] != 0), wide[:-1] << np.uint64(32) | wide[1:], np.uint64(0))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        for x in batch.column(0):
            keys = _pairs(np.frombuffer(x.as_py(), np.uint32))
            held.append(keys[keys != 0])
            size += len(held[-1])
            if size > HELD_PAIRS:
                yield flush()
                held, size = [], 0
    yield flush()


def _numbers_of(pairs: np.ndarray, chunk) -> np.ndarray:
    keys, numbers = chunk.value
    place = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    return np.where(keys[place] == pairs, numbers[place], 0).astype(np.uint32)


def _code_pairs(batches: Iterator[pa.RecordBatch], chunk) -> Iterator[pa.RecordBatch]:
    """Blocks of the next level, all frequent pairs being in one chunk."""
    blocks = Blocks()
    for batch in batches:
        for x in batch.column(0):
            blocks.add(_numbers_of(_pairs(np.frombuffer(x.as_py(), np.uint32)), chunk))
            for block in blocks.take(BLOCK):
                yield _binary([block], "numbers")
    for block in blocks.take():
        yield _binary([block], "numbers")


def _code_pairs_of(batches: Iterator[pa.RecordBatch], chunk) -> Iterator[pa.RecordBatch]:
    """numbers, next: the numbers of this chunk's pairs are filled in."""
    for batch in batches:
        for x, before in zip(batch.column(0), batch.column(1), strict=True):
            found = _numbers_of(_pairs(np.frombuffer(x.as_py(), np.uint32)), chunk)
            if before.as_py() is not None:
                found += np.frombuffer(before.as_py(), np.uint32)
            yield pa.record_batch([pa.array([x.as_py()], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["numbers", "next"])


def _chunks(level: DataFrame, columns: list[str], n: int, size: int) -> Iterator[pa.Table]:
    for low in range(0, n, size):
        yield level.where((F.col("id") > low) & (F.col("id") <= low + size)).select("id", *columns).toArrow()


def _word_numbers(chunk: pa.Table) -> dict[str, dict[bytes, int]]:
    found: dict[str, dict[bytes, int]] = defaultdict(dict)
    for id_, lang, word in zip(*(chunk.column(i).to_pylist() for i in range(3)), strict=True):
        found[lang][word] = id_
    return dict(found)


def _pair_numbers(chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = chunk.column("pair").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], chunk.column("id").to_numpy()[order].astype(np.uint32)


def _next_blocks(source: DataFrame, chunks: Iterator, n_chunks: int, once, each, schema: str, name: str) -> DataFrame:
    """``source`` coded with all ``chunks``: in one pass if there is one chunk, else in one pass for each."""
    context = source.sparkSession.sparkContext
    if n_chunks == 1:
        shared = context.broadcast(next(chunks))
        blocks = saved(in_arrow(source, partial(once, chunk=shared), "numbers binary"), name)
        shared.destroy()
        return blocks
    last = schema.split()[-2]
    state = source.withColumn(last, F.lit(None).cast("binary"))
    for k, chunk in enumerate(chunks):
        shared = context.broadcast(chunk)
        done = saved(in_arrow(state, partial(each, chunk=shared), schema), f"{name}-part")
        shared.destroy()
        if k:
            discard(state)
        state = done
    blocks = saved(in_arrow(state.select(last), _compact, "numbers binary"), name)
    discard(state)
    return blocks


def _size_of(level: DataFrame, what: str) -> int:
    n = level.agg(F.max("id")).first()[0] or 0
    if n >= MOST_NUMBERS:
        raise ArithmeticError(f"{n} frequent {what}: more than 32 bits can number")
    return n


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _scored(level: DataFrame, k: int) -> DataFrame:
    """The lowest cut of each phrase of ``k`` words: score, l, r; of equal ones the first."""
    cuts = []
    for j in range(1, k):
        l, r = F.col("heads")[j - 1], F.col("tails")[k - j - 1]
        # integral division of decimals is exact, and its result fits 64 bits as it is at most ten times n
        level = level.withColumns({f"_above{j}": _wide(_wide(F.col("a") * 1000) * _wide(F.col("n"))), f"_below{j}": _wide(_wide(l) * _wide(r))})
        cuts.append(F.struct(F.expr(f"_above{j} div _below{j}").alias("score"), F.lit(j).alias("j"), l.alias("l"), r.alias("r")))
    least = F.array_min(F.array(*cuts))
    return level.withColumn("cut", least).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(documents: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, best: int = BEST, chunk_words: int = CHUNK_WORDS, chunk_pairs: int = CHUNK_PAIRS) -> DataFrame:
    """Each language's ``best`` phrases of 2 to ``most_words`` words: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and ends of lines, and these into words at spaces
    and tabs. ``a`` is how often a phrase occurs in pieces, overlaps included, ``least`` at least; of its
    cuts into two parts that occur ``l`` and ``r`` times, the one with the lowest floor(1000 * a * n / (l * r)) counts,
    of equal ones the first; ``n`` is the number of the language's words. A phrase that always stands inside a
    longer one is left out.

    Null texts are empty, a null lang is ``und`` and joins rows of that name. Repeated rows count each. Without
    frequent phrases, as with an empty table, there are no rows; other columns are not read.
    """
    lang = F.coalesce(F.col("lang"), F.lit("und")).alias("lang")
    texts = documents.where("text is not null").select(lang, F.col("text").cast("binary").alias("text"))
    counted = in_arrow(texts, _count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = saved(counted.where((F.col("n") >= least) | F.col("word").isNull()), "word-counts")
    totals = counts.where("word is null").select("lang", "n")
    words = saved(numbered(counts.where("word is not null"), "frequent-words"), "frequent-words")
    n = _size_of(words, "words")
    blocks, known, found = None, None, []
    for k in range(1, most_words + 1):
        if k == 1:
            known = words.select("id", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), F.col("n").alias("a"), F.array("n").alias("heads"), F.array("n").alias("tails"))
        else:
            pairs = in_arrow(blocks, _count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
            level = saved(numbered(pairs, f"frequent-{k}"), f"frequent-{k}")
            n = _size_of(level, f"phrases of {k} words")
            first, second = F.shiftrightunsigned("pair", 32).alias("first"), F.col("pair").bitwiseAND(MOST_NUMBERS - 1).alias("second")
            left = known.select(F.col("id").alias("first"), "lang", "phrase", "heads")
            right = known.select(F.col("id").alias("second"), "last", "tails")
            joined = level.select("id", "a", first, second).join(left, "first").join(right, "second")
            longer = F.concat_ws(" ", "phrase", "last").alias("phrase")
            own = F.array("a")
            # of parts that begin (and end) a phrase the counts are known from the level before
            joined = saved(joined.select("id", "first", "second", "lang", longer, "last", "a", F.concat("heads", own).alias("heads"), F.concat("tails", own).alias("tails")), f"level-{k}")
            if k > 2:
                around = joined.select(F.col("first").alias("id"), "a").union(joined.select(F.col("second").alias("id"), "a"))
                around = around.groupBy("id").agg(F.max("a").alias("longer"))
                found[-1] = found[-1].join(around, "id", "left").where("longer is null or longer < a").drop("longer")
            found.append(_scored(joined.join(totals, "lang"), k))
            known = joined
        if not n or k == most_words:
            break
        if k == 1:
            chunks = map(_word_numbers, _chunks(words, ["lang", "word"], n, chunk_words))
            blocks = _next_blocks(texts, chunks, -(-n // chunk_words), _code_words, _code_words_of, "lang string, text binary, numbers binary", "blocks-1")
        else:
            chunks = map(_pair_numbers, _chunks(level, ["pair"], n, chunk_pairs))
            after = _next_blocks(blocks, chunks, -(-n // chunk_pairs), _code_pairs, _code_pairs_of, "numbers binary, next binary", f"blocks-{k}")
            discard(blocks)
            blocks = after
    empty = documents.sparkSession.createDataFrame([], "id long, lang string, phrase string, a long, l long, r long, n long, score long")
    every = empty
    for level in found:
        every = every.unionByName(level)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents, as ``collocations`` defines them."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p
), t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang), g AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w CROSS JOIN range(1, 6) AS r(k) WHERE len(words) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS words FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100
), c AS (
  SELECT lang, phrase, k, f AS a, words, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), s AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.f AS l, r.f AS r, t.n, c.cut, CAST(1000::HUGEINT * c.a * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM c JOIN t ON t.lang = c.lang
  JOIN f AS l ON l.lang = c.lang AND l.k = c.cut AND l.phrase = array_to_string(c.words[1:c.cut], ' ')
  JOIN f AS r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.phrase = array_to_string(c.words[c.cut + 1:c.k], ' ')
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s
), i AS (
  SELECT lang, array_to_string(words[b:b + m - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, words, f, k, m, unnest(range(1, k - m + 2)) AS b FROM f CROSS JOIN range(2, 5) AS q(m) WHERE m < k) GROUP BY 1, 2
), kept AS (
  SELECT o.* FROM o LEFT JOIN i ON i.lang = o.lang AND i.phrase = o.phrase WHERE o.nth = 1 AND (i.f IS NULL OR 100 * i.f < 100 * o.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
) WHERE rank <= 2000
"""
