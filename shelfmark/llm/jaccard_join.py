"""N-gram Jaccard join by parity sketches.

Two sets with Jaccard similarity of at least t differ in at most d = (1-t)/(1+t) * (|A|+|B|)
members. Each set's shingles are dealt to parts by hash; in a part, each shingle flips one bit of a
64-bit parity word. The Hamming distance of two sets' words is at most the size of their symmetric
difference, so of any d+1 parts one at least agrees: sets are joined on (size band, part, word).
The XOR of the full shingle hashes goes into the join key as well; it also agrees where no shingle
of the part differs.

A set gives the keys of the d+1 largest parts it has, as large parts agree by chance least, and none
of empty parts, which agree between most sets. Of two sets, take the one whose last part given is
earlier in the order by size and key: one of its d+1 parts agrees, and the other set, which gives all
its parts up to there, gives it too. There are more parts than d+1, so that few sets have fewer that
aren't empty; those give all their parts and the empty ones as well, which agree among themselves.

Pairs of a group are listed only where its members are in different components (step 3):

1. Sets equal in all are one class; classes are the nodes of the graph.
2. In each join key, all members are compared with a few of the key's classes only, its centres: the
   first ones by several hashes, so that keys of one group of copies mostly have the same centres.
3. Links make components. Keys whose members are in several components are joined once more, for
   pairs of different components. Pairs inside one component need no comparison.
4. Of these pairs only those are compared whose sizes and whole-set parity sketches allow a link. A
   whole-set sketch has two to four bits for each shingle; half of a longer one, folded by XOR on
   the other half, is the sketch of half the length, so sets of different sizes can be held together.
5. Comparisons are exact, on the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_arrow, in_batches, saved, table, whole_text
from .words import CHUNK_CHARS, chunks, word_hashes

WIDTH, PERCENT = 5, 80
#: Last size of a band by its first one, at least; parts of a band for d differences: ``d * SPREAD + SPARE``.
BAND_GROWTH = 1.25
SPREAD, SPARE = 1.5, 10
#: Centres of a join key besides its first and last class.
CENTRES = 2
#: Least number of 64-bit words of a whole-set sketch.
LEAST_WORDS = 4
#: Bits of the filter that keeps texts from being cut into sets which no pair needs (2 MB, whatever the input).
FILTER_BITS = 1 << 24


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), over uint64 arrays."""
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """First size of each band, and the most members in which its pairs differ; 0 where only equal
    sets can link.

    A pair belongs to the band of its smaller set; the larger one has at most 100 / percent its size,
    so it is in the same band or the next one.
    """
    first, growth = [1], max(BAND_GROWTH, 100 / percent)
    while first[-1] < 1 << 34:
        first.append(max(first[-1] + 1, int(first[-1] * growth)))
    differ = [(end - 1 + (end - 1) * 100 // percent) * (100 - percent) // (100 + percent) for end in first[1:]]
    return np.array(first), np.array([*differ, 0])


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and hash of each distinct shingle, in this order.

    Words are runs of other than space and U+0009 to U+000D, A to Z lower-cased. A text of fewer
    than ``width`` words has them all as its one shingle.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    text_starts = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    solid = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, stops = edges[::2], edges[1::2]
    words = word_hashes(data, starts, stops).view(np.uint64)
    of = np.searchsorted(text_starts, starts, "right") - 1
    count = np.bincount(of, minlength=len(texts))
    odd = mixed(np.arange(1, width + 1, dtype=np.uint64), 77) | np.uint64(1)
    n = max(len(words) - width + 1, 0)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += words[j : j + n] * odd[j]
    whole = of[:n] == of[width - 1 : width - 1 + n]
    found_of, found = [of[:n][whole]], [mixed(total[whole])]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        begins = np.searchsorted(of, short)
        total = count[short].astype(np.uint64)
        for j in range(width - 1):
            there = count[short] > j
            total[there] += words[begins[there] + j] * odd[j]
        found_of.append(short)
        found.append(mixed(total, 5))
    of, found = np.concatenate(found_of), np.concatenate(found)
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    first = np.append(True, (of[1:] != of[:-1]) | (found[1:] != found[:-1])) if len(of) else np.zeros(0, bool)
    return of[first], found[first]


def part_keys(of: np.ndarray, shingles: np.ndarray, differ: np.ndarray, band: np.ndarray, n: int) -> list[np.ndarray]:
    """Join keys of each of ``n`` sets. ``differ`` and ``band`` are by set; sets with 0 differences have none."""
    parts = np.where(differ > 0, (differ * SPREAD).astype(np.int64) + SPARE, 0)
    used = parts[of] > 0
    of, shingles = of[used], shingles[used]
    if not len(of):
        return [np.zeros(0, np.int64)] * n
    part = ((mixed(shingles, 11) >> np.uint64(20)) % parts[of].astype(np.uint64)).astype(np.int64)
    place = of * (int(parts.max()) + 1) + part
    order = np.argsort(place, kind="stable")
    place, of, part, shingles = place[order], of[order], part[order], shingles[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    size = np.diff(np.append(first, len(place))).astype(np.uint64)
    word = np.bitwise_xor.reduceat(np.uint64(1) << (mixed(shingles, 23) & np.uint64(63)), first)
    whole = np.bitwise_xor.reduceat(shingles, first)

    def key(band, part, word, whole, size):
        where = mixed(np.asarray(band).astype(np.uint64) << np.uint64(40) | np.asarray(part).astype(np.uint64), 31)
        return mixed(where ^ mixed(word, 41) ^ mixed(whole, 43), 47) + mixed(size, 53)

    of, part = of[first], part[first]
    keys = key(band[of], part, word, whole, size).view(np.int64)
    present = np.bincount(of, minlength=n)
    order = np.lexsort((keys, -size.astype(np.int64), of))
    nth = np.arange(len(of)) - np.repeat(np.cumsum(present) - present, present)
    given = order[nth <= differ[of]]
    out = np.split(keys[given], np.cumsum(np.minimum(present, differ + 1))[:-1])
    zero = np.zeros(1, np.uint64)
    for i in np.flatnonzero((present > 0) & (present <= differ)).tolist():
        empty = np.setdiff1d(np.arange(parts[i]), part[of == i])
        out[i] = np.append(out[i], key(np.full(len(empty), band[i]), empty, zero, zero, zero).view(np.int64))
    return out


def _class_of(of: np.ndarray, shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set as a whole."""
    some = np.flatnonzero(size)
    sums = np.zeros(len(size), np.uint64)
    if len(some):
        sums[some] = np.add.reduceat(mixed(shingles, 3), np.searchsorted(of, some))
    return mixed(sums ^ mixed(size.astype(np.uint64), 7), 9).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Size, class and whole-set sketch of each text, beside the other columns."""
    for batch in batches:
        kept = batch.drop_columns(["text"])
        texts = batch.column("text").to_pylist()
        for group in chunks(texts, CHUNK_CHARS):
            of, shingles = shingle_sets([texts[i] for i in group], width)
            size = np.bincount(of, minlength=len(group))
            words = np.maximum(LEAST_WORDS, 1 << np.ceil(np.log2(np.maximum(size, 1) / 32)).astype(np.int64).clip(0))
            words[size == 0] = 0
            first = np.cumsum(words) - words
            bit = mixed(shingles, 61) & (words[of] * 64 - 1).astype(np.uint64)
            place = first[of] + (bit >> np.uint64(6)).astype(np.int64)
            flat = np.zeros(int(words.sum()), np.uint64)
            np.bitwise_xor.at(flat, place, np.uint64(1) << (bit & np.uint64(63)))
            own = kept.slice(group[0], len(group))
            sketch = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(flat.view(np.int64)))
            found = [pa.array(size.astype(np.int64)), pa.array(_class_of(of, shingles, size)), sketch]
            yield pa.RecordBatch.from_arrays([*own.columns, *found], names=[*own.schema.names, "n", "class", "sketch"])


def _keys(batches: Iterator[pd.DataFrame], width: int, percent: int) -> Iterator[pd.DataFrame]:
    """Join keys of each class, once for all equal sets of this partition."""
    first, differ = bands(percent)
    seen: set[int] = set()
    for batch in batches:
        texts = batch.text.tolist()
        for group in chunks(texts, CHUNK_CHARS):
            of, shingles = shingle_sets([texts[i] for i in group], width)
            n = len(group)
            size = np.bincount(of, minlength=n)
            classes = _class_of(of, shingles, size)
            fresh = np.zeros(n, bool)
            if len(seen) > 500_000:
                seen.clear()
            for i, c in enumerate(classes.tolist()):
                if c not in seen:
                    fresh[i] = True
                    seen.add(c)
            band = np.maximum(np.searchsorted(first, size, "right") - 1, 0)
            own = np.where(fresh & (size > 0), differ[band], 0)
            lower = np.where(fresh & (band > 0) & (size * percent <= 100 * (first[band] - 1)), differ[np.maximum(band - 1, 0)], 0)
            keys = [*part_keys(of, shingles, own, band, n), *part_keys(of, shingles, lower, band - 1, n)]
            yield pd.DataFrame({"key": np.concatenate(keys), "class": np.repeat(np.append(classes, classes), [len(k) for k in keys])})


def _sets(batches: Iterator[pa.RecordBatch], width: int, bits) -> Iterator[pa.RecordBatch]:
    """The sets of rows whose key may be asked for."""
    words = np.frombuffer(bits.value, np.int64)
    for batch in batches:
        keys = batch.column("row_key").to_numpy()
        place = keys.view(np.uint64) % np.uint64(FILTER_BITS)
        asked = np.flatnonzero(words[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63)) & np.uint64(1))
        texts = batch.column("text").take(pa.array(asked)).to_pylist()
        for group in chunks(texts, CHUNK_CHARS):
            of, shingles = shingle_sets([texts[i] for i in group], width)
            size = np.bincount(of, minlength=len(group))
            starts = np.append(0, np.cumsum(size)).astype(np.int32)
            found = [pa.array(keys[asked[group]]), pa.array(_class_of(of, shingles, size)), pa.ListArray.from_arrays(pa.array(starts), pa.array(shingles.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(found, names=["row_key", "class", "members"])


def _beside(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df`` with the row of ``other`` that has its key. The join key is the key's complement, so that
    both sides are dealt out for the join alone and a key with very many rows can be split among tasks."""
    return df.withColumn("_at", F.bitwise_not(key)).hint("merge").join(other.select(F.bitwise_not(key).alias("_at"), "least"), "_at").drop("_at")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of the nodes in ``links(a, b)``, a < b.

    Alternates large and small stars: nodes are tied to the smallest neighbour until nothing
    changes. Work tables are saved each round; neither links nor nodes pass through the driver.
    """
    edges, before = saved(links.select("a", "b").distinct(), "edges"), None
    while True:
        # large star: neighbours above u go to the least neighbour of u
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
        large = _beside(both.where("v > u"), least, "u").select(F.col("least").alias("a"), F.col("v").alias("b")).where("a < b")
        # small star: neighbours below b, and b, go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("least"))
        small = _beside(large, least, "b").select("least", F.explode(F.array("b", "a")).alias("x"))
        last, edges = edges, saved(small.where("least < x").select(F.col("least").alias("a"), F.col("x").alias("b")).distinct(), "edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(last)
        if now == before:
            break
        before = now
    label = edges.groupBy("b").agg(F.min("a").alias("label")).withColumnRenamed("b", "node")
    return label.union(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def _possible(percent: int) -> Column:
    """Whether sizes and whole-set sketches of x and y allow a similarity of ``percent``."""
    n, m, a, b = F.col("x.n"), F.col("y.n"), F.col("x.sketch"), F.col("y.sketch")
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent

    def folded(s: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        return F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def distance(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda total, d: total + d)

    # sets of such sizes have sketches of equal length, or one of twice the other's
    apart = F.when(F.size(a) == F.size(b), distance(a, b)).when(F.size(a) > F.size(b), distance(folded(a), b)).otherwise(distance(a, folded(b)))
    return F.when(fits, apart * (100 + percent) <= (n + m) * (100 - percent)).otherwise(False)


def _key_bits(keys: DataFrame) -> bytes:
    """A bit for each key, at its place modulo FILTER_BITS: an array of fixed size, whatever the input."""
    place = F.pmod(F.expr("cast(row_key as decimal(20,0)) + if(row_key < 0, 18446744073709551616BD, 0BD)"), F.lit(FILTER_BITS)).cast("long")
    bits = keys.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, np.int64)
    words[found.word.to_numpy()] = found.bits.to_numpy()
    return words.tobytes()


def _linked(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, compared exactly.

    Sets are made of the owners' texts, one row for each class in a pair. A filter of fixed size keeps
    most other texts from being cut into sets; the join with the owners decides, so the more keys the
    filter holds, the less work it saves, and no more.
    """
    involved = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    owners = saved(classes.select("class", "row_key").join(involved, "class"), "owners")
    bits = rows.sparkSession.sparkContext.broadcast(_key_bits(owners))
    sets = in_arrow(rows.select("row_key", "text"), partial(_sets, width=width, bits=bits), "row_key long, class long, members array<long>")
    # owners grow with the corpus: never broadcast; repeated rows have one key and one class
    sets = saved(sets.hint("merge").join(owners, ["row_key", "class"]).select("class", "members").dropDuplicates(["class"]), "sets")
    # saved tables on both sides, so a class with very many pairs can be split among tasks
    a, b = sets.select(F.col("class").alias("a"), F.col("members").alias("of_a")), sets.select(F.col("class").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    compared = pairs.hint("merge").join(b, "b").hint("merge").join(a, "a").where(both * 100 >= (F.size("of_a") + F.size("of_b") - both) * percent)
    links = saved(compared.select("a", "b"), "links")
    bits.destroy()
    discard(owners, sets)
    return links


def similar_classes(rows: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """class, label: component of each class that has a link to another one."""
    classes = sketches.where("n > 0").groupBy("class").agg(F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = saved(classes, "classes")
    keys = in_batches(rows.select("text"), partial(_keys, width=width, percent=percent), "key long, class long")
    of_key = Window.partitionBy("key")
    shared = keys.withColumn("low", F.min("class").over(of_key)).withColumn("high", F.max("class").over(of_key)).where("low < high")
    firsts = [F.min(F.struct(F.xxhash64("class", F.lit(seed)).alias("h"), "class")).over(of_key)["class"] for seed in range(CENTRES)]
    members = saved(shared.select("key", "class", F.array_distinct(F.array("low", "high", *firsts)).alias("ends")), "members")
    sketch = classes.drop("row_key")
    first = members.select(F.explode("ends").alias("end"), "class").where("end != class")
    first = first.select(F.least("end", "class").alias("a"), F.greatest("end", "class").alias("b")).distinct()
    first = first.join(sketch.alias("x"), F.col("a") == F.col("x.class")).join(sketch.alias("y"), F.col("b") == F.col("y.class")).where(_possible(percent)).select("a", "b")
    first = saved(first, "first-pairs")
    links = _linked(rows, classes, first, width, percent)
    label = saved(components(links), "labels")
    placed = members.select("key", "class").distinct().join(label.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    several = placed.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("key")
    open_ = saved(placed.join(several, "key").join(sketch, "class"), "open-members")
    across = open_.alias("x").join(open_.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") < F.col("y.label")) & _possible(percent))
    across = saved(across.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "across-pairs")
    discard(members, links, open_)
    if not across.isEmpty():
        more = _linked(rows, classes, across, width, percent)
        if not more.isEmpty():
            tied = label.select(F.col("label").alias("a"), F.col("node").alias("b")).where("a < b")
            label = saved(components(more.union(tied)), "labels")
        discard(more)
    discard(classes, first, across)
    return label.withColumnRenamed("node", "class")


def jaccard_groups(docs: DataFrame, *carried: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The columns ``carried``, n_shingles, and node: a number that rows have in common when links lead
    from one to the other; one row for each row of ``docs``.

    Documents link when their sets of ``width``-word shingles have a Jaccard similarity of at least
    ``percent`` hundredths. Null and empty texts, and texts without words, have an empty set, link with
    nothing and have no node. Rows with equal sets, repeated rows as well, have one node.
    """
    rows = docs.select(*carried, F.xxhash64(*carried, "text").alias("row_key"), whole_text().alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("n", T.LongType()), T.StructField("class", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))])
    sketches = saved(in_arrow(rows, partial(_sketch, width=width), schema), "sketches")
    label = similar_classes(rows, sketches, width, percent)
    # both sides are saved tables, so a class with very many rows can be split among tasks
    placed = sketches.select(*carried, "n", "class").hint("merge").join(label, "class", "left")
    return placed.select(*carried, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "class")).alias("node"))


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, one row for each row of ``docs``.

    Links are those of ``jaccard_groups``; a document that links with nothing is its own component.
    Rows without a doc_id are left out. Rows of one doc_id with different texts each get the component
    of their own text. An empty table gives no rows; other columns are not read.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = saved(jaccard_groups(known, "doc_id", width=width, percent=percent), "placed")
    least = placed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    linked = _beside(placed.where("node is not null"), least, "node").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return linked.unionByName(placed.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by links of 90 hundredths on three-word shingles, as
    ``jaccard_components`` defines them."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)
