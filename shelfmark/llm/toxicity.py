"""Toxicity by multiple-instance learning.

Labels are of documents, offences are in sentences. A sentence has a score, the logistic of the
weights of its words and of their beginnings; a document's score is the noisy-or of its sentences:
one minus the product of (1 - score). Weights are trained through the noisy-or from document
labels, so the trained sentence scores tell where the offence is.

1. Count, over all labelled training documents, in how many of each class each feature occurs
   (equal texts count once); features tied to the class by their likelihood ratio are the model's.
2. Fit weights on the sentences of a bounded sample of the training documents.
3. Score all texts, whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_arrow, in_batches, saved, table, whole_text
from .words import Ragged, WordTable, chunks, long_parts

#: Labelled documents of which the sentences are used to fit weights (the bound of the sample).
FIT_DOCUMENTS = 20_000
#: Least likelihood ratio of a feature; there are no more features than buckets.
LEAST_RATIO = 16.0
#: A feature's share of toxic documents is at least so many times its share of clean ones.
LEAST_LIFT = 3
BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Score of a document without evidence.
LEAK = 1e-3
#: Characters that end a sentence.
ENDS = (ord("."), ord("!"), ord("?"), ord("\n"))


def word_list_features(words: list[str]) -> list[list[int]]:
    """Buckets of each word and of its beginnings; none for words that don't begin with a letter."""
    keys, size = [], []
    for word in words:
        own = [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)] if word[:1].isalpha() else []
        keys += own
        size.append(len(own))
    if not keys:
        return [[] for _ in words]
    buckets = (pd.util.hash_array(np.array(keys, object)) % np.uint64(BUCKETS)).astype(np.int64).tolist()
    stops = np.cumsum(size).tolist()
    return [buckets[a:b] for a, b in zip([0, *stops], stops)]


@dataclass
class Sentences:
    """Sentences of some texts: index of the text, start and stop of the words in the lower-cased text,
    and the distinct pairs of sentence and feature."""

    of: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    feature: np.ndarray


class Featurizer:
    """Words of texts with their features; sentences by the characters that end one."""

    def __init__(self, value=None):
        self.values = Ragged()
        self.table = WordTable(False, lambda words: self.values.extend([value(x) for x in word_list_features(words)] if value else word_list_features(words)), self.values.clear)

    def _part(self, texts: list[str]) -> tuple[Sentences, int]:
        """``Sentences`` of lower-cased texts, each row with the number of ends before it in ``row``'s
        place of order, and the number of all ends."""
        words = self.table.look_up(texts)
        codes = np.frombuffer(words.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.isin(codes, ENDS)
        ends[words.text_starts[(words.text_starts < len(ends)) & (words.text_starts > 0)] - 1] = True
        number = (np.cumsum(ends) - ends)[words.starts] if len(codes) else np.zeros(0, np.int64)
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(number)) - 1 if len(first) else first
        found, size = self.values.take(words.slot)
        pairs = np.unique(np.repeat(number, size) << 32 | found)
        of = words.of[first]
        base = words.text_starts[of]
        self.numbers = number[first]
        return Sentences(of, words.starts[first] - base, words.stops[last] - base, pairs >> 32, pairs & 0xFFFFFFFF), int(ends.sum())

    def sentences(self, texts: list[str]) -> Iterator[tuple[list[int], Sentences]]:
        """Groups of texts, by index, with their sentences. A very long text is a group of its own; it is
        read in parts, and a sentence that goes on in the next part stays one sentence."""
        for group in chunks(texts):
            if len(group) > 1:
                parts, of = [[texts[i].lower() for i in group]], None
            else:
                parts, of = ([part] for part in long_parts(texts[group[0]].lower())), 0
            held, before, passed = [], 0, 0
            for part in parts:
                found, ends = self._part(part)
                number = self.numbers + before
                held.append((number, found.of, found.start + passed, found.stop + passed, found.row + before, found.feature))
                before += ends
                passed += len(part[0]) if of == 0 else 0
            number, text, start, stop, row, feature = (np.concatenate(x) for x in zip(*held, strict=True))
            known, first = np.unique(number, return_index=True)
            stops = np.zeros(len(known), np.int64)
            np.maximum.at(stops, np.searchsorted(known, number), stop)
            pairs = np.unique(np.searchsorted(known, row) << 32 | feature)
            yield group, Sentences(text[first], start[first], stops, pairs >> 32, pairs & 0xFFFFFFFF)


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with each feature, by class, of this partition; a document counts once, however long."""
    counts = np.zeros((2, BUCKETS), np.int32)
    features = Featurizer()
    for batch in batches:
        labels, texts = batch.label.to_numpy(), batch.text.tolist()
        for group, found in features.sentences(texts):
            both = np.unique(found.of[found.row] << 32 | found.feature)
            np.add.at(counts, (labels[np.array(group)][both >> 32], both & 0xFFFFFFFF), 1)
    there = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bucket": there, "clean": counts[0, there], "toxic": counts[1, there]})


def choose_features(counts: pd.DataFrame, clean: int, toxic: int) -> np.ndarray:
    """Buckets much more frequent in toxic documents, and not by chance; the strongest first."""
    a, b = counts.toxic.to_numpy(float), counts.clean.to_numpy(float)
    rate = (a + b) / (clean + toxic)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    ratio = 2 * (part(a, toxic * rate) + part(b, clean * rate) + part(toxic - a, toxic * (1 - rate)) + part(clean - b, clean * (1 - rate)))
    ratio[(a / max(toxic, 1) < LEAST_LIFT * b / max(clean, 1)) | (a < 4)] = 0
    order = np.lexsort((counts.bucket.to_numpy(), -ratio))
    return counts.bucket.to_numpy()[order[ratio[order] >= LEAST_RATIO]]


def _sentences(batches: Iterator[pd.DataFrame], chosen: list[int]) -> Iterator[pd.DataFrame]:
    """Of each document the chosen features of each sentence that has any, one after the other, and
    how many each has (32-bit numbers)."""
    index = {b: i for i, b in enumerate(chosen)}
    features = Featurizer(lambda buckets: [index[b] for b in buckets if b in index])
    for batch in batches:
        sizes, flat = [b""] * len(batch), [b""] * len(batch)
        for group, found in features.sentences(batch.text.tolist()):
            of = found.of[found.row]
            for k, i in enumerate(group):
                own = slice(*np.searchsorted(of, [k, k + 1]))
                sizes[i] = np.unique(found.row[own], return_counts=True)[1].astype("<i4").tobytes()
                flat[i] = found.feature[own].astype("<i4").tobytes()
        yield pd.DataFrame({"h": batch.h, "label": batch.label, "sizes": sizes, "features": flat})


@dataclass(frozen=True)
class Model:
    """Weights of chosen buckets, the bias of a sentence that has any, and the score of documents without."""

    chosen: list[int]
    weights: list[float]
    bias: float
    leak: float


def fit(rows: pd.DataFrame, chosen: list[int], leak: float, steps: int = 400, decay: float = 2e-3) -> Model:
    """Weights by gradient steps on the noisy-or likelihood of document labels."""
    size = np.frombuffer(b"".join(rows.sizes), "<i4")
    of = np.repeat(np.arange(len(rows)), rows.sizes.map(len).to_numpy(np.int64) // 4)
    f = np.frombuffer(b"".join(rows.features), "<i4").astype(np.int64)
    y = rows.label.to_numpy(float)
    s = np.repeat(np.arange(len(size)), size)
    w, b = np.full(len(chosen), 0.5), -2.0
    mean, spread = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for step in range(1, steps + 1 if len(of) else 0):
        z = np.clip(np.bincount(s, w[f], len(size)) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + np.log1p(-leak)
        out = np.clip(-np.expm1(none), 1e-9, 1 - 1e-12)
        # d likelihood / d z = p * (1 / out - 1) for toxic documents, -p for clean ones
        g = share[of] * np.where(y[of] == 1, p * (1 / out[of] - 1), -p)
        grad = np.append(np.bincount(f, g[s], len(w)) - decay * w / len(w), g.sum())
        mean, spread = 0.9 * mean + 0.1 * grad, 0.999 * spread + 0.001 * grad**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        w, b = w + move[:-1], b + move[-1]
    return Model(list(map(int, chosen)), w.tolist(), float(b), leak)


def train(docs: DataFrame, labels: DataFrame, learns: Column, sample: int = FIT_DOCUMENTS) -> Model:
    """A model from the documents of which ``learns`` holds and that have a label 0 or 1.

    Classes are counted over all of them; weights are fitted on about ``sample`` at most, taken by a
    hash of their text. Equal texts count once, with the label of the least doc_id; a doc_id with
    several labels counts as toxic if one is; null labels, null doc_ids and documents without a label
    take no part. Without labels of both classes, as in an empty table, the model knows no features.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    texts = docs.where(learns).select("doc_id", whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    once = texts.select("doc_id", "h").join(marked, "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "label")).alias("m"))
    # texts are shuffled once, whatever the number of labels: the side of labels is never broadcast
    known = texts.join(once.select("m.*", "h").hint("merge"), ["doc_id", "h"])
    # repeated rows lie side by side after the join, which has sorted by doc_id and hash
    nth = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("label"))
    known = saved(known.withColumn("nth", nth).where("nth = 1").drop("nth"), "labelled")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        discard(known)
        return Model([], [], -2.0, LEAK)
    counts = in_batches(known.select("label", "text"), _class_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # at most BUCKETS rows; those that can't reach the least ratio stay behind
    chosen = choose_features(counts.where(f"toxic >= 4 and toxic * {sizes[0]} >= {LEAST_LIFT} * clean * {sizes[1]}").toPandas(), sizes[0], sizes[1]).tolist()
    total = sizes[0] + sizes[1]
    fitted = known.select("h", "label", "text") if total <= sample else known.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * sample / total)).select("h", "label", "text")
    rows = in_batches(fitted, partial(_sentences, chosen=chosen), "h long, label int, sizes binary, features binary").toPandas()
    discard(known)
    return fit(rows.sort_values("h"), chosen, LEAK)


SCORED = "doc_id long, score double, n_sentences int, worst_start long, worst_end long, worst_score double"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score_texts(texts: list[str], model: Model, features: Featurizer) -> dict[str, list]:
    """For each text: the noisy-or of its sentences, their number, and place and score of those with a known feature."""
    weights = np.array([*model.weights, 0.0])
    none = np.full(len(texts), np.log1p(-model.leak))
    count = np.zeros(len(texts), np.int32)
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    for group, found in features.sentences(texts):
        at = np.array(group)
        total = np.bincount(found.row, weights[found.feature], len(found.of))
        hit = np.bincount(found.row, minlength=len(found.of)) > 0
        p = np.where(hit, 1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30))), 0.0)
        np.add.at(none, at[found.of], np.log1p(-np.minimum(p, 1 - 1e-12)))
        np.add.at(count, at[found.of], 1)
        for k in np.flatnonzero(hit).tolist():
            spans[group[found.of[k]]].append((int(found.start[k]), int(found.stop[k]), float(p[k])))
    return {"score": np.clip(-np.expm1(none), 0, 1), "n_sentences": count, "spans": spans}


def model_features(model: Model) -> Featurizer:
    index = dict(zip(model.chosen, range(len(model.chosen)), strict=True))
    return Featurizer(lambda buckets: [index[b] for b in buckets if b in index])


def _score(batches: Iterator[pa.RecordBatch], model: Model, spans: bool) -> Iterator[pa.RecordBatch]:
    features = model_features(model)
    for batch in batches:
        out = score_texts(batch.column("text").to_pylist(), model, features)
        # the worst sentence: the first one of the highest score
        worst = [max(x, key=lambda s: s[2], default=(0, 0, 0.0)) for x in out["spans"]]
        start, end, score = zip(*worst, strict=True) if worst else [()] * 3
        columns = {
            "doc_id": batch.column("doc_id"),
            "score": pa.array(out["score"], pa.float64()),
            "n_sentences": pa.array(out["n_sentences"], pa.int32()),
            "worst_start": pa.array(start, pa.int64()),
            "worst_end": pa.array(end, pa.int64()),
            "worst_score": pa.array(score, pa.float64()),
        }
        if spans:
            columns["spans"] = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in x] for x in out["spans"]], SPANS)
        yield pa.RecordBatch.from_pydict(columns)


def score_documents(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """score of each document (0 to 1), its number of sentences, and the worst sentence: place in
    the lower-cased text and score (0 and 0 where no sentence has a known feature).

    ``spans`` adds all sentences with a known feature. Null and empty texts get the score of a
    document without evidence; a null doc_id stays null. One row for each row of ``docs``, repeated
    ones as well; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = SCORED + ", spans array<struct<start:long,end:long,score:double>>" * spans
    return in_arrow(rows, partial(_score, model=model, spans=spans), schema)


def _with_scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    features = model_features(model)
    for batch in batches:
        score = score_texts([t or "" for t in batch.column("text").to_pylist()], model, features)["score"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns and ``score`` (one of that name is replaced)."""
    rows = docs.drop("score")
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])
    return in_arrow(rows, partial(_with_scores, model=model), schema)


def held_out() -> Column:
    """Rows that the model never learns from: crc32 of the doc_id's text, modulo 3, is 1."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document's whole text by a model of the labelled rows that aren't held out, and
    1 where it is at least 0.7. A null doc_id is not held out and never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score_documents(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst_start", "worst_end", "worst_score")
