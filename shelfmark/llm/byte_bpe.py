"""Byte-level BPE: speculate and verify.

A word is first cut by greedy longest match. A cut is the true encoding if and only if every
adjacent pair of its tokens is compatible, that is, BPE of the two tokens' bytes gives these two
tokens. The pairs of all words of a chunk are tested together in numpy: both tokens are unmerged
step by step, latest merge first, and at each step no earlier merge may lie across the border.
Words with a pair that fails are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table, whole_text
from .words import TextEncoder, special_tokens

NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable bytes stand for
    themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file (JSON with vocab and merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            layout = json.load(file)
        letters = byte_letters()
        vocab = layout["model"]["vocab"]
        self.specials = special_tokens(layout)
        self.token_bytes = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for word, i in vocab.items():
            if word not in self.specials:
                self.token_bytes[i] = bytes(letters[c] for c in word)
        for word, i in self.specials.items():
            self.token_bytes[i] = word.encode()
        self.ids = {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in self.specials}
        self.longest = max(map(len, self.ids))
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        n = len(self.token_bytes)
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(layout["model"]["merges"]):
            a, b = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[self.token_bytes[a] + self.token_bytes[b]]
            self.merges[a, b] = rank, whole
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int64)[order], NEVER)
        merged = np.flatnonzero(self.rank >= 0)
        self.whole = np.ones(n, bool)  # tokens that BPE of their own bytes gives back
        self.whole[merged] = self.compatible(self.left[merged], self.right[merged], self.rank[merged])
        for t in merged[np.argsort(self.rank[merged])].tolist():
            self.whole[t] &= self.whole[self.left[t]] and self.whole[self.right[t]]
        self.encoder = TextEncoder(True, self.encode_words, self.specials)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge of a rank below ``limit`` joins the end of ``a`` with the start of ``b``
        while the two are built."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if limit is None else limit.copy()
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x.astype(np.int64) << 32 | y
            at = np.searchsorted(self.pair_keys, key)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            bad = across < limit[open_]
            good[open_[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            ended = bad | (rx < 0) & (ry < 0)
            # Of two equal merges the left one comes first, so the right one is undone first, and a
            # merge across the border of the same rank as the right one comes before it.
            undo_left = rx > ry
            limit[open_] = np.where(undo_left, rx, ry + 1)
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
            open_ = open_[~ended]
        return good

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            for stop in range(min(n, at + longest), at, -1):
                i = ids.get(word[at:stop])
                if i is not None:
                    break
            out.append(i)
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the earliest merge first, of equal ones the leftmost."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > 64:
            return self._merge_long(parts)
        merges = self.merges
        while len(parts) > 1:
            best = min(((merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [merges[parts[i], parts[i + 1]][1]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for long words."""
        import heapq

        n, merges = len(parts), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j < 0 or parts[j] != y:
                continue
            parts[i], parts[j] = merges[x, y][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (parts[k], parts[after[k]])) in merges:
                    heapq.heappush(heap, (merges[p][0], k, *p))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = [self.greedy(w) for w in raw]
        size = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.array([i for x in out for i in x], np.int64)
        of = np.repeat(np.arange(len(out)), size)
        same = of[1:] == of[:-1]
        pairs, index = np.unique((flat[:-1] << 32 | flat[1:])[same], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.zeros(len(out), bool)
        failed[of[:-1][same][~good[index]]] = True
        failed[of[~self.whole[flat]]] = True
        for k in np.flatnonzero(failed).tolist():
            out[k] = self.merge(raw[k])
        return out

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.encoder.encode(texts)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """A worker keeps it, with its words, from task to task."""
    return ByteBpe(path)


def _coded(batches: Iterator[pa.RecordBatch], tokenizer: str, ids: bool) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(tokenizer)
    names = list(map(str, range(len(bpe.token_bytes)))).__getitem__
    for batch in batches:
        size, coded_sha, text_sha, lists = [], [], [], []
        for coded in bpe.encode(batch.column("text").to_pylist()):
            listed = coded.tolist()
            size.append(len(listed))
            coded_sha.append(hashlib.sha256(",".join(map(names, listed)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(listed).encode("utf-8", "surrogatepass")).hexdigest())
            if ids:
                lists.append(coded)
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(size, pa.int64()), "ids_sha256": pa.array(coded_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        if ids:
            columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(columns)


def encode_documents(docs: DataFrame, tokenizer: str, ids: bool = True) -> DataFrame:
    """Ids of each text with the digests of ids and decoded text; one row for each row of ``docs``.

    Null texts count as empty (no ids); a null doc_id stays null; repeated rows each have their row; an
    empty table gives no rows; other columns are not read. ``ids=False`` leaves the id arrays out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return in_arrow(rows, partial(_coded, tokenizer=tokenizer, ids=ids), schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of each whole text's ids and of the text they decode to, as
    ``encode_documents`` defines them."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
