"""Vectorised word splitting and a bounded table of words, used inside Arrow tasks.

Texts of a batch are laid out as one array of code points. Word borders, word hashes and the
lookup of each distinct word run in numpy; only words not met before reach Python code.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Characters handled at once, so that a batch of long texts stays small in memory.
CHUNK_CHARS = 400_000
WEIGHTS = 1 << 14
SURROGATES = range(0xD800, 0xE000)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of each code point by the tokenizers library's own patterns, as its Unicode version
    and Python's differ in newly assigned letters. Surrogates, which no text of Spark holds, are OTHER."""
    from tokenizers import Regex, normalizers

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if c not in SURROGATES)
    for kind, pattern in ((LETTER, r"[^\p{L}]+"), (NUMBER, r"[^\p{N}]+"), (SPACE, r"[^\s]+")):
        table[code_points(normalizers.Replace(Regex(pattern), "").normalize_str(every))] = kind
    return table


@lru_cache(maxsize=1)
def hash_weights() -> np.ndarray:
    return np.random.default_rng(20_240_607).integers(1, 1 << 63, WEIGHTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def borders(codes: np.ndarray, text_starts: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words.

    ``spaces`` keeps white space: one plain space joins the word after it, longer runs stand as
    words of their own, digits stay together. Without it white space goes and each digit is a word.
    English contractions ('s 't 're 've 'm 'll 'd) are split off in both.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = char_classes()[codes]
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run[text_starts[text_starts < n]] = True
    begins = np.flatnonzero(run)
    ends = np.append(begins[1:], n)
    heads = kind[begins]
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[text_starts] = True
    first_of_text[n] = True
    start = np.append(run, True)
    if spaces:
        before_word = ends[(heads == SPACE) & ~first_of_text[ends]]
        start[before_word - 1] = True
        start[before_word[codes[before_word - 1] == 32]] = False
    else:
        start[:n] |= kind == NUMBER
    quote = np.flatnonzero((ends - begins == 1) & (codes[begins] == 39))
    quote = quote[quote < len(begins) - 1]
    quote = quote[(heads[quote + 1] == LETTER) & ~first_of_text[ends[quote]] & start[begins[quote]]]
    if len(quote):
        at, word_end = begins[quote], ends[quote + 1]
        one = codes[at + 1]
        two = np.where(at + 2 < word_end, codes[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long & ~short] + 3] = True
    starts = np.flatnonzero(start[:n])
    stops = np.append(starts[1:], n)
    if not spaces:
        words = kind[starts] != SPACE
        starts, stops = starts[words], stops[words]
    return starts, stops


def word_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of each word's code points and length."""
    if not len(starts):
        return np.zeros(0, np.int64)
    size = stops - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    values = codes if len(codes) == len(place) else codes[place + np.repeat(starts, size)]
    weights = hash_weights()
    factor = weights[place & (WEIGHTS - 1)]
    if int(size.max()) > WEIGHTS:
        factor = factor + (place >> 14).astype(np.uint64) * weights[7]
    total = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * factor, first)
    total = (total ^ (size.astype(np.uint64) * weights[3])) * weights[11]
    return (total ^ (total >> np.uint64(29))).view(np.int64)


def long_parts(text: str, limit: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut only before a single space between
    two other characters, where a word starts in any case."""
    at = 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut > 0 and (text[cut - 1].isspace() or cut + 1 < len(text) and text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut <= 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@dataclass
class Words:
    """Words of a chunk: index of the text, slot in the table, start and stop in ``joined``."""

    of: np.ndarray
    slot: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    text_starts: np.ndarray
    joined: str


class WordTable:
    """Gives each distinct word a slot. ``add`` is called with the words not met before and must
    append their values in this order; ``clear`` empties the values once ``most`` words are held."""

    def __init__(self, spaces: bool, add: Callable[[list[str]], None], clear: Callable[[], None], most: int = 1_200_000):
        self.spaces, self.add, self.clear, self.most = spaces, add, clear, most
        self._empty()

    def _empty(self) -> None:
        self.hashes, self.slots = np.full(1, np.iinfo(np.int64).max), np.full(1, -1, np.int64)

    def look_up(self, texts: list[str]) -> Words:
        joined = "".join(texts)
        codes = code_points(joined)
        text_starts = np.cumsum([0, *map(len, texts)])[:-1].astype(np.int64)
        starts, stops = borders(codes, text_starts, self.spaces)
        index, distinct = pd.factorize(word_hashes(codes, starts, stops))
        if len(self.slots) > self.most:
            self._empty()
            self.clear()
        place = np.searchsorted(self.hashes, distinct)
        slots = np.where(self.hashes[place] == distinct, self.slots[place], -1)
        new = np.flatnonzero(slots < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[index[::-1]] = np.arange(len(index))[::-1]
            self.add([joined[a:b] for a, b in zip(starts[first[new]].tolist(), stops[first[new]].tolist(), strict=True)])
            slots[new] = np.arange(len(new)) + len(self.slots) - 1
            order = np.argsort(distinct[new])
            self.hashes = np.insert(self.hashes, place[new][order], distinct[new][order])
            self.slots = np.insert(self.slots, place[new][order], slots[new][order])
        of = np.searchsorted(text_starts, starts, "right") - 1
        return Words(of, slots[index], starts, stops, text_starts, joined)


class Ragged:
    """Growing list of integer lists, read back by slot."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.flat, self.size, self.fresh, self.fresh_size = np.zeros(0, np.int32), np.zeros(0, np.int32), [], []

    def extend(self, lists: list[list[int]]) -> None:
        for x in lists:
            self.fresh += x
        self.fresh_size += map(len, lists)

    def take(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the slots one after the other, and how many each slot has."""
        if self.fresh_size:
            self.flat = np.append(self.flat, np.array(self.fresh, np.int32))
            self.size = np.append(self.size, np.array(self.fresh_size, np.int32))
            self.offset = np.cumsum(self.size, dtype=np.int64) - self.size
            self.fresh, self.fresh_size = [], []
        if not len(slots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = self.size[slots].astype(np.int64)
        first = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.offset[slots] - first, size)], size


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[list[int]]:
    """Indexes of the texts in groups of about ``limit`` characters."""
    group, held = [], 0
    for i, text in enumerate(texts):
        if group and held + len(text) > limit:
            yield group
            group, held = [], 0
        group.append(i)
        held += len(text)
    if group:
        yield group


class TextEncoder:
    """Token ids of texts: words by way of a table, ``encode_words`` for those not met before.

    ``prepare`` is what the tokenizer does to a text before it splits it. A text with one of
    ``specials`` in it is cut there, and the special token's id stands in its place.
    """

    def __init__(self, spaces: bool, encode_words: Callable[[list[str]], list[list[int]]], specials: dict[str, int], prepare: Callable[[str], str] = str):
        self.values, self.encode_words, self.specials, self.prepare = Ragged(), encode_words, specials, prepare
        self.table = WordTable(spaces, lambda words: self.values.extend(self.encode_words(words)), self.values.clear)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in the order of ``texts``."""
        for group in chunks(texts):
            some = [texts[i] for i in group]
            if len(some) == 1 and len(some[0]) > CHUNK_CHARS or any(s in t for s in self.specials for t in some):
                for text in some:
                    yield np.concatenate([np.zeros(0, np.int32), *self._cut(text)])
            else:
                yield from self._plain(some)

    def _cut(self, text: str) -> Iterator[np.ndarray]:
        # every second part is a special token; of those that begin at one place the longest counts
        longest_first = sorted(self.specials, key=len, reverse=True)
        parts = re.split(f"({'|'.join(map(re.escape, longest_first))})", text) if longest_first else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield np.array([self.specials[part]], np.int32)
            elif part:
                yield from self._cut_plain(part)

    def _cut_plain(self, text: str) -> Iterator[np.ndarray]:
        for part in long_parts(text):
            yield from self._plain([part])

    def _plain(self, texts: list[str]) -> Iterator[np.ndarray]:
        words = self.table.look_up([self.prepare(t) for t in texts])
        ids, size = self.values.take(words.slot)
        per_text = np.bincount(words.of, size, len(texts)).astype(np.int64) if len(size) else np.zeros(len(texts), np.int64)
        yield from np.split(ids, np.cumsum(per_text)[:-1])


@lru_cache(maxsize=1)
def plain_letters() -> np.ndarray:
    """Code points for which Python's NFC and lower case are the tokenizers library's as well.

    These are old ones (of Unicode 3.2: what is assigned is never normalised in another way later) and
    such as have no part in normalisation; of both only those whose lower case is the library's.
    """
    from tokenizers import normalizers

    old, end = unicodedata.ucd_3_2_0, 0x32400
    points = [c for c in range(end) if c not in SURROGATES and c != 10]
    lower = normalizers.Lowercase().normalize_str("\n".join(map(chr, points))).split("\n")
    seconds = {int(x, 16) for c in points for x in unicodedata.decomposition(chr(c)).split()[1:] if x[0] != "<"}
    table = np.zeros(0x110000, bool)
    table[10] = True
    for c, low in zip(points, lower, strict=True):
        x = chr(c)
        inert = unicodedata.category(x) != "Cn" and not unicodedata.combining(x) and not unicodedata.decomposition(x) and c not in seconds
        table[c] = (inert or old.category(x) != "Cn") and (low == x.lower() or x == "Σ")
    return table


class Lowered:
    """NFC, then lower case letter by letter (a capital sigma always becomes the middle form), as the
    tokenizers library does: by Python where both agree for all of a text's letters, else by the library."""

    def __init__(self) -> None:
        from tokenizers import normalizers

        self.plain = plain_letters()
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.plain[code_points(text)].all():
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.library.normalize_str(text)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file of the tokenizers library, without added special tokens; a
    worker keeps it, with its words, from task to task.

    Knows the two layouts of public files: byte-level with spaces, and lower-cased words with word ends.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        layout = json.load(file)
    specials = special_tokens(layout)
    lower = layout["normalizer"] is not None

    def encode_words(words: list[str]) -> list[list[int]]:
        coded = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, stops = coded.ids, np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(words))).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]

    return TextEncoder(not lower, encode_words, specials, Lowered() if lower else str)


def special_tokens(layout: dict) -> dict[str, int]:
    """Special tokens of a tokenizer file and their ids; an error where one also takes in what stands beside it."""
    for x in layout["added_tokens"]:
        if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized"):
            raise ValueError(f"added token {x['content']!r}: single_word, lstrip, rstrip and normalized are not known here")
    return {x["content"]: x["id"] for x in layout["added_tokens"]}
