"""Token files, packing and byte-level BPE against the tokenizers library."""

import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm import byte_bpe, packing, token_blocks
from shelfmark.llm.common import new_folder
from shelfmark.llm.words import library_encoder, long_parts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = st.text(alphabet="ab 'sretlmdvSL\n\t 　É9½!*#ßΣ<|>́日" + "\x1c\x85", max_size=40)


def library(path, texts):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, max_size=8))
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_word_table_encodes_as_the_library(path, texts):
    assert [x.tolist() for x in library_encoder(path).encode(texts)] == library(path, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(LETTERS, max_size=8))
def test_speculative_encoding_is_exact(texts):
    bpe, plain = byte_bpe.byte_bpe(BYTE), Tokenizer.from_file(BYTE)
    for text, ids, want in zip(texts, bpe.encode(texts), library(BYTE, texts), strict=True):
        assert ids.tolist() == want
        assert bpe.decode(want) == plain.decode(want, skip_special_tokens=False) == text


def test_some_words_fail_the_greedy_proposal_and_all_tokens_are_whole():
    bpe = byte_bpe.byte_bpe(BYTE)
    words = ["thntshand", "ererhely", "undoubtedly", "ationthere"]
    assert bpe.whole.all()
    assert [bpe.merge(w.encode()) for w in words] == bpe.encode_words(words) == library(BYTE, words)
    assert any(bpe.greedy(w.encode()) != bpe.merge(w.encode()) for w in words)
    assert bpe.merge(b"ab" * 100) == library(BYTE, ["ab" * 100])[0]


def test_long_parts_keep_the_ids():
    text = "word another  \n thing " * 200
    assert "".join(long_parts(text, 100)) == text
    encoder = library_encoder(BYTE)
    assert np.concatenate([next(encoder.encode([p])) for p in long_parts(text, 100)]).tolist() == library(BYTE, [text])[0]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_many_special_tokens_between_passages(path):
    texts = ["<|endoftext|>".join(["one passage"] * 5001), "<|endoftext|><|endoftext|> a <|endoftext|>" * 100, ""]
    assert [x.tolist() for x in library_encoder(path).encode(texts)] == library(path, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=400), st.sampled_from([0.0, 50.0, 90.0, 100.0]))
def test_blocks_round_trip(values, percentile):
    assert token_blocks.unpack_block(token_blocks.pack_block(np.array(values), percentile)).tolist() == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**20), max_size=30), max_size=12), st.integers(1, 17))
def test_files_round_trip(docs, block):
    out = io.BytesIO()
    token_blocks.write_blocks(out, [(i, np.array(d, np.int64)) for i, d in enumerate(docs)], block)
    reader = token_blocks.BlockFile(out)
    assert [(i, x.tolist()) for i, x in reader.documents()] == list(enumerate(docs))
    flat = [x for d in docs for x in d]
    assert [x for k in range(len(reader.starts) - 1) for x in reader.block(k).tolist()] == flat


def test_outliers_go_to_the_exception_list():
    values = np.array([5] * 99 + [1 << 30])
    assert len(token_blocks.pack_block(values)) < 40


def test_token_files(spark, make_docs, odd_texts):
    files = token_blocks.write_token_files(make_docs(odd_texts), new_folder(spark, "t"), BYTE)
    got = [tuple(r) for r in token_blocks.read_token_files(files).collect()]
    at, want = 0, []
    ordered = sorted(odd_texts, key=lambda x: (x[0], x[1] or ""))
    for (i, _), ids in zip(ordered, library(BYTE, [t for _, t in ordered]), strict=True):
        ids = np.array([*ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got) == sorted(want)
    empty = token_blocks.write_token_files(make_docs([]), new_folder(spark, "t"), BYTE)
    assert token_blocks.read_token_files(empty).count() == 0


def test_packing(make_docs, odd_texts):
    texts = odd_texts + odd_texts[:4]
    got = packing.packed_documents(make_docs(texts), WORD).collect()
    want = sorted((i, k // 2048, k, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes())) for (i, _), x in zip(texts, [[*x, 0] for x in library(WORD, [t for _, t in texts])], strict=True) for k in range(0, len(x), 2048))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.packed_documents(make_docs([]), WORD).count() == 0


def best_fit_decreasing(lengths, size):
    gaps = np.zeros(size + 1, int)
    bins = 0
    for x in sorted(lengths, reverse=True):
        fits = np.flatnonzero(gaps[x:])
        gap = fits[0] + x if len(fits) else size
        bins += not len(fits)
        gaps[gap] -= bool(len(fits))
        gaps[gap - x] += 1
    return bins


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=300))
def test_plan_uses_all_pieces_once_and_few_sequences(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    used = {}
    kinds = packing.plan_sequences(counts, 100)
    for kind, times in kinds:
        assert times > 0 and sum(x * n for x, n in kind.items()) <= 100
        for x, n in kind.items():
            used[x] = used.get(x, 0) + n * times
    assert used == counts
    total = sum(t for _, t in kinds)
    assert total <= best_fit_decreasing(lengths, 100) + max(2, total // 20)


def test_exact_complements_fill_sequences():
    assert sum(t for _, t in packing.plan_sequences({60: 5, 40: 5}, 100)) == 5
    assert sum(t for _, t in packing.plan_sequences({50: 4, 30: 4, 20: 4}, 100)) == 4
    assert sum(t for _, t in packing.plan_sequences({55: 3, 25: 3, 15: 3, 5: 3}, 100)) == 3


def test_byte_bpe_rows(make_docs, odd_texts):
    got = sorted(tuple(r) for r in byte_bpe.encode_documents(make_docs(odd_texts), BYTE, ids=False).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(t or "")) for (i, t), x in zip(odd_texts, library(BYTE, [t for _, t in odd_texts]), strict=True))
    assert byte_bpe.encode_documents(make_docs([]), BYTE).count() == 0
