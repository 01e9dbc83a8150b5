"""Packing: the tokenizer's own ids, gapless sequences, and how full they are."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sievegrid.llm import packing as op
from sievegrid.llm.queries import op10_best_fit_packing, word_bpe_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_bpe_path())


def test_ids_by_words_are_the_tokenizers(tokenizer):
    odd = ["It's I'VE a'b", "İstanbul", "é äb", "日本語 12３½", "ΣΑΣ", "<|endoftext|> a", "a <|endoftext|> b", "A<|endoftext|>B <|startoftext|><|endoftext|>", "a <|ENDOFTEXT|> <|endoftext b", "e<|endoftext|>\u0301", "a\x85b", "﻿q", "² 1a1", "foo_bar--baz...", "가각", "", " \n", "x" * 3000, "ͅ a"]
    got = op.WordIds(word_bpe_path()).encode([t.encode() for t in odd])
    for text, ids in zip(odd, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(r.doc_id, n, at, len(p), zlib.crc32(p.tobytes())) for n, at in enumerate(range(0, len(ids), 4096)) for p in [ids[at : at + 4096]]}
    got = op10_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    full = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert full.get(r.sequence_id, 0) == r.offset
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= 4096 and len(full) <= -(-sum(full.values()) // 4096) + 2


@pytest.mark.parametrize("seed", range(4))
def test_large_items_pair_and_small_ones_fill(seed):
    rng = random.Random(seed)
    sizes = np.array([rng.choice([rng.randrange(1, 300), rng.randrange(1, 4097), 1366, 2048, 4096]) for _ in range(800)])
    bins, offsets, filled = op.pack_lengths(sizes)
    assert filled.max() <= 4096 and filled.sum() == sizes.sum()
    for b in range(len(filled)):
        inside = np.flatnonzero(bins == b)
        assert sum(sizes[inside] * 3 > 4096) <= 2
        assert sorted(offsets[inside]) == [0, *np.cumsum(sizes[inside][np.argsort(offsets[inside])])[:-1]]
    assert len(filled) <= 1.1 * max(sizes.sum() / 4096, (sizes * 3 > 4096).sum() / 2) + 2  # two large pieces at most share a sequence


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (4, "w " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS id", "8 AS length", "9 AS sequence_id")
    got = op.pack_documents(df, word_bpe_path()).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got if r.doc_id != 4) == [(0, 3), (1, 1), (2, 1), (2, 1)]
    assert sum(r.length for r in got if r.doc_id == 4) == 300_001 and max(r.piece for r in got) == 73
    assert op.pack_documents(spark.createDataFrame([], "doc_id long, text string"), word_bpe_path()).count() == 0
