"""Exact dedup and its trie, against dictionaries."""

import hashlib
import random

import pytest

from sievegrid.llm import exact_dedup as op
from sievegrid.llm.radix import PatriciaTrie, shared_prefix


def bare(text):
    return (text or "").translate(dict.fromkeys(b" \t\n\x0b\x0c\r"))


def plain(rows):
    groups = {}
    for n, (id_, text) in enumerate(rows):
        groups.setdefault(bare(text), []).append((-len(text or ""), id_ is None, id_ or 0, n, id_))
    return sorted(((id_, min(g)[4], len(g), hashlib.sha256(bare(text).encode()).hexdigest()) for id_, text in rows for g in [groups[bare(text)]]), key=str)


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (None, "a  b"), (7, "abc"), (8, "ab c"), (9, "x" * 300_000), (10, "x" * 300_000 + "y"), (3, "a  b"), (11, "é"), (12, "\té")]


@pytest.mark.parametrize("budget", [op.TRIE_BYTES, 900])
def test_classes(spark, budget):
    rows = ROWS + [(100 + i, f"{'p' * (i % 7)} {i % 40}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op.exact_classes(df, trie_bytes=budget).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({bare(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_drop_keeps_columns(spark):
    df = spark.createDataFrame([(*r, i, "m", 2) for i, r in enumerate(ROWS)], "doc_id long, text string, kept int, mark string, mark2 int")
    got = op.drop_exact_copies(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == len({bare(t) for _, t in ROWS}) and all(r.mark == "m" for r in rows)
    assert op.drop_exact_copies(df.where("false")).count() == 0


@pytest.mark.parametrize("budget", [300, 5_000, 1 << 20])
def test_trie_with_spill(budget):
    rng = random.Random(budget)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(2000)] + [b"pp" * 200 + bytes([i % 9]) for i in range(50)]
    trie, want = PatriciaTrie(lambda a, b: a + b, budget), {}
    for k in keys:
        trie.put(k, 1)
        want[k] = want.get(k, 0) + 1
    got = list(trie.drain())
    assert len(got) == len(want) and dict(got) == want


def test_shared_prefix():
    rng = random.Random(1)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared_prefix(a, b) == n
