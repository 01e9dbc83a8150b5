"""Substring dedup against counting every window of small tables."""

import hashlib
import random

import pytest

from sievegrid.llm import substring_dedup as op
from sievegrid.llm.queries import op7_substring_dedup


def brute_force(texts, window=35):
    """(words, words removed, SHA-256 of the kept words) of each text."""
    lists = [(t or "").encode().split() for t in texts]
    counts = {}
    for words in lists:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            counts[key] = counts.get(key, 0) + 1
    out = []
    for words in lists:
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(words), len(gone), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    return out


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, sum(s.stop - s.start for s in r.removed_spans), hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in df.collect())


def wanted(rows, window):
    return sorted((r[0] if r[0] is not None else -1, *b) for r, b in zip(rows, brute_force([r[1] for r in rows], window), strict=True))


@pytest.mark.parametrize("sizes", [{}, {"buckets": 3, "fold_bytes": 2000, "bucket_bytes": 3000}])
@pytest.mark.parametrize("window", [8, 35])
def test_random_tables(spark, window, sizes):
    rng = random.Random(window)
    word = lambda: rng.choice(["a", "b", "cc", "é", "0"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(20, 90))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages)[rng.randrange(5) :] if rng.random() < 0.5 else [word() for _ in range(rng.randrange(50))]
        rows.append((i, "\t".join(words) if i % 2 else "  " + " \n".join(words)))
    rows += [(500, None), (501, ""), (502, "is " * 200), (502, "is " * 200), (None, "of the " * 60), (503, "of the " * 61 + "end"), (504, " ".join("xyz" * 50)), (505, "a1 b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(op.drop_repeated_windows(df, window=window, **sizes)) == wanted(rows, window)


@pytest.mark.parametrize("sizes", [{}, {"buckets": 3, "fold_bytes": 2000, "bucket_bytes": 3000}])
def test_hot_minimisers(spark, sizes):
    """One run of words in many different passages; every minimiser counts as hot, and each window goes by its own hash."""
    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(12))
    rows = [(i, " ".join(f"r{rng.randrange(30)}" for _ in range(rng.randrange(20))) + f" {shared} " + " ".join(f"r{rng.randrange(30)}" for _ in range(rng.randrange(30)))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, None), (301, "is " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hot = op.hot_minimisers(df.selectExpr("doc_id AS m1", "doc_id AS m2", "CAST(text AS BINARY) AS text"), 14, sizes.get("buckets", 8), 1, 0)
    assert hot
    assert got(op.drop_repeated_windows(df, window=14, hot_sample=1, hot_bytes=0, **sizes)) == wanted(rows, 14)


def test_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, long), (2, long[2_000_000:2_000_900]), (3, "x " * 600_000)]
    assert got(op.drop_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))) == wanted(rows, 35)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.drop_repeated_windows(empty).count() == 0
    df = spark.createDataFrame([(1, "a b", 7, "k", 3, 4)], "doc_id long, text string, n_words int, kept_text string, m1 int, spans int")
    row = op.drop_repeated_windows(df).first()
    assert (row.n_words, row.kept_text, row.m1, row.spans) == (2, "a b", 3, 4)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(tuple(r) for r in op7_substring_dedup(spark, sf).collect())
    assert found == wanted(rows, 35)
    assert 0 < sum(r[2] > 0 for r in found) < len(found)
